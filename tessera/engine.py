"""The engine as a service: one index in a store, kept current, asked and acted upon by name.

State lies in the store; a call reads the newest of it and writes a delta or a snapshot. What an analysis found is kept
under the version of the index that it was made of, so a change of the index makes it void by itself.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import content, extract, maintenance, recommend, report, trees
from tessera.operators import duplicates as dup
from tessera.sources import paths, scan, store
from tessera.sources.scratch import written
from tessera.streaming import events as ev
from tessera.streaming.storms import Watchers

CHANGES = frozenset("index_codebase set_workspace index_file write edit suppress unsuppress metadata_erase metadata_recompute_baseline generate_ignore sync".split())
TOOLS = tuple(sorted(CHANGES | set("analyze check compare status list_suppressions check_staleness recommend".split())))
RESOURCES = {"tessera://status": "status", "tessera://analysis/latest": "latest_analysis", "tessera://suppressions": "list_suppressions"}
PROMPTS = ("review-duplicates", "setup-servers")
FOCUS = ("exact", "block", "pattern", "near", "source", "tests")
CHECK_NODES = 10


class Engine:
    def __init__(self, spark: SparkSession, location: str | None = None, root: str | None = None):
        """location: the store's folder; without one, that of the root."""
        self.spark, self.root = spark, root
        self.location = location or (paths.store_path(root) if root else None)
        self.lock, self.watchers = threading.RLock(), Watchers()
        self.degraded: str | None = None
        self.cache: tuple[str, DataFrame] | None = None
        self.hits = self.misses = 0

    # ---- state

    def table(self, name: str) -> DataFrame | None:
        return store.load(self.spark, self.location, name) if self.location else None

    @property
    def version(self) -> str | None:
        """The newest snapshot's or delta's name."""
        known = store.snapshots(self.spark, self.location) if self.location else []
        return known[-1] if known else None

    def known(self) -> DataFrame:
        found = self.table("suppressions")
        return self.spark.createDataFrame([], maintenance.SUPPRESSION) if found is None else found

    def rules(self) -> list[str]:
        return (paths.read_ignore(self.root) or []) if self.root and os.path.isdir(self.root) else []

    # ---- indexing

    def index_codebase(self, path: str, recursive: bool = True) -> str:
        """Indexes a folder: what changed if it has an index, else all of it."""
        if len(os.path.abspath(path).split(os.sep)) < 3:
            return f"Refusing to index {path}: too close to the root."
        if not os.path.exists(path):
            return f"Path does not exist: {path}"
        if self.root != path and self.root is not None:
            self.location = None
        self.root = path
        self.location = self.location or paths.store_path(path)
        if self.table("entries") is not None:
            return self.sync()
        files = scan.files(self.spark, path, self.rules(), recursive)
        entries = written(maintenance.with_ids(trees.entries(extract.units(files))), "entries")
        at = time.time()
        store.save({"entries": entries, "metadata": maintenance.metadata_of(files, entries, at), "suppressions": self.known()}, self.location)
        return self._stats()

    def set_workspace(self, path: str) -> str:
        self.location = None
        self.root = None
        return self.index_codebase(path)

    def index_file(self, path: str) -> str:
        """Reads one file again."""
        if not self.location:
            return self.index_codebase(os.path.dirname(path) or ".")
        named = self.spark.createDataFrame([(os.path.relpath(path, self.root),)], "file_path string").where(ev.supported(F.col("file_path"), self.rules()))
        return self._apply(scan.read(named, self.root), None)

    def changes(self) -> tuple[DataFrame, DataFrame]:
        """(file_path, status, opened) of the folder against its metadata, and the files that had to be opened for it."""
        listed, meta = scan.listing(self.spark, self.root, self.rules()), self.table("metadata")
        opened = written(scan.read(maintenance.to_open(listed, meta), self.root), "opened")
        return written(maintenance.gated_status(listed, opened, meta), "status"), opened

    def sync(self) -> str:
        """An incremental step over the whole folder: a listing, and only files of another time are opened; only what changed
        is read into units and written."""
        what, opened = self.changes()
        changed = opened.join(what.where("status in ('added', 'updated')"), "file_path", "left_semi")
        n = {r.status: r["count"] for r in what.groupBy("status").count().collect()}
        text = f" ({n.get('added', 0)} added, {n.get('updated', 0)} updated, {n.get('unchanged', 0)} unchanged, {n.get('removed', 0)} removed)"
        if set(n) - {"unchanged"}:
            self._apply(changed, what.where("status = 'removed'"))
        self.degraded = None
        return self._stats(text)

    def _apply(self, changed: DataFrame, removed: DataFrame | None) -> str:
        """Writes a delta of files that changed and files that went."""
        entries = written(maintenance.with_ids(trees.entries(extract.units(changed))), "entries")
        meta = maintenance.metadata_of(changed, entries, time.time())
        gone = changed.select("file_path") if removed is None else changed.select("file_path").unionByName(removed.select("file_path"))
        both = gone.select(F.explode(F.array(F.lit("entries"), F.lit("metadata"))).alias("table"), F.col("file_path").alias("key"))
        store.save_delta(self.spark, self.location, both, entries=entries, metadata=meta)
        store.compact_many(self.spark, self.location)
        return self._stats()

    def _stats(self, changes: str = "") -> str:
        entries = self.table("entries")
        return report.stats_text(report.stats(entries).first(), dup.has_duplicates(entries).first()[0], True, changes)

    # ---- questions

    def analysis(self) -> DataFrame:
        """The findings of the present index: kept until it changes."""
        version = self.version
        if self.cache and self.cache[0] == version:
            self.hits += 1
            return self.cache[1]
        self.misses += 1
        found = report.findings(self.table("entries"), maintenance.suppressed_hashes(self.known()))
        path = f"{self.location}/analysis/{version}"
        found.write.mode("overwrite").parquet(path)
        self.cache = (version, self.spark.read.schema(found.schema).parquet(path))
        return self.cache[1]

    def invalidate(self) -> str:
        """Ends suppressions that no longer hold; a notice of them."""
        entries, known = self.table("entries"), self.known()
        if entries is None or not known.limit(1).count() or not self.root:
            return ""
        named = written(scan.read(known.select(F.explode("source_files").alias("file_path")), self.root), "named-files")
        go_on, ended = maintenance.invalidate(known, entries, named)
        changed = go_on.join(known.select("hash", F.col("file_hashes").alias("before")), "hash").where(F.to_json("before") != F.to_json("file_hashes")).drop("before")
        text = report.invalidated_text(ended)
        if text or changed.limit(1).count():
            store.save_delta(self.spark, self.location, ended.select(F.lit("suppressions").alias("table"), F.col("hash").alias("key")), suppressions=changed.select(*known.columns))
        return text

    def analyze(self) -> str:
        if self.table("entries") is None:
            return "No codebase indexed yet."
        notice, found, n = self.invalidate(), self.analysis(), self.known().count()
        if not found.limit(1).count():
            store.clear_reports(self.spark, self.location)
            return notice + report.report_text(found, n)
        where = report.write_report(found, store.new_report(self.location), n)
        return notice + report.summary_text(found, n, where)

    def latest_analysis(self) -> str:
        if not self.location:
            return "No codebase indexed yet."
        known = store.reports(self.spark, self.location)
        return report.read_report(self.spark, known[-1]) if known else "No analysis reports available."

    def recommend(self, min_nodes: int = 5) -> str:
        entries = self.table("entries")
        groups = dup.exact(entries, min_nodes, maintenance.suppressed_hashes(self.known()))
        own = dup.code_units(entries).where(F.col("node_count") >= min_nodes)
        places = dup.top_members(own, groups, "wl_hash", report.SHOWN).groupBy("group_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "location"))), lambda x: x["location"]).alias("places"))
        return "\n".join(recommend.report_lines(recommend.recommend(own, "wl_hash", groups), places))

    def check(self, code: str, language: str = "python") -> str:
        entries = self.table("entries")
        if entries is None:
            return "No codebase indexed yet."
        if language not in scan.LANGUAGES.values():
            return f"Unsupported language '{language}': no registered language plugin."
        probe = trees.entries(self.spark.createDataFrame([("p", language, code)], "probe_id string, language string, code string"))
        found = dup.similar(probe, entries, CHECK_NODES).join(entries.drop("depth"), "unit_id").withColumns({"content_id": F.lit(1).cast("long"), "same_language": F.col("language") == language})
        own = entries.where(F.col("language") == language)
        best = dup.top_similar(probe, own, 1, CHECK_NODES, ("file_path", "line_start", "name")).join(own.drop("depth"), "unit_id").limit(1).collect()
        one = self.spark.createDataFrame([(1, None, language, code)], "content_id long, file_path string, language string, text string")
        return "\n\n".join(filter(None, [self.invalidate() + content.check_text(best[0] if best else None, language), content.assist_text(content.assist(one, found))]))

    def compare(self, code1: str, code2: str, language: str = "python", semantic_mode: str = "off") -> str:
        if language not in scan.LANGUAGES.values():
            return f"Unsupported language '{language}': no registered language plugin."
        return content.compare(self.spark, code1, code2, language, semantic_mode.strip().lower())

    def check_staleness(self, path: str | None = None) -> str:
        entries = self.table("entries")
        if entries is None:
            return "No codebase indexed yet."
        return self.invalidate() + report.staleness_text(maintenance.staleness_report(self.changes()[0], entries, self.known()))

    def status(self) -> str:
        entries = self.table("entries")
        return report.status_text(None if entries is None else report.stats(entries).first(), False, self.degraded, bool(self.watchers.queries))

    def stats(self) -> dict[str, Any]:
        """Counters of index, store, watchers and cache."""
        entries = self.table("entries")
        own = {} if entries is None else report.stats(entries, self.known()).first().asDict()
        return own | {"snapshots": len(store.snapshots(self.spark, self.location)) if self.location else 0, "bytes": store.size(self.spark, self.location) if self.location else 0, "watching": sorted(self.watchers.queries), "cache_hits": self.hits, "cache_misses": self.misses, "degraded": self.degraded}

    # ---- suppressions

    def _hashes(self, wl_hash: str | list[str]) -> DataFrame:
        return self.spark.createDataFrame([(h,) for h in ([wl_hash] if isinstance(wl_hash, str) else wl_hash)], "hash string")

    def suppress(self, wl_hash: str | list[str], reason: str | None = None) -> str:
        """Suppresses hashes, of near groups too; those that the index hasn't are named."""
        entries, asked = self.table("entries"), self._hashes(wl_hash)
        if entries is None:
            return "No codebase indexed yet."
        near = entries.withColumn("wl_hash", F.substring(F.sha2(dup.prefix(dup.NEAR_LEVELS), 256), 1, 16))
        meta = self.table("metadata")
        new = maintenance.suppressions(entries, asked, meta, time.time(), reason)
        new = new.unionByName(maintenance.suppressions(near, asked, meta, time.time(), reason).join(new.select("hash"), "hash", "left_anti"))
        store.save_delta(self.spark, self.location, None, suppressions=new)
        done, missing = ([r.hash for r in x.orderBy("hash").collect()] for x in maintenance.split_known(asked, new))
        return "\n".join(([f"Suppressed {', '.join(done)}."] if done else []) + ([f"Not found: {', '.join(missing)}."] if missing else []))

    def unsuppress(self, wl_hash: str | list[str]) -> str:
        done, missing = maintenance.split_known(self._hashes(wl_hash), self.known())
        names = [r.hash for r in done.orderBy("hash").collect()], [r.hash for r in missing.orderBy("hash").collect()]
        if names[0]:
            store.save_delta(self.spark, self.location, done.select(F.lit("suppressions").alias("table"), F.col("hash").alias("key")))
        return "\n".join(([f"Unsuppressed {', '.join(names[0])}."] if names[0] else []) + ([f"Not found: {', '.join(names[1])}."] if names[1] else []))

    def list_suppressions(self) -> str:
        return self.invalidate() + report.suppressions_text(self.known())

    # ---- writing

    def _gate(self, path: str, text: str, editing: bool) -> tuple[str, bool]:
        """What is to be said before a file is written, and whether it may be."""
        if not paths.within(path, self.root):
            return f"Path is outside the workspace: {path}", False
        shown = os.path.relpath(path, self.root)
        language = scan.LANGUAGES.get(path.rpartition(".")[2].lower())
        if language is None:
            return "NOTE: No language plugin is registered for this file extension. Skipping structural duplicate checks.\n\n", True
        one = self.spark.createDataFrame([(1, shown, language, text)], "content_id long, file_path string, language string, text string")
        found = content.matches(one, self.table("entries"), CHECK_NODES)
        r = content.gate(one, found, editing).first()
        place = f"{r.file_path}:{r.name}"
        if r.decision == "BLOCKED":
            return f"BLOCKED: Cannot {'edit' if editing else 'write'} - identical code exists at {place} (lines {r.line_start}-{r.line_end}). Reuse the existing implementation instead.", False
        said = ""
        if r.decision == "WARNING":
            said = f"WARNING: Identical code exists in same file at {r.name} (lines {r.line_start}-{r.line_end}). Consider reusing. Proceeding with edit.\n\n" if r.match == "exact" else f"WARNING: Similar code exists at {place}. Consider reusing. Proceeding with {'edit' if editing else 'write'}.\n\n"
        hint = content.assist_text(content.assist(one, found))
        return said + (hint + "\n\n" if hint else ""), True

    def write(self, file_path: str, content: str) -> str:
        said, go = self._gate(file_path, content, False)
        return said + paths.write_file(file_path, content, os.path.relpath(file_path, self.root)) if go else said

    def edit(self, file_path: str, old_string: str, new_string: str) -> str:
        shown = os.path.relpath(file_path, self.root)
        said, go = self._gate(file_path, new_string, True)
        if not go:
            return said
        try:
            with open(file_path, encoding="utf-8") as f:
                text = f.read()
        except OSError as e:
            return f"File not found: {shown}" if isinstance(e, FileNotFoundError) else f"Failed to read {shown}: {e}"
        new, problem = content.edited(text, old_string, new_string)
        if new is None:
            return problem
        answer = paths.write_file(file_path, new, shown)
        return answer if answer.startswith("Failed") else said + content.diff(text, old_string, new_string, shown)

    # ---- housekeeping

    def generate_ignore(self) -> str:
        made, path = paths.generate_ignore(self.root)
        return f"Created {path}" if made else f"{path} exists already."

    def metadata_erase(self) -> str:
        self.cache = None
        done = bool(self.location) and store.erase(self.spark, self.location)
        return "Erased the index." if done else "Nothing to erase."

    def metadata_recompute_baseline(self) -> str:
        self.metadata_erase()
        return self.index_codebase(self.root)

    # ---- events

    def handle(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Applies a micro-batch of file events (ts, path, event_type; paths relative to the root)."""
        with self.lock:
            again, gone = ev.routed(ev.watched(batch, self.rules()))
            files = scan.read(again.select(F.col("path").alias("file_path")), self.root)
            if again.limit(1).count() or gone.limit(1).count():
                self._apply(files, gone.select(F.col("path").alias("file_path")))

    def storm(self) -> None:
        """The index may be behind until the next sync."""
        self.degraded = "storm_quarantine"

    def watch(self, stream: DataFrame, checkpoint: str):
        """Keeps the index current with a stream of file events; None if too many roots are watched."""
        return self.watchers.watch(self.root, lambda: ev.keep_current(stream, self.handle, checkpoint))

    def stop_watching(self) -> bool:
        return self.watchers.unwatch(self.root)

    # ---- by name

    def call(self, name: str, arguments: dict[str, Any] | None = None) -> str:
        """A tool by its name; those that change something wait for one another."""
        if name not in TOOLS:
            return f"Unknown tool: {name}"
        tool: Callable = getattr(self, name)
        if name not in CHANGES:
            return tool(**(arguments or {}))
        with self.lock:
            return tool(**(arguments or {}))

    def resource(self, uri: str) -> str:
        if uri not in RESOURCES:
            raise ValueError(f"unknown resource {uri}")
        return getattr(self, RESOURCES[uri])()

    def prompt(self, name: str, argument: str | None = None) -> str:
        if name == "review-duplicates":
            return f"Review the duplicates of this codebase{f', {argument} first' if argument else ''}, and propose for each group to refactor or to suppress it.\n\n{self.latest_analysis()}"
        if name == "setup-servers":
            return f"Set up language servers{f' for {argument}' if argument else ''}: name each server's command and bind it."
        raise ValueError(f"unknown prompt {name}")

    @staticmethod
    def complete(name: str, start: str) -> list[str]:
        """Values of a prompt's argument that begin so."""
        values = FOCUS if name == "review-duplicates" else tuple(sorted(set(scan.LANGUAGES.values()))) if name == "setup-servers" else ()
        return [v for v in values if v.startswith(start.lower())]
