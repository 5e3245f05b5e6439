"""Command line: index a folder, list duplicates and recommendations, check a snippet, compare two files, call a tool."""

from __future__ import annotations

import argparse
import json
import shutil
import socket
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.engine import TOOLS, Engine
from tessera.languages import registry
from tessera.operators import content, duplicates, extract, maintenance, recommend, trees
from tessera.sources import paths, scan, store

# The usual server of each language.
SERVERS = {"python": "pylsp", "javascript": "typescript-language-server --stdio", "typescript": "typescript-language-server --stdio", "c": "tcp://127.0.0.1:2087", "cpp": "tcp://127.0.0.1:2088", "java": "tcp://127.0.0.1:2089", "go": "tcp://127.0.0.1:2091"}


def reachable(command: list[str], wait: float = 0.2) -> bool:
    """Whether a command's program is there, or its address answers."""
    at = paths.endpoint(command)
    if at is None:
        return bool(command and shutil.which(command[0]))
    if at["transport"] == "unix":
        return Path(at["path"]).exists()
    try:
        socket.create_connection((at["host"], at["port"]), wait).close()
    except OSError:
        return False
    return True


def doctor(bindings: str) -> list[dict]:
    """A row for each language: its files, its server's command, where that comes from, and whether it is there."""
    known = registry.default()
    out = []
    for language in known.languages:
        command, source = paths.server_command(language, paths.words(SERVERS.get(language, "")), bindings, f"TESSERA_{language.upper()}_SERVER")
        out.append({"language": language, "files": sorted(known.get(language).file_extensions), "command": command, "source": source, "available": reachable(command)})
    return out


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    for name, more, nodes in (("index", ["root"], None), ("duplicates", [], 5), ("recommend", [], 5), ("check", ["file"], 3)):
        s = sub.add_parser(name)
        for x in ["store", *more]:
            s.add_argument(x)
        if nodes:
            s.add_argument("--min-nodes", type=int, default=nodes)
        s.add_argument("--json", action="store_true")
    s = sub.add_parser("compare")
    s.add_argument("a")
    s.add_argument("b")
    s.add_argument("--semantic", default="off")
    s = sub.add_parser("tool")
    s.add_argument("store")
    s.add_argument("root")
    s.add_argument("name", choices=TOOLS)
    s.add_argument("arguments", nargs="?", default="{}")
    s = sub.add_parser("doctor")
    s.add_argument("--bindings", default="")
    s.add_argument("--json", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    if args.do == "doctor":
        rows = doctor(args.bindings)
        print(json.dumps(rows) if args.json else "\n".join(f"{r['language']:<12} {'ok' if r['available'] else '-':<3} {' '.join(r['command'])} ({r['source']})" for r in rows))
        return 0
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()

    def snippet(path: str) -> tuple[str, str]:
        return scan.LANGUAGES.get(Path(path).suffix.lstrip("."), "text"), Path(path).read_text()

    if args.do == "compare":
        (language, one), (_, two) = snippet(args.a), snippet(args.b)
        if args.semantic != "off":
            print(content.compare(spark, one, two, language, args.semantic))
            return 0
        a, b = trees.describe(one, language), trees.describe(two, language)
        print("equivalent" if a[4] == b[4] else "similar" if a[2] == b[2] or a[5] == b[5] else "different")
        return 0
    if args.do == "tool":
        print(Engine(spark, args.store, args.root).call(args.name, json.loads(args.arguments)))
        return 0
    if args.do == "index":
        files = scan.files(spark, args.root, paths.read_ignore(args.root) or ())
        entries = maintenance.with_ids(trees.entries(extract.units(files)))
        old = store.load(spark, args.store, "suppressions")
        tables = {"entries": entries, "metadata": maintenance.metadata_of(files, entries, time.time()), "suppressions": spark.createDataFrame([], maintenance.SUPPRESSION) if old is None else old}
        name = store.save(tables, args.store)
        print(f"{name}: {store.load(spark, args.store, 'entries').count()} entries")
        return 0
    entries = store.load(spark, args.store, "entries")
    if entries is None:
        print("no index")
        return 1
    if args.do == "check":
        language, code = snippet(args.file)
        probe = trees.entries(spark.createDataFrame([(1, language, code)], "probe_id int, language string, code string"))
        best = duplicates.best_matches(probe, entries.where(F.col("language") == language), args.min_nodes)
        print(duplicates.gate(best, probe).first().decision)
        return 0
    known = store.load(spark, args.store, "suppressions")
    groups = duplicates.exact(entries, args.min_nodes, None if known is None else maintenance.suppressed_hashes(known))
    own = duplicates.code_units(entries).where(F.col("node_count") >= args.min_nodes)
    if args.do == "duplicates":
        shown = duplicates.top_members(own, groups, "wl_hash").groupBy("group_hash").agg(F.sort_array(F.collect_list(F.struct("place", "location"))).alias("l"))
        for r in groups.join(shown, "group_hash").orderBy(F.desc("size"), "group_hash").toLocalIterator():
            print(json.dumps({"hash": r.group_hash, "size": r["size"], "locations": [x.location for x in r.l]}) if args.json else " ".join([f"{r.group_hash[:12]} x{r['size']}", *(x.location for x in r.l)]))
    else:
        found = recommend.described(recommend.recommend(own, "wl_hash", groups))
        for r in recommend.ranked(found).toLocalIterator():
            print(json.dumps(r.asDict()) if args.json else f"{r.group_hash[:12]} {r.action} {r.level} impact {r.impact:.2f} confidence {r.confidence:.2f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
