"""Which files of a tree are sources: skipped folders, ignore rules, languages, and the readers."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import written

# Folders that are never entered, and the languages of file suffixes.
SKIP = ("__pycache__", ".git", ".hg", ".svn", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", ".next", ".nuxt", "build", "dist", "out", "target", ".gradle", "cmake-build-debug", "cmake-build-release", "vendor", "coverage", ".eggs", "venv", ".venv", "env", ".env", "virtualenv")
VENV = r"(?i)^\.?(venv|env|virtualenv)([^a-z].*)?$"
LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "ipp": "cpp", "java": "java", "go": "go"}


def skipped(path: Column) -> Column:
    """Whether any folder of a path is one that is never entered."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.isin(*SKIP) | d.endswith(".egg-info") | d.rlike(VENV))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for whole strings; a star also crosses folders, two stars stand for any folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("*", i):
            out, i = out + ".*", i + 1
            while glob.startswith("*", i):
                i += 1
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"(?s)^(?:{out})$"


def parse_rules(lines: Iterable[str]) -> list[tuple[bool, bool, bool, str]]:
    """(negated, folders only, anchored, glob) of the lines that are neither blank nor comments."""
    out = []
    for raw in lines:
        line = raw.strip()
        if not line or line[0] == "#":
            continue
        negated = line[0] == "!"
        line = line[negated:]
        only = line.endswith("/")
        line = line.rstrip("/") if only else line
        anchored = line.startswith("/")
        line = line.lstrip("/")
        if line:
            out.append((negated, only, anchored or "/" in line.replace("**/", ""), line))
    return out


def ignored(path: Column, rules: list[tuple[bool, bool, bool, str]]) -> Column:
    """Whether the last rule that matches a file's path, or for folder rules one of its folders, ignores it. The rules
    are part of the expression: a path is judged where it is read."""
    parts = F.split(path, "/")
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.expr("cast(array() as array<string>)"))
    out = F.lit(None).cast("boolean")

    def meets(p: Column, anchored: bool, glob: str) -> Column:
        whole = p.rlike(glob_regex(glob))
        return whole if anchored else whole | F.element_at(F.split(p, "/"), -1).rlike(glob_regex(glob))

    def folder(anchored: bool, glob: str) -> Callable[[Column], Column]:
        return lambda d: meets(d, anchored, glob)

    for negated, only, anchored, glob in rules:
        hit = F.exists(folders, folder(anchored, glob)) if only else meets(path, anchored, glob)
        out = F.when(hit, not negated).otherwise(out)
    return F.coalesce(out, F.lit(False))


#: Folders that a task lists before it hands the folders in them to the next round.
LISTED = 1000
LISTING = "file_path string, size long, mtime double"


def opened_store(root: str) -> tuple[fs.FileSystem, str]:
    """The store that a root is on, and its path there."""
    store, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + posixpath.abspath(root))
    return store, path.rstrip("/")


def listing(spark: SparkSession, root: str, rules: Iterable[str] = (), recursive: bool = True, budget: int = LISTED) -> DataFrame:
    """(file_path, size, mtime) of the sources under root, paths relative to it; no file is opened.

    The frontier of folders is a table. A round's tasks list its folders and those in them, up to a budget; the folders that
    remain are the next round's frontier. The driver sees only whether there is another. Folders that are skipped or that
    a rule ignores are not entered, so rules that bring single files back from an ignored folder don't."""
    judged = [(negated, only, anchored, re.compile(glob_regex(glob))) for negated, only, anchored, glob in parse_rules(rules)]

    def dropped(rel: str, folder: bool) -> bool:
        out = False
        for negated, only, anchored, glob in judged:
            if (folder or not only) and (glob.match(rel) or not anchored and glob.match(rel.rpartition("/")[2])):
                out = not negated
        return out

    def entered(rel: str, name: str) -> bool:
        return recursive and not (name in SKIP or name.endswith(".egg-info") or re.match(VENV, name)) and not dropped(rel, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened_store(root)
        for b in batches:
            todo, left = b.column(0).to_pylist(), budget
            while todo and left:
                found = []
                for s in store.get_file_info(fs.FileSelector(posixpath.join(base, todo.pop()).rstrip("/") or "/", allow_not_found=True)):
                    rel = s.path[len(base) :].lstrip("/")
                    if s.type == fs.FileType.Directory:
                        if entered(rel, s.base_name):
                            todo.append(rel)
                    elif s.extension.lower() in LANGUAGES and not dropped(rel, False):
                        found.append((rel, s.size, (s.mtime_ns or 0) // 1_000_000 / 1000, False))
                left -= 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["file_path", "size", "mtime", "folder"])
            if todo:
                yield pa.RecordBatch.from_arrays([pa.array(todo), pa.nulls(len(todo), pa.int64()), pa.nulls(len(todo), pa.float64()), pa.array([True] * len(todo))], ["file_path", "size", "mtime", "folder"])

    frontier, rounds = spark.createDataFrame([("",)], "file_path string"), []
    while True:
        rounds.append(written(frontier.mapInArrow(run, LISTING + ", folder boolean"), "listing"))
        frontier = rounds[-1].where("folder").select("file_path")
        if not frontier.limit(1).count():
            break
        frontier = frontier.repartition(spark.sparkContext.defaultParallelism * 4)
    return reduce(DataFrame.unionByName, (r.where("not folder").drop("folder") for r in rounds))


def read(paths: DataFrame, root: str) -> DataFrame:
    """(file_path, language, text, mtime) of named files (file_path) under root: only these are opened, in the tasks. Files
    that are not there, or went meanwhile, have no row; text that isn't UTF-8 is null; a path named twice is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened_store(root)
        for b in batches:
            for rel in b.column(0).to_pylist():
                info = store.get_file_info(posixpath.join(base, rel))
                if info.type != fs.FileType.File:
                    continue
                try:
                    with store.open_input_stream(info.path, compression=None) as f:
                        raw = f.read()
                except FileNotFoundError:
                    continue
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([text], pa.string()), pa.array([(info.mtime_ns or 0) // 1_000_000 / 1000])], ["file_path", "text", "mtime"])

    named = paths.select("file_path").where("file_path is not null").distinct()
    rows = named.mapInArrow(run, "file_path string, text string, mtime double")
    return rows.withColumn("language", language(F.col("file_path"))).select("file_path", "language", "text", "mtime")


def files(spark: SparkSession, root: str, rules: Iterable[str] = (), recursive: bool = True) -> DataFrame:
    """(file_path, language, text, mtime) of all sources under root: the listing, and what read() makes of it."""
    return read(listing(spark, root, list(rules), recursive), root)
