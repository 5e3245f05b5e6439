"""Scans, suppressions, upserts, gates and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import duplicates, extract, maintenance, trees
from tessera.sources import scan
from tessera.streaming import events


@pytest.mark.parametrize(
    ("glob", "text", "hit"),
    [("*.js", "a/b.js", True), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**/x", "a/x", True), ("a/**/x", "a/b/c/x", True), ("a?c", "abc", True), ("[!a]b", "ab", False), ("[ab]c", "bc", True), ("a.b", "axb", False)],
)
def test_globs(glob, text, hit):
    import re

    assert bool(re.match(scan.glob_regex(glob), text)) == hit


def test_scan_of_a_folder(spark, tmp_path):
    for p, t in {"a.py": "x = 1", "src/b.js": "y", "env/c.py": "z", "environment/d.go": "w", "note.txt": "n", "src/gen/e.ts": "e"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.file_path: (r.language, r.text) for r in scan.files(spark, str(tmp_path), ["gen/"]).collect()}
    assert got == {"a.py": ("python", "x = 1"), "src/b.js": ("javascript", "y"), "environment/d.go": ("go", "w")}
    assert scan.files(spark, str(tmp_path), recursive=False).count() == 1


def indexed(spark, files):
    return trees.entries(extract.units(spark.createDataFrame([(p, "python", t) for p, t in files.items()], "file_path string, language string, text string")))


ADD = "def add(a, b):\n    c = a + b\n    return c\n"


def test_life_of_an_index(spark):
    e = indexed(spark, {"a.py": ADD, "b.py": ADD.replace("add", "plus"), "c.py": ADD.replace("+", "*"), "d.py": None})
    found = duplicates.exact(e)
    assert [r.size for r in found.collect()] == [2] and [r.size for r in duplicates.pattern(e).collect()] == [3]
    hashes = found.select(F.col("group_hash").alias("hash"))
    assert duplicates.exact(e, suppressed=hashes).count() == 0 and duplicates.has_duplicates(e).first()[0]
    snap = maintenance.suppress(e, hashes).first()
    assert (snap.entry_count, snap.n_files, snap.first_name) == (2, 2, "add")
    changed = indexed(spark, {"a.py": "def other():\n    pass\n", "b.py": "pass"})
    after = maintenance.upsert(e, changed, spark.createDataFrame([("b.py",)], "file_path string"))
    assert sorted(r.name for r in after.collect()) == ["add", "other"]
    assert maintenance.stale(hashes, after).first().stale and not maintenance.stale(hashes, e).first().stale
    assert maintenance.unsuppress(hashes, hashes).count() == 0


def test_similar_prefers_the_stronger_match(spark):
    e = indexed(spark, {"a.py": ADD, "c.py": ADD.replace("+", "*")}).withColumn("unit_id", F.col("file_path"))
    p = trees.entries(spark.createDataFrame([(1, "python", ADD), (2, "python", "x"), (3, "python", "def ::::")], "probe_id int, language string, code string"))
    got = {(r.probe_id, r.unit_id): (r.match, r.depth) for r in duplicates.similar(p, e).collect()}
    assert got == {(1, "a.py"): ("exact", None), (1, "c.py"): ("partial", 3)}
    assert {r.probe_id: r.decision for r in duplicates.gate(duplicates.similar(p, e), p).collect()} == {1: "STOP", 2: "CREATE", 3: "CREATE"}
    assert {r.probe_id: r.decision for r in duplicates.gate(duplicates.best_matches(p, e), p).collect()} == {1: "STOP", 2: "CREATE", 3: "CREATE"}


def test_stream_equals_batch(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(seconds=s), p, "modified") for i, (p, s) in enumerate([("a", 0), ("a", 5), ("a", 60), ("b", 3), ("b", 200), ("a", 90_000)])]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, path string, event_type string")
    df.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = events.sessions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 10)
    events.keep_current(stream, lambda b, _: seen.extend((r.path, r.n) for r in b.collect()), f"{tmp_path}/cp").awaitTermination()
    batch = sorted((r.path, r.n) for r in events.bursts(df, 10).where("last < '2024-01-01 20:00:00'").collect())
    assert sorted(seen) == batch == [("a", 1), ("a", 2), ("b", 1), ("b", 1)]
    moved = spark.createDataFrame([(at, "x", "moved", "y"), (at, "z", "deleted", None)], "ts timestamp, path string, event_type string, dest_path string")
    assert sorted((r.path, r.event_type) for r in events.moves(moved).collect()) == [("x", "deleted"), ("y", "created"), ("z", "deleted")]
