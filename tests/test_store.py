"""The store's merge on read and its compaction."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import store

SCHEMA = "file_path string, unit_id long"


@pytest.fixture
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def read(spark, root):
    return sorted(map(tuple, store.load(spark, root, "entries").select("file_path", "unit_id").collect()))


def scans_and_shuffles(spark, root):
    plan = store.load(spark, root, "entries")._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Exchange")


def test_deltas_are_merged_as_by_a_chain(small, tmp_path):
    spark, root, rng = small, str(tmp_path / "s"), random.Random(5)
    rows = lambda x: spark.createDataFrame(x, SCHEMA)
    state = {f"f{i}": [i, i + 100] for i in range(12)}
    store.save({"entries": rows([(f, n) for f, own in state.items() for n in own])}, root)
    shapes = set()
    for step in range(20):
        came = {f"f{rng.randrange(16)}": [step * 1000 + k for k in range(rng.randrange(1, 3))] for _ in range(2)} if step % 4 else {}
        gone = {f"f{rng.randrange(16)}" for _ in range(2)} - set(came)
        tables = {"entries": rows([(f, n) for f, own in came.items() for n in own])} if came else {}
        store.save_delta(spark, root, spark.createDataFrame([("entries", g) for g in gone] or [("metadata", "f1")], "table string, key string"), **tables)
        state = {f: own for f, own in state.items() if f not in gone} | came
        if step in (1, 6, 13, 19):
            assert read(spark, root) == sorted((f, n) for f, own in state.items() for n in own)
            shapes.add(scans_and_shuffles(spark, root))
    assert len(shapes) == 1 and next(iter(shapes))[0] == 3  # base, what came, what went: whatever number of deltas
    assert store.compact_many(spark, root, 20) is None and store.compact_many(spark, root, 19) == store.snapshots(spark, root)[-1]
    assert store.compact_many(spark, root, 0) is None  # nothing is laid over it, of tables that were never written either
    assert store.layers(spark, root, "entries")[1] == [] and read(spark, root) == sorted((f, n) for f, own in state.items() for n in own)


def test_a_delta_that_ends_after_a_compaction_counts(small, tmp_path):
    spark, root = small, str(tmp_path / "s")
    rows = lambda *x: spark.createDataFrame(x, SCHEMA)
    store.save({"entries": rows(("a", 1), ("b", 2))}, root)
    slow = store.save_delta(spark, root, entries=rows(("a", 7)))
    marker = tmp_path / "s" / slow / "WHOLE"
    marker.unlink()  # its writer is still at work
    store.save_delta(spark, root, entries=rows(("c", 3)))
    whole = store.compact(spark, root)
    assert read(spark, root) == [("a", 1), ("b", 2), ("c", 3)] and whole > slow
    marker.touch()
    assert read(spark, root) == [("a", 7), ("b", 2), ("c", 3)]
    store.compact(spark, root)
    store.prune(spark, root, 1)
    assert read(spark, root) == [("a", 7), ("b", 2), ("c", 3)] and len(store.snapshots(spark, root)) == 1


def test_columns_and_tables_that_some_layers_lack(small, tmp_path):
    spark, root = small, str(tmp_path / "s")
    store.save_delta(spark, root, entries=spark.createDataFrame([("a", 1)], SCHEMA))
    assert read(spark, root) == [("a", 1)] and store.load(spark, root, "suppressions") is None
    store.save({"entries": spark.createDataFrame([("b", 2)], SCHEMA), "suppressions": spark.createDataFrame([("h",)], "hash string")}, root)
    store.save_delta(spark, root, entries=spark.createDataFrame([("c", 3, "x")], SCHEMA + ", more string"))
    store.save_delta(spark, root, entries=spark.createDataFrame([("d", 4)], SCHEMA))
    assert {tuple(r) for r in store.load(spark, root, "entries").select("file_path", "more").collect()} == {("b", None), ("c", "x"), ("d", None)}
    store.save({"entries": spark.createDataFrame([], SCHEMA)}, root)
    assert read(spark, root) == [] and store.load(spark, root, "suppressions").count() == 1


def rows_read(df):
    """Rows that the scans of a collected query gave, and its result."""
    got = df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("Scan parquet"):
            n += p.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return got, n


@pytest.mark.parametrize("delta", [False, True])
def test_reads_by_key_take_few_row_groups(small, tmp_path, monkeypatch, delta):
    """40,000 entries in files of many row groups: one file, and one id, whose values lie anywhere, are a few groups."""
    monkeypatch.setattr(store, "ROW_GROUP", 128 << 10)
    spark, root = small, str(tmp_path / "s")
    rows = spark.range(0, 40_000, 1, 4).select(F.concat(F.lit("src/f"), (F.col("id") * 7919 % 4000).cast("string")).alias("file_path"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 32).alias("unit_id"), F.sha2(F.concat(F.lit("c"), F.col("id").cast("string")), 512).alias("code"))
    store.save({"entries": rows}, root)
    if delta:
        store.save_delta(spark, root, entries=spark.createDataFrame([("src/f9", "u", "c")], "file_path string, unit_id string, code string"))
    e = store.load(spark, root, "entries")
    own, n = rows_read(store.file_entries(e, "src/f8"))
    assert len(own) == 10 and n < 12_000
    wanted = own[3].unit_id
    one, n = rows_read(store.entry(e, wanted))
    assert [r.file_path for r in one] == ["src/f8"] and n < 12_000
    none, n = rows_read(store.entry(e, "not an id"))
    assert none == [] and n < 6_000
    assert e.count() == (39_991 if delta else 40_000)
