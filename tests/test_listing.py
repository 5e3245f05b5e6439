import os

from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import labels, maintenance
from tessera.sources import scan
from tessera.streaming import events as ev


def tree(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


def test_rounds_of_a_frontier(spark, tmp_path):
    files = {f"a{i}/b{j}/c/f{i}_{j}.py": "x" for i in range(12) for j in range(6)} | {"vendor/x.go": "", "a1/out/y.c": "", "a2/note.txt": "", "a3/GEN/z.ts": "", "a3/keep.TS": ""}
    tree(tmp_path, files)
    want = sorted(p for p in files if not p.startswith("vendor") and "/out/" not in p and "GEN" not in p and not p.endswith("txt"))
    for budget in (1, 3, 1000):
        rows = scan.listing(spark, str(tmp_path), ["GEN/"], budget=budget).collect()
        assert sorted(r.file_path for r in rows) == want and all(r.mtime > 0 for r in rows)
    assert scan.listing(spark, str(tmp_path / "none")).count() == 0
    assert [r.file_path for r in scan.listing(spark, str(tmp_path / "a3"), recursive=False).collect()] == ["keep.TS"]


def test_only_named_files_are_opened(spark, tmp_path):
    tree(tmp_path, {"a.py": "x = 1", "b/c.js": "é"})
    (tmp_path / "bad.c").write_bytes(b"\xff\xfe")
    named = spark.createDataFrame([("a.py",), ("a.py",), ("b/c.js",), ("bad.c",), ("gone.py",), ("b",), (None,)], "file_path string")
    got = sorted((r.file_path, r.language, r.text) for r in scan.read(named, str(tmp_path)).collect())
    assert got == [("a.py", "python", "x = 1"), ("b/c.js", "javascript", "é"), ("bad.c", "c", None)]


def test_sync_opens_what_changed(spark, tmp_path):
    body = "def f{0}(a):\n    total = 0\n    for x in a:\n        total += x\n    return total\n"
    tree(tmp_path / "p", {f"m{i}.py": body.format(i) for i in range(6)})
    e = Engine(spark)
    e.index_codebase(str(tmp_path / "p"))
    what, opened = e.changes()
    assert opened.count() == 0 and {r.status for r in what.collect()} == {"unchanged"}
    (tmp_path / "p/m1.py").write_text(body.format(1) + "\n\ndef more(b):\n    if b:\n        return [b]\n    return []\n")
    (tmp_path / "p/m2.py").unlink()
    tree(tmp_path / "p", {"n.py": body.format(9)})
    os.utime(tmp_path / "p/m3.py", (5, 5))
    what, opened = e.changes()
    assert sorted(r.file_path for r in opened.collect()) == ["m1.py", "m3.py", "n.py"]
    full = maintenance.status(scan.files(spark, str(tmp_path / "p")), e.table("metadata"))
    assert sorted(map(tuple, what.drop("opened").collect())) == sorted(map(tuple, full.collect()))
    assert "(1 added, 1 updated, 4 unchanged, 1 removed)" in e.sync()
    assert "(0 added, 0 updated, 6 unchanged, 0 removed)" in e.sync()


def test_alike_units_get_ids_of_their_own(spark):
    rows = spark.createDataFrame([("a.py", "function", "f", 1, 2, "code")] * 3 + [("b.py", "function", "f", 1, 2, None)], "file_path string, unit_type string, name string, line_start int, line_end int, code string")
    ids = [r.unit_id for r in maintenance.with_ids(rows).collect()]
    assert len(set(ids)) == 4 and all(len(i) == 32 for i in ids) and sorted(ids) == sorted(r.unit_id for r in maintenance.with_ids(rows.repartition(4)).collect())


def test_storms_cut_anywhere(spark):
    times = [0, 0, 1, 5, 9, 10, 10, 10, 11, 20, 21, 30, 31, 31, 100] + [200 + i / 100 for i in range(500)] + [None]
    df = spark.createDataFrame([(None if t is None else float(t),) for t in times], "s double").select(F.expr("timestamp_micros(cast(s * 1000000 as bigint))").alias("ts"))
    known = [t for t in times if t is not None]
    for window, limit in ((10, 3), (1, 90), (3, 200)):
        n = [sum(t - window <= x <= t for x in known) for t in known]
        for parts in (1, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert tuple(ev.storm_peaks(df, window, limit).first()) == (sum(x > limit for x in n), max(n))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert tuple(ev.storm_peaks(df.where("false"), 5, 1).first()) == (0, None)


def test_events_of_one_time(spark):
    rows = spark.sql("select timestamp'2024-01-01' as ts, 'a' as path, e as event_type from values ('deleted'), ('created') as t(e)")
    again, gone = ev.routed(rows)
    assert again.count() == 1 and gone.count() == 0


def test_literals_and_numbers(spark):
    lines = ["x = 'it\\'s' + \"a'b\" * 2", "y = 1.5x + 3. + a1 - 2.50", 'z = "open + 1', "'' + \"\" == 'a\\\\'", "k = 'a\"' if \"'\" else 7"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in rows.select(labels.line_label_column(F.col("line"))).collect()]
    assert got == [labels.line_label(x) for x in lines] == ["AssignStmt:Op(+)", "AssignStmt:Op(+)", "AssignStmt:Op(+)", "Stmt:Op(==)", "AssignStmt"]
