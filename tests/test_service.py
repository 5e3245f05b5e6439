"""The engine as a service, reports, suppressions, gates, the store, paths, storms."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import content, extract, maintenance, recommend, report, trees
from tessera.operators import duplicates as dup
from tessera.sources import paths, scan, store
from tessera.streaming import events, storms

BODY = "    total = 0\n    for x in items:\n        if x > limit:\n            total = total + x\n    return total\n"
ADD = "def add_all(items, limit):\n" + BODY


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "home" / "user" / "project"
    for name, text in {"a.py": ADD, "lib/b.py": ADD.replace("add_all", "sum_all"), "lib/c.py": ADD.replace("+", "-"), "tests/test_d.py": "def test_one():\n    assert f(1) == 2\n    assert g(2) == 3\n", "vendor/x.py": ADD, "notes.txt": "n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / paths.IGNORE).write_text("vendor/\n")
    return root


def test_life_of_a_project(spark, tmp_path, project):
    e = Engine(spark, str(tmp_path / "store"), None)
    assert e.status().startswith("**Idle**") and e.call("analyze") == "No codebase indexed yet." and e.call("nothing") == "Unknown tool: nothing"
    assert e.call("index_codebase", {"path": str(project)}).startswith("Indexed 4 code units from 4 files.\nExtracted 6 code blocks.")
    assert e.status().startswith("**Ready** — 4 code units across 4 files.")
    said = e.call("analyze")
    assert "duplicate groups**" in said and "exact" in said and "pattern" in said
    text = e.resource("tessera://analysis/latest")
    assert "a.py:add_all:L1-6, lib/b.py:sum_all:L1-6 (6 lines)" in text and "Keep: a.py:add_all:L1-6 (shallowest path)" in text
    assert e.analysis().count() and (e.hits, e.misses) == (1, 1)
    assert e.call("check", {"code": ADD.replace("items", "things")}).startswith("STOP: Identical python code exists at a.py:add_all (lines 1-6).")
    assert "Unsupported" in e.call("check", {"code": "x", "language": "cobol"}) and e.call("recommend").startswith("1. extract_utility: a.py:add_all:L1-6, lib/b.py:sum_all:L1-6")
    # writing and editing
    assert e.call("write", {"file_path": str(project / "new.py"), "content": ADD}).startswith("BLOCKED: Cannot write - identical code exists at a.py:add_all (lines 1-6).")
    assert not (project / "new.py").exists()
    assert e.call("write", {"file_path": str(project / "new.py"), "content": "y = 2\n"}) == "Created new.py (1 lines)"
    assert e.call("write", {"file_path": str(project / "n.md"), "content": "z"}).startswith("NOTE: No language plugin") and "outside" in e.call("write", {"file_path": str(tmp_path / "o.py"), "content": ""})
    edit = lambda old, new, file="a.py": e.call("edit", {"file_path": str(project / file), "old_string": old, "new_string": new})
    assert edit("nothing", "x").startswith("Edit failed: old_string not found") and edit("    return total\n", ADD).startswith("BLOCKED: Cannot edit - identical code exists at lib/b.py")
    assert edit("return total", "return total + 1") == "Edited a.py\n  Changed 1 line\n     5              total = total + x\n     6 -    return total\n     6 +    return total + 1\n     7  " or (project / "a.py").read_text().endswith("return total + 1\n")
    # staleness, incremental step
    stale = e.call("check_staleness")
    assert "Modified (1):\n  - a.py" in stale and "New files (1):\n  - new.py" in stale
    (project / "lib/c.py").unlink()
    assert "(1 added, 1 updated, 2 unchanged, 1 removed)" in e.call("sync") and e.call("check_staleness") == "Index up to date."
    assert {r.file_path for r in e.table("metadata").collect()} == {"a.py", "lib/b.py", "new.py", "tests/test_d.py"}
    # events
    at = datetime(2024, 1, 1)
    (project / "lib/b.py").write_text("def other():\n    pass\n")
    batch = [(at, "lib/b.py", "modified"), (at, "new.py", "deleted"), (at, "vendor/x.py", "modified"), (at, "q.txt", "created")]
    e.handle(spark.createDataFrame(batch, "ts timestamp, path string, event_type string"))
    assert {r.name for r in e.table("entries").where("unit_type <> 'block'").collect()} == {"add_all", "other", "test_one"}
    e.storm()
    assert "Degraded" in e.status() and "Degraded" not in (e.sync(), e.status())[1]
    assert e.stats()["total_entries"] == e.table("entries").count() and e.stats()["snapshots"] > 3
    assert e.call("generate_ignore").endswith("exists already.") and "Nothing" not in e.call("metadata_erase") and e.call("metadata_erase") == "Nothing to erase."
    assert e.index_codebase("/").startswith("Refusing") and e.index_codebase("/no/such/folder").startswith("Path does not")
    assert e.complete("review-duplicates", "pa") == ["pattern"] and e.complete("x", "") == [] and "exact first" in e.prompt("review-duplicates", "exact")
    with pytest.raises(ValueError):
        e.resource("tessera://other")


def test_suppressions_live_and_end(spark, tmp_path, project):
    e = Engine(spark, str(tmp_path / "store"))
    e.index_codebase(str(project))
    h = dup.exact(e.table("entries")).first().group_hash
    assert e.call("suppress", {"wl_hash": [h, "nothing"], "reason": "why"}) == f"Suppressed {h}.\nNot found: nothing."
    row = maintenance.suppression(e.known(), h).first()
    assert (row.reason, row.source_name, row.entry_count, row.source_files) == ("why", "add_all", 2, ["a.py", "lib/b.py"]) and set(row.file_hashes) == {"a.py", "lib/b.py"} and row.code_preview == ADD.strip()[:200]
    assert [r.primary_file for r in maintenance.primary_file(e.known()).collect()] == ["a.py"]
    assert "exact" not in e.call("analyze") and "1 suppressed hashes" in e.call("list_suppressions")
    # an edit that keeps the structure moves the content's hash along
    (project / "a.py").write_text(ADD.replace("total", "whole"))
    assert "1 suppressed" in e.call("list_suppressions") and maintenance.suppression(e.known(), h).first().file_hashes["a.py"] != row.file_hashes["a.py"]
    (project / "lib/b.py").unlink()
    assert "1 suppressed" in e.call("list_suppressions") and maintenance.suppression(e.known(), h).first().source_files == ["a.py"]
    # one that ends it ends the suppression
    (project / "a.py").write_text("def f():\n    pass\n")
    assert e.call("list_suppressions").startswith(f"Suppressions invalidated: {h}. Run analyze().\n**No suppressions**")
    assert e.call("unsuppress", {"wl_hash": h}) == f"Not found: {h}."
    assert e.call("suppress", {"wl_hash": e.table("entries").first().wl_hash}).startswith("Suppressed") and e.call("unsuppress", {"wl_hash": e.known().first().hash}).startswith("Unsuppressed")


def units(spark, files):
    return maintenance.with_ids(trees.entries(extract.units(spark.createDataFrame([(p, scan.LANGUAGES[p.rpartition(".")[2]], t) for p, t in files.items()], "file_path string, language string, text string"))))


def test_findings_of_all_kinds(spark):
    loop = "def {n}(items):\n    for x in items:\n        if x:\n            print(x, {k})\n            print(x, 2)\n    return {r}\n"
    big = "def {n}(a, b):\n    c = a + b\n    d = c * a\n    e = d - b\n    f = [a, b, c]\n    g = (d, e)\n    if a:\n        if b:\n            if c:\n                h = {deep}\n    return f, g\n"
    e = units(spark, {"a/x.py": loop.format(n="one", k=1, r="items"), "a/b/y.py": loop.format(n="two", k=1, r="[items]"), "tests/p.py": "def t(a):\n    b = a + 1\n    return b\n", "tests/q.py": "def u(a):\n    b = a - 1\n    return b\n", "n1.py": big.format(n="n1", deep="1"), "n2.py": big.format(n="n2", deep="f(1)")})
    got = {(r.kind, r.size): r for r in report.findings(e).collect()}
    assert {k for k, _ in got} == {"block", "pattern", "near"} and got["block", 2].block_type == "for" and got["block", 2].parents == ["one", "two"] and got["block", 2].verified and got["block", 2].line_count == 4
    assert got["pattern", 2].is_test and got["pattern", 2].verified is None and got["near", 2].locations == ["n1.py:n1:L1-11", "n2.py:n2:L1-11"]
    text = report.report_text(report.findings(e), 3)
    assert text.startswith("=== Source code ===\n\n1. [for] (verified) a/b/y.py:two.for_1:L2-5") and "=== Tests ===" in text and text.endswith("+ 3 suppressed\n4 duplicate groups.") or "[for]" in text
    assert {r.kind: r.lines for r in report.summary_table(report.findings(e)).where("not is_test").collect()}["near"] == 22
    assert report.report_text(report.findings(e.where("false"))) == "**No significant duplicates.**" and "Source" in report.summary_text(report.findings(e))
    many = units(spark, {f"d{i}.py": ADD for i in range(8)})
    assert "... +3 more (6 lines)" in report.report_text(report.findings(many)) and report.findings(many).where("keep is not null").count() == 0
    s = report.stats(many).first()
    assert (s.total_entries, s.function_entries, s.block_entries, s.unique_hashes, s.indexed_files) == (24, 8, 16, 1, 8)


def test_records_of_entries(spark):
    e = units(spark, {"a.py": "class K:\n    def m(self):\n        return 1\n"})
    back = report.entries_from_json(report.entries_to_json(e))
    cols = ["unit_id", "wl_hash", "name", "parent_name", "line_end", "hierarchy", "block_type"]
    assert sorted(map(tuple, back.select(*cols).collect()), key=str) == sorted(map(tuple, e.select(*cols).collect()), key=str)
    old = spark.createDataFrame([('{"unit_id":"1","wl_hash":"w","unit":{"name":"f"}}',)], "data string")
    r = report.entries_from_json(old).first()
    assert (r.pattern_hash, r.language, r.parent_name) == ("w", "python", None)
    place = e.where("name = 'm'").select(report.location_record().alias("a"), report.location_record(True).alias("b")).first()
    assert place.a == '{"file":"a.py","name":"m","type":"method","lines":"2-3","parent":"K"}' and '"code":"def m' in place.b
    assert spark.range(1).select(report.relative(F.lit("/r/a/b"), "/r").alias("x"), report.relative(F.lit("/q"), "/r/").alias("y")).first() == ("a/b", "/q")


def test_recommendations_in_words(spark):
    e = units(spark, {"get_user_name.py": ADD.replace("add_all", "get_user_name"), "b.py": ADD.replace("add_all", "getUserMail"), "c.py": ADD.replace("add_all", "fetch_user")})
    g = dup.exact(e)
    own = dup.code_units(e)
    r = recommend.described(recommend.recommend(own, "wl_hash", g)).first()
    assert (r.action, r.size, r.lines, r.lines_saved, r.keep, r.files) == ("consolidate", 3, 6, 12, None, 3)
    assert r.summary == "Consider consolidating 3 duplicates within the same directory" and "3 identical implementations" in r.rationale and r.evidence[0].startswith("3 structurally identical") and r.evidence[4] == "All instances are in production code" and len(r.evidence) == 5
    assert recommend.suggested_names(own, "wl_hash", g).first().suggested_name == "user_get"
    assert '"action":"consolidate"' in recommend.compact(recommend.described(recommend.recommend(own, "wl_hash", g))).first().json
    none = units(spark, {"a.py": "class A:\n" + "".join("    " + x + "\n" for x in ADD.splitlines()), "d/b.py": ADD})
    assert recommend.recommend(dup.code_units(none), "wl_hash", dup.exact(none)).where("action = 'extract_base_class'").count() == 0
    assert recommend.report_lines(recommend.recommend(own.where("false"), "wl_hash", g), spark.createDataFrame([], "group_hash string, places array<string>")) == ["No refactoring opportunities identified."]


def test_content_against_the_index(spark):
    e = units(spark, {"a.py": ADD, "b.js": "function f(a) {\n  let b = a;\n  return b;\n}\n"})
    rows = [(1, "n.py", "python", "import os\n\n" + ADD), (2, "a.py", "python", ADD), (3, "x.py", "python", "  "), (4, "y.zz", None, ADD), (5, "z.py", "python", None)]
    contents = spark.createDataFrame(rows, "content_id long, file_path string, language string, text string")
    assert {(r.content_id, r.probe_id) for r in content.snippets(contents).where("content_id < 4").collect()} == {(1, "1:0"), (1, "1:1"), (2, "2:0")}
    found = content.matches(contents, e)
    assert {(r.content_id, r.match) for r in found.where("name = 'add_all' and content_id < 3").collect()} == {(1, "exact"), (2, "exact")}
    assert {r.content_id: r.decision for r in content.gate(contents, found).collect()} == {1: "BLOCKED", 2: "BLOCKED", 3: "WRITE", 4: "SKIPPED", 5: "WRITE"}
    assert {r.content_id: r.decision for r in content.gate(contents, found, editing=True).collect()}[2] == "WARNING"
    probes = spark.createDataFrame([("p", "c", "function f(a) {\n  let b = a;\n  return b;\n}\n")], "probe_id string, language string, code string")
    assert dup.exact_matches(trees.entries(probes), e).count() == 0
    hint = content.assist(contents.where("content_id = 1"), found.withColumns({"language": F.lit("go"), "same_language": F.lit(False)}))
    assert "ASSIST" in content.assist_text(hint) and content.assist_text(hint.where("false")) == ""
    assert content.compare(spark, "a + b", "c + d", "python") == "EQUIVALENT: The code snippets are structurally identical." and content.compare(spark, "a + b", "a", "python").startswith("DIFFERENT")
    assert "SEMANTIC_MATCH" in content.compare(spark, "a + b", "c + d", "python", "annotate") and content.compare(spark, "def (", "def [", "python", "differentiate").startswith("INCONCLUSIVE") and content.compare(spark, "x", "y", "go", "odd").startswith("Invalid")
    assert content.compare(spark, "def f(a: int):\n    return a + 1", "def f(a: str):\n    return a + 1", "python", "differentiate").startswith("DIFFERENT: Structurally equivalent snippets diverge semantically (python.plus_binding")
    hashes = spark.createDataFrame([(e.where("name = 'add_all'").first().pattern_hash,), ("none",)], "hash string")
    assert {r.bucket for r in dup.bucket(e, hashes).collect()} <= {"exact", "pattern"} and dup.bucket(e, hashes).count() == 1
    same, other = dup.by_language(dup.similar(trees.entries(content.snippets(contents.where("content_id = 1"))), e), e, F.lit("python"))
    assert same.count() >= 1 and other.count() == 0 and dup.verified(e, dup.exact(e.union(e)), "wl_hash").where("verified").count() == dup.exact(e.union(e)).count()


def test_store_of_snapshots_and_deltas(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = lambda *x: spark.createDataFrame(x, "file_path string, unit_id long")
    assert store.load(spark, root, "entries") is None and store.compact(spark, root) is None and not store.erase(spark, root)
    first = store.save({"entries": rows(("a", 1), ("b", 2))}, root)
    store.save_delta(spark, root, spark.createDataFrame([("entries", "b")], "table string, key string"), entries=rows(("a", 9), ("c", 3)))
    read = lambda **k: sorted(map(tuple, store.load(spark, root, "entries", **k).collect()))
    assert read() == [("a", 9), ("c", 3)] and read(snapshot=first) == [("a", 1), ("b", 2)]
    whole = store.compact(spark, root)
    assert read() == [("a", 9), ("c", 3)] and whole == store.snapshots(spark, root)[-1]
    e = store.load(spark, root, "entries")
    assert store.file_entries(e, "c").count() == 1 and store.entry(e, 9).first().file_path == "a" and store.some_entries(e, rows(("x", 3))).count() == 1 and store.size(spark, root) > 0
    assert {r.key: r.value for r in store.index_metadata(e, 5.0).collect()}["file_count"] == "2" and store.indexed_files(e).count() == 2
    (part,) = (tmp_path / "s" / whole / "entries").glob("part-*0.*parquet") if len(list((tmp_path / "s" / whole / "entries").glob("part-*0.*parquet"))) == 1 else [next((tmp_path / "s" / whole / "entries").glob("part-*.parquet"))]
    for f in (tmp_path / "s" / whole / "entries").glob("*.parquet"):
        f.write_bytes(b"damaged")
    assert store.quarantine(spark, root) == [whole] and read() == [("a", 9), ("c", 3)]
    store.save({"entries": rows(("z", 1))}, root)
    store.prune(spark, root, 1)
    assert len(store.snapshots(spark, root)) == 1 and read() == [("z", 1)] and store.erase(spark, root)
    with pytest.raises(ValueError):
        store.save_delta(spark, root)


def test_paths(tmp_path, monkeypatch):
    assert paths.project_key("/a/my proj") == paths.project_key("/a/my proj") and paths.project_key("/a/my proj").startswith("my_proj-") and paths.project_key("/").startswith("root-")
    env = {"HOME": "/h"}
    assert str(paths.data_home(env, "linux")) == "/h/.local/share/tessera" and str(paths.data_home(env, "darwin")).endswith("Application Support/tessera") and str(paths.data_home({"XDG_DATA_HOME": "/x"})) == "/x/tessera"
    assert paths.store_path("/r", {"TESSERA_STORE": "s3://b/"}).startswith("s3://b/r-") and paths.table_path("/r", "t", {"HOME": "/h"}).endswith("/t")
    with pytest.raises(ValueError):
        paths.store_path(" ")
    assert paths.generate_ignore(str(tmp_path))[0] and not paths.generate_ignore(str(tmp_path))[0] and "vendor/" in paths.read_ignore(str(tmp_path)) and paths.read_ignore(str(tmp_path / "no")) is None
    (tmp_path / paths.FOLDER).mkdir()
    assert paths.migrate(str(tmp_path), str(tmp_path / "new" / "place")) and not paths.migrate(str(tmp_path), str(tmp_path / "other")) and paths.own_file("a/.tessera/x") and not paths.own_file("a/b")
    assert paths.within(str(tmp_path / "a"), str(tmp_path)) and not paths.within(str(tmp_path), str(tmp_path / "a"))
    assert paths.workspace({"TESSERA_WORKSPACE": str(tmp_path)}) == str(tmp_path)
    assert paths.write_file("/no/such/x", "t").startswith("Failed")
    (tmp_path / "Dropbox" / "p").mkdir(parents=True)
    assert paths.cloud_synced(str(tmp_path / "Dropbox" / "p"), str(tmp_path)) == (True, "Dropbox") and paths.cloud_synced("/elsewhere", str(tmp_path)) == (False, None)
    b = str(tmp_path / "b.json")
    assert paths.load_bindings(b) == {} and paths.bind("go", "gopls serve", b) == ["gopls", "serve"] and paths.load_bindings(b) == {"go": ["gopls", "serve"]}
    assert paths.server_command("go", ["x"], b, "V", {}) == (["gopls", "serve"], "binding") and paths.server_command("c", ["x"], b, "V", {"V": "y z"}) == (["y", "z"], "env") and paths.server_command("c", ["x"], b, "V", {}) == (["x"], "default")
    assert paths.unbind("go", b) and not paths.unbind("go", b) and paths.endpoint("tcp://h:80") == {"transport": "tcp", "host": "h", "port": 80} and paths.endpoint("unix:///s") == {"transport": "unix", "path": "/s"} and paths.endpoint("tcp://h:bad") is None and paths.endpoint("a b") is None
    assert paths.candidates([("binding", "a b"), ("env", None)], [("default", ["a", "b"]), ("default", "c")]) == [("binding", ["a", "b"]), ("default", ["c"])]
    with pytest.raises(ValueError):
        paths.bind("go", "", b)


def test_storms_and_waiting():
    s = storms.Storm(limit=3, window=1.0, cooldown=5.0)
    assert [s.admit(t / 10) for t in range(5)] == [True, True, True, False, False] and s.quarantined(5.2) and not s.quarantined(5.3)
    assert s.admit(5.4) and [s.admit(9 + t) for t in range(6)] == [True] * 6
    p = storms.Pending(0.1, 2)
    assert p.add("a", 0) and p.add("b", 0.05) and not p.add("c", 0.05) and p.add("a", 0.08)
    assert p.take(0.12) == [] and p.next() == pytest.approx(0.15) and p.take(0.16) == ["b"] and p.take(1) == ["a"] and p.next() is None
    p.add("d", 2)
    p.shutdown()
    assert p.due == {} and not p.add("e", 3)
    g = storms.Governor(1)
    assert g.acquire("r") and g.acquire("r") and not g.acquire("q")
    g.release("r")
    assert g.acquire("q")

    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    w = storms.Watchers(storms.Governor(1))
    q = w.watch("r", Query)
    assert w.watch("r", Query) is q and w.watch("s", Query) is None and w.watching("r") and w.unwatch("r") and not q.isActive and not w.unwatch("r")
    with pytest.raises(ZeroDivisionError):
        w.watch("r", lambda: 1 / 0)
    assert w.watch("s", Query) and (w.stop_all(), w.queries)[1] == {}


def test_events_in_batch_and_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("r", i, at + timedelta(milliseconds=100 * i), f"f{i % 3}.py", "modified") for i in range(8)] + [("q", 100, at, "a.py", "modified"), ("q", 101, None, "b.py", "modified")]
    ev = spark.createDataFrame(rows, "root string, event_id int, ts timestamp, path string, event_type string").repartition(3)
    got = {r.event_id: r.admitted for r in storms.admitted(ev, 4, 1.0, 0.25).collect()}
    s = storms.Storm(4, 1.0, 0.25)
    assert got == {i: s.admit(at.timestamp() + 0.1 * i) for i in range(8)} | {100: True, 101: True}
    assert [(r.root, r.suppressed) for r in storms.quarantines(ev, 4, 1.0, 0.25).collect()] == [("r", sum(not v for v in got.values()))]
    ev.where("ts is not null").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    out, seen = storms.admit_stream(stream, 4, 1.0, 0.25), []
    events.keep_current(out, lambda b, _: seen.extend((r.root, r.path, round(r.t - at.timestamp(), 3)) for r in b.collect()), f"{tmp_path}/c1").awaitTermination()
    assert len(seen) == sum(v for i, v in got.items() if i != 101)
    waits, flushed = storms.debounce_stream(stream.selectExpr("root", "path", "unix_micros(ts) / 1e6 AS t"), 0.25), []
    query = waits.writeStream.foreachBatch(lambda b, _: flushed.extend((r.root, r.path) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c2").outputMode("append").trigger(processingTime="300 milliseconds").start()
    end = time.time() + 60
    while time.time() < end and len({*flushed}) < 4:
        time.sleep(0.3)
    query.stop()
    assert {*flushed} == {("r", "f0.py"), ("r", "f1.py"), ("r", "f2.py"), ("q", "a.py")}
    table = spark.createDataFrame([(at, "a.py", "modified", None, False), (at, "b.txt", "created", None, False), (at, "venv/c.py", "created", None, False), (at, "d.py", "moved", "e.py", False), (at, "g/f.py", "deleted", None, False), (at, "h.py", "created", None, True), (at, ".tessera/i.py", "created", None, False)], "ts timestamp, path string, event_type string, dest_path string, is_directory boolean").drop("is_directory")
    again, gone = events.routed(events.watched(table, ["g/"]))
    assert sorted(r.path for r in again.collect()) == ["a.py", "e.py", "h.py"] and [r.path for r in gone.collect()] == ["d.py"]
    b, n = (spark.createDataFrame(x, "path string, mtime double, size long") for x in ([("a", 1.0, 1), ("b", 1.0, 1), ("c", 1.0, 1)], [("a", 1.0, 1), ("b", 2.0, 1), ("d", 1.0, 1)]))
    assert sorted(map(tuple, events.listing_changes(b, n).collect())) == [("b", "modified"), ("c", "deleted"), ("d", "created")]


def test_bursts_over_slices(spark):
    at = datetime(2024, 1, 1, 23, 59, 50)
    seconds = [0, 5, 9, 12, 30, 31, 86_395, 86_405, 86_500]
    ev = spark.createDataFrame([(i, at + timedelta(seconds=s), "p", "modified") for i, s in enumerate(seconds)] + [(90, None, "p", "x"), (91, at, None, "x")], "event_id int, ts timestamp, path string, event_type string")
    for size in (10, 60, 86_400):
        got = sorted(((r.first - at).total_seconds(), (r.last - at).total_seconds(), r.n) for r in events.bursts(ev, 10, size).collect())
        assert got == [(0, 12, 4), (30, 31, 2), (86_395, 86_405, 2), (86_500, 86_500, 1)]
