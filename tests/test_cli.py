from tessera.__main__ import main
from tessera.sources import store

ADD = "def add(a, b):\n    c = a + b\n    return c\n"


def test_index_to_check(spark, tmp_path, capsys):
    root, base = tmp_path / "root", str(tmp_path / "store")
    root.mkdir()
    for name, text in {"a.py": ADD, "b.py": ADD.replace("add", "plus"), "c.py": "for i in x:\n    pass\n", "skip.py": ADD}.items():
        (root / name).write_text(text)
    (root / ".tesseraignore").write_text("skip.py\n")
    run = lambda *a: (main(list(a), spark), capsys.readouterr().out)
    assert run("duplicates", base) == (1, "no index\n")
    assert run("index", base, str(root))[1].endswith("2 entries\n")
    out = run("duplicates", base)[1]
    assert out.count("\n") == 1 and "x2 a.py:add:L1-3 b.py:plus:L1-3" in out
    assert run("check", base, str(root / "skip.py"))[1] == "STOP\n"
    assert " consolidate " in run("recommend", base)[1]
    assert run("duplicates", base, "--json")[1].startswith('{"hash": ') and run("doctor")[1].count("\n") == 7
    assert run("compare", str(root / "a.py"), str(root / "b.py"))[1] == "equivalent\n"
    run("index", base, str(root))
    run("index", base, str(root))
    assert len(store.snapshots(spark, base)) == 3
    store.prune(spark, base)
    assert len(store.snapshots(spark, base)) == 2 and store.load(spark, base, "entries").count() == 2
