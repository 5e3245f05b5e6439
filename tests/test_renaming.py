import ast
import inspect
import random
import re

import pytest

from tessera.languages import javascript as js
from tessera.operators import extract, trees
from tessera.plans import catalog, corpus

TEXTS = [
    "function f(a, b) {\n  for (let i of b) {\n    a.get = async (x) => await x / a / g;\n  }\n  return /a[b]c/gi.test(\"f it's\") ? f : {get a() { return 1e5; }, set(b) {}};\n}",
    "class K extends B.C {\n  static async *m(a = 1) { yield* a; }\n  'two words'(x) { if (x in this) { y(); } }\n  constructor() { super(); }\n  get p() { return 0x1F; }\n}\n// a comment's f\nvar g = function () { while (k) { try { k--; } catch (e) { } } };",
    "a: for (;;) { if (async) break a; let = yield + of; }",
    "obj.prop = (a, b) => { switch (a) { case 'b': return; } };",
    "const été = function () { do { x‌y(); } while (été); };",
    "var $a = `t ${b}`; function \\u0061b() { if (a) { } }",
    "interface I { a: string }\nexport function f<T>(a: T[], b?: number): a is T {\n  for (const x of a as T[]) { use(x!); }\n  return a[0];\n}",
    "function broken(a { if (b) { }",
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("typed", [False, True])
def test_renamed_texts_have_the_same_structure_and_names(text, typed):
    language = "typescript" if typed else "javascript"
    assert js.structure(js.bare(text)[0], typed) == js.structure(text, typed)
    plain = js.outline(text, typed, 3)
    found = js.units(text, "p", language, 3)
    assert (found is None) == (plain is None)
    if plain is not None:
        assert [(r[2], r[3], r[4], *r[5:10]) for r in found] == plain
    rng = random.Random(3)
    for _ in range(40):  # with tokens taken away most can't be read, in either form
        words = re.findall(r"\w+|\s+|.", text)
        del words[rng.randrange(len(words))]
        cut = "".join(words)
        assert js.structure(js.bare(cut)[0], typed) == js.structure(cut, typed)


def test_names_that_the_grammar_compares_are_known():
    compared = {n.value for c in (js.Parser, js.Typed) for n in ast.walk(ast.parse(inspect.getsource(c))) if isinstance(n, ast.Constant) and isinstance(n.value, str) and re.fullmatch("[a-z]+", n.value)}
    fields = set("annotation argument bad elements end expressions items left line method name num op operator properties right str unexpected value word wrapped".split())
    assert compared - fields - {"any"} <= js.RESERVED | js.KNOWN


def test_texts_that_differ_in_names_are_parsed_once(monkeypatch):
    calls, parse = [], js.parse
    monkeypatch.setattr(js, "parse", lambda *a: calls.append(a) or parse(*a))
    for n in range(50):
        text = f"function once{n}(a) {{\n  if (a > 7) {{\n    q{n}(a, `x`.length, 1);\n  }}\n}}".replace("`x`", "v")
        rows = extract.text_units(text, "p", "javascript")
        assert [r[2] for r in rows] == [f"once{n}", f"once{n}.if_1"] and rows[0][10] == text
        trees.describe(rows[0][10], "javascript")
    assert len(calls) <= 2


def test_parts_are_dealt_to_all_tasks(spark):
    sf = "/root/testdata/sf0.01"
    few, many = corpus.part_files(spark, sf), corpus.part_files(spark, sf, dealt=True)
    assert many.rdd.getNumPartitions() == 8 and sorted(few.collect()) == sorted(many.collect())
    assert "hashpartitioning(p_partkey" in catalog.javascript_dups(spark, sf)._jdf.queryExecution().toString()
