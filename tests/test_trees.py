"""Trees, hashes and labels on the survey's fixture shapes."""

import ast
import itertools
import random

import pytest

from tessera.operators import extract, labels, trees


def py(code):
    return trees.wl_hash(trees.python_tree(code))


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("def f(x):\n    return x + 1", "def g(y):\n    return y + 1", True),
        ("def f(x):\n    return x", "def f(x):\n    y = x\n    return y", False),
        ("def f(a):\n    for i in a:\n        print(i)", "def g(b):\n    for k in b:\n        print(k)", True),
        ("a + b", "a * b", False), ("x = 1", "x = '1'", False), ("a < b", "a > b", False),
    ],
)
def test_hash_equality(a, b, same):
    assert (py(a) == py(b)) == same
    assert (trees.canonical_hash(trees.python_tree(a)) == trees.canonical_hash(trees.python_tree(b))) == same


def test_empty_and_broken_code():
    assert trees.python_tree("def ::::") == ([], []) and trees.wl_hash(([], [])) == trees.fingerprint(([], [])) == "empty"
    assert trees.hierarchy(([], [])) == ["empty"] * 5 and len(trees.hierarchy(trees.python_tree("x"))) == 5


OPS = ["a+b", "a-b", "a*b", "a/b", "a//b", "a%b", "a**b", "a@b", "a<<b", "a>>b", "a|b", "a^b", "a&b", "a==b", "a!=b", "a<b", "a<=b", "a is b", "a is not b", "a in b", "a not in b", "not a", "-a", "+a", "~a", "a and b", "a or b", "x += 1", "x @= 1", "a < b <= c"]


class Plain(ast.NodeTransformer):
    """Puts one operator of each kind in place of all."""

    def generic_visit(self, node):
        super().generic_visit(node)
        for base, one in ((ast.operator, ast.Add), (ast.cmpop, ast.Eq), (ast.unaryop, ast.Not), (ast.boolop, ast.And)):
            if isinstance(node, base):
                return one()
        return node


@pytest.mark.parametrize("code", OPS)
def test_patterns_do_not_see_operators(code):
    def pattern(source):
        t = trees.python_tree(source)
        return trees.pattern_of(t[0], "python"), t[1]

    assert trees.wl_hash(pattern(code)) == trees.wl_hash(pattern(ast.unparse(ast.fix_missing_locations(Plain().visit(ast.parse(code))))))
    assert pattern(code)[0] != trees.python_tree(code)[0]


def isomorphic(a, b, v=0, w=0):
    if a[0][v] != b[0][w]:
        return False
    x, y = ([k for k, p in enumerate(t[1]) if p == n] for t, n in ((a, v), (b, w)))
    return len(x) == len(y) and any(all(isomorphic(a, b, i, j) for i, j in zip(x, order)) for order in itertools.permutations(y))


def test_canonical_form_is_isomorphism():
    rng = random.Random(3)

    def tree():
        n = rng.randint(1, 6)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        return [rng.choice("ab") for _ in range(n)], parents

    for _ in range(600):
        a, b = tree(), tree()
        assert isomorphic(a, b) == (trees.canonical_hash(a) == trees.canonical_hash(b))


def test_line_trees():
    t = trees.line_tree("function f() {\n  if (a == 1) {\n    run();\n  }\n}\n}\nx = 1")
    assert t == (["Module", "FunctionDecl", "IfStmt:Op(==)", "CallStmt", "Stmt", "Stmt", "Stmt", "AssignStmt"], [-1, 0, 1, 2, 1, 0, 0, 0])
    assert labels.line_label('s = "a + b"') == "AssignStmt" and labels.line_pattern("IfStmt:Op(<)") == "IfStmt:Op"


SOURCE = '''
class A:
    @deco
    def m(self, xs):
        for x in xs:
            if x:
                while x:
                    with x:
                        pass
        return xs

async def g():
    async with a:
        pass
    async for b in c:
        pass
    try:
        pass
    except E:
        if q:
            pass
    match a:
        case 1:
            if z:
                pass
'''


def test_python_units():
    rows = list(extract.python_units(SOURCE, "f.py"))
    got = {(r[2], r[3], r[6]) for r in rows}
    assert {("A", "class", None), ("m", "method", None), ("g", "function", None), ("m.for_1", "block", 1), ("m.for_1.if_1", "block", 2), ("m.for_1.if_1.while_1", "block", 3), ("g.async_with_1", "block", 1), ("g.async_for_1", "block", 1), ("g.try_1", "block", 1), ("g.match_1", "block", 1)} == got
    assert next(r for r in rows if r[2] == "m")[10].startswith("def m(") and next(r for r in rows if r[2] == "m.for_1")[7] is None
    assert list(extract.python_units("def ::::")) == []
