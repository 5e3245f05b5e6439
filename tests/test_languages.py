"""Readers of languages: syntax trees of scripts, units by braces, symbols, plugins."""

import json

import pytest

from tessera.languages import braces, javascript, registry
from tessera.operators import extract, symbols, trees


def kinds(code, typed=False):
    got = javascript.tree(code, typed)
    return got and [(x, got[1][i]) for i, x in enumerate(got[0])]


def test_trees_follow_the_fields_in_order():
    assert kinds("var a = 1 + b;") == [("Program", -1), ("VariableDeclaration:var", 0), ("VariableDeclarator", 1), ("BinaryExpression:+", 2), ("Literal:int", 3), ("Identifier", 3), ("Identifier", 2)]
    assert [x for x, _ in kinds("for (let i = 0; i < n; i++) { f(i); }")] == ["Program", "ForStatement", "BlockStatement", "ExpressionStatement", "CallExpression", "Identifier", "Identifier", "VariableDeclaration:let", "VariableDeclarator", "Literal:int", "Identifier", "BinaryExpression:<", "Identifier", "Identifier", "UpdateExpression:++", "Identifier"]
    assert [x for x, _ in kinds("x = (a, b) => a && null;")][2:6] == ["AssignmentExpression:=", "Identifier", "ArrowFunction", "LogicalExpression:&&"]
    assert [x for x, _ in kinds("class A extends B { get x() { return 'a' } }")] == ["Program", "ClassDeclaration", "ClassBody", "MethodDefinition:get", "FunctionExpression", "BlockStatement", "ReturnStatement", "Literal:str", "Identifier", "Identifier", "Identifier"]
    assert [javascript.pattern_label(x) for x in ("BinaryExpression:+", "UpdateExpression:++", "Literal:int", "VariableDeclaration:let")] == ["BinaryExpression:Op", "UpdateExpression:Op", "Literal:int", "VariableDeclaration:let"]


GOOD = ["a\n++b", "x = /ab[/]c/g.test(y) / 2", "`a${b + `c${d}`}e`", "if (a) ; else b", "({a, b: 1, get c() { return 1 }, [d]: 2, e() {}, async f() {}, *g() { yield* h; yield }})", "var {a, b: {c}} = x; [a, ...b] = [b, a]; ({a = 1} = b)", "new Foo(1).bar[2]()", "do x++; while (x < 5) y", "label: for (;;) { break label }", "async x => await x; async (x) => x; async(1)", "for (const [k, v] of Object.entries(o)) {}", "for (var i in x) {}", "export default class {}", "import a, {b as c} from 'x'", "get = set + static1 * of; async.x()", "a = b ? (c, d) : e => f", "if (a) { /re/.test(b) } /x/g", "let x\nlet y", "f(...a)", "switch (a) { case 1: b(); default: }", "try { a() } catch (e) {} finally {}", "x = function* () { yield 1 }", "void 0, typeof a, delete b.c, -d ** 2 === 3 || (-d) ** 2"]
BAD = ["return 1", "a?.b", "class A { x = 1 }", "({...a})", "`open", "/* open", "var", "a b", "if (", "1 = 2", "const x;", "a ?? b", "function () {}"]


@pytest.mark.parametrize("code", GOOD[:-1])
def test_readable(code):
    assert javascript.parse(code)


@pytest.mark.parametrize("code", BAD)
def test_unreadable_falls_back_to_lines(code):
    assert javascript.parse(code) is None
    assert trees.tree_of(code, "javascript") == trees.line_tree(code)


TYPED = ["function f(a: number, b?: string, ...c: Array<number>[]): Promise<Map<string, number>> { return a as any; }", "interface A extends B { x: { y: string }; f(): void }\ntype T<U> = U | { a: 1 };\nenum E { A, B }\nnamespace N { const x = 1; }\nlet z: T<string> = g<number>(1)!.b;", "@Controller('x')\nclass C<T extends Foo> extends D<T> implements E, F<T> {\n @Inject() private readonly f(a: string): void { }\n constructor(private x: number, public readonly y: string = 'a') { super(); }\n}", "const f = (a: number, b: string): boolean => a > 1;", "export abstract class X { m<T>(a: T): a is string { return true } }", "declare module Foo;\nlet y = x satisfies Z;", "for (const a of b as string[]) { if (a < b && c > d) {} }", "let o = { a: b, c: d ? e : f };", "x = a ? (b) : c"]


@pytest.mark.parametrize("code", TYPED)
def test_types_are_passed_over(code):
    plain = javascript.strip_types(code)
    assert len(plain) == len(code) and [c == "\n" for c in plain] == [c == "\n" for c in code]
    assert javascript.tree(plain) == javascript.tree(code, True)
    assert javascript.strip_types("let x: ;") is None


def test_additions():
    assert javascript.plus_binding("1 + 2; a + b") == ("numeric", 0.9) and javascript.plus_binding("'a' + `b`") == ("str_concat", 0.9)
    assert javascript.plus_binding("1 + 2; 'a' + 'b'") == ("mixed", 0.6) and javascript.plus_binding("a + b") == ("unknown", 0.5) and javascript.plus_binding("a - b") is None
    assert javascript.plus_binding("function f(a: number, b: number = 2) { return a + b }", True) == ("numeric", 0.9)


def rows(code, language):
    return [(r[2], r[3], r[4], r[5], r[6], r[8], r[9]) for r in extract.text_units(code, "p", language)]


def test_script_units():
    code = "class A { m() { for (;;) {\n if (a) {\n b\n}\n} } }\nconst f = () => {\n while (x) {\n y()\n }\n}\nexport function g() { function h() { try {\n a() } catch (e) {} }\n}\no.p = function () {}"
    assert rows(code, "javascript") == [
        ("A", "class", None, None, None, 1, 5), ("m", "method", "A", None, None, 1, 5), ("m.for_1", "block", "m", "for", 1, 1, 5), ("m.for_1.if_1", "block", "m", "if", 2, 2, 4),
        ("f", "function", None, None, None, 6, 10), ("f.while_1", "block", "f", "while", 1, 7, 9), ("g", "function", None, None, None, 11, 13), ("g.try_1", "block", "g", "try", 1, 11, 12), ("h", "function", None, None, None, 11, 12), ("p", "function", None, None, None, 14, 14),
    ]
    assert [r[:2] for r in rows("class A {\n x = 1;\n m(a) {\n  if (a?.b) {\n   c()\n  }\n }\n}\nconst f = async (a) => {\n a?.b();\n};\n", "javascript")] == [("A", "class"), ("m", "method"), ("m.if_1", "block"), ("f", "function")]


SOURCES = {
    "c": ("#define X(a) { a\nstatic int add(int a, int b)\n{\n  // open {\n  for (int i = 0; i < b; i++) {\n    if (a > '{') {\n      a++;\n    } else {\n b();\n }\n  }\n  char *s = \"}\";\n do {\n x();\n } while (1);\n if (a) { one(); }\n  return a;\n}\nstruct P { int x; };\nint arr[] = {1,\n2};\nint main(void) { return 0; }\n", [("add", "function", None, None, None, 2, 18), ("add.for_1", "block", "add", "for", 1, 5, 11), ("add.for_1.if_1", "block", "add", "if", 2, 6, 8), ("add.do_while_1", "block", "add", "do_while", 1, 13, 15), ("P", "class", None, None, None, 19, 19), ("main", "function", None, None, None, 22, 22)]),
    "cpp": ("namespace n {\ntemplate <typename T>\nclass A : public B<T> {\npublic:\n  A(int x) : x_(x) {\n    init();\n  }\n  bool operator==(const A& o) const {\n    return true;\n  }\n};\nvoid A::run(int z) {\n try {\n f();\n } catch (E& e) {\n g();\n }\n}\n}\nauto l = [](int a) {\n return a;\n};\n", [("A", "class", None, None, None, 2, 11), ("A", "method", "A", None, None, 4, 7), ("operator==", "method", "A", None, None, 8, 10), ("run", "method", "A", None, None, 12, 18), ("run.try_1", "block", "run", "try", 1, 13, 15)]),
    "java": ('package a;\n@Service("x")\npublic class Foo extends Bar {\n  @Override\n  public <T> List<T> get(int a) throws E, F {\n    for (int x : xs) {\n        run(() -> {\n          go();\n        });\n    }\n    return new ArrayList<>() {\n void q() {\n }\n };\n  }\n  Foo()\n  {\n  }\n  enum Z { A, B }\n}\ninterface I {\n  default void m() {\n    switch (x) {\n case 1: break;\n }\n  }\n}\nrecord P(int x) {\n}\n', [("Foo", "class", None, None, None, 2, 20), ("get", "method", "Foo", None, None, 4, 15), ("get.for_1", "block", "get", "for", 1, 6, 10), ("Foo", "method", "Foo", None, None, 16, 18), ("I", "class", None, None, None, 21, 27), ("m", "method", "I", None, None, 22, 26), ("m.switch_1", "block", "m", "switch", 1, 23, 25), ("P", "class", None, None, None, 28, 29)]),
    "go": ("package main\nimport \"x\"\ntype T struct {\n  A int\n}\nfunc (s *T) M(a int) (int, error) {\n  for {\n    select {\n    case <-c:\n    }\n  }\n  go func() {\n }()\n}\nfunc G[T any](x T) error {\n  if (x) {\n y()\n }\n return nil\n}\n", [("T", "class", None, None, None, 3, 5), ("M", "method", "T", None, None, 6, 14), ("M.for_1", "block", "M", "for", 1, 7, 11), ("M.for_1.select_1", "block", "M", "select", 2, 8, 10), ("G", "function", None, None, None, 15, 20), ("G.if_1", "block", "G", "if", 1, 16, 18)]),
}


@pytest.mark.parametrize("language", list(SOURCES))
def test_brace_units(language):
    code, want = SOURCES[language]
    assert rows(code, language) == want


DECLARED = [
    ("cpp", "template <class T>\nclass V {\n void f() {\n }\n};", [("V", "class", None), ("f", "method", "V")]),
    ("cpp", "template <class T, class U = std::map<T, int>> struct P {\n};", [("P", "class", None)]),
    ("cpp", "template <template <class> class C, int N = (1 > 0)> class alignas(8) Q : public C<int> {\n};", [("Q", "class", None)]),
    ("cpp", "class EXPORT K final : public B {\n int g() const {\n return 1;\n }\n};", [("K", "class", None), ("g", "method", "K")]),
    ("cpp", "class API(x) [[nodiscard]] L {\n};\ntemplate <> struct H<int> {\n};\nstruct O::I {\n};", [("L", "class", None), ("H", "class", None), ("I", "class", None)]),
    ("cpp", "enum class Color : int {\n A, B\n};\nenum E { X };\nclass C { enum D { Y }; void h() {\n } };", [("C", "class", None), ("h", "method", "C")]),
    ("cpp", "template <class T> T top(T a) {\n return a;\n}\nclass T2 *made() {\n return 0;\n}", [("top", "function", None), ("made", "function", None)]),
    ("c", "struct P x = { 1, 2 };\nenum color f(void) {\n return 0;\n}\nstruct __attribute__((packed)) Q { int a; };\nstruct P *g(int a) {\n}", [("f", "function", None), ("Q", "class", None), ("g", "function", None)]),
    ("c", "int add(a, b)\n int a;\n char *b;\n{\n if (a) {\n a++;\n }\n}\nint x;\nstruct S { int y; };\nvoid last() {\n}", [("add", "function", None), ("add.if_1", "block", None), ("S", "class", None), ("last", "function", None)]),
    ("c", "MACRO(x) int a;\nint main(void) {\n}", [("main", "function", None)]),
    ("java", "public enum Z implements I {\n A(1) {\n  int f() {\n   return 1;\n  }\n }, B(2);\n final int n;\n Z(int n) {\n  this.n = n;\n }\n int g() {\n  return n;\n }\n}\nclass O {\n enum Y { C; void h() {\n } }\n void k() {\n }\n}\n@interface M {\n}", [("f", "method", None), ("Z", "method", None), ("g", "method", None), ("O", "class", None), ("h", "method", "O"), ("k", "method", "O"), ("M", "class", None)]),
]


@pytest.mark.parametrize("language, code, want", DECLARED)
def test_declarations(language, code, want):
    assert [(r[0], r[1], r[2] if r[1] != "block" else None) for r in rows(code, language)] == want


def test_cleaned_text_keeps_its_places():
    code = "a /* {\n */ b // }\n'\\'{' \"{\\\"\" `{\n`"
    got = braces.cleaned(code, "go")
    assert len(got) == len(code) and got.split() == ["a", "b"] and [i for i, c in enumerate(got) if c == "\n"] == [i for i, c in enumerate(code) if c == "\n"]
    assert "{" in braces.cleaned(code, "java") and len(braces.cleaned(code, "java")) == len(code)
    assert braces.matching("{(})[]")[4] == 5 and rows("", "c") == rows("}}}{{{", "java") == []


def test_depth_is_bounded():
    code = "void f() {\n" + "".join(f"{' ' * i}if (a) {{\n" for i in range(6)) + "}\n" * 7
    assert [r[4] for r in rows(code, "c")[1:]] == [1, 2, 3]


def test_symbols(spark):
    at = lambda a, b, c=1: {"start": {"line": a, "character": 0}, "end": {"line": b, "character": c}}
    nested = [{"name": "A", "kind": 5, "range": at(0, 3), "children": [{"name": "f", "kind": 12, "range": at(1, 2), "children": [{"name": "v", "kind": 13, "range": at(1, 1)}]}]}, {"name": "os", "kind": 12, "range": at(4, 5, 0)}, {"name": "late", "kind": 12, "range": at(90, 99)}]
    flat = [{"name": "g", "kind": 6, "location": {"range": at(0, 1)}}, "no symbol", {"name": "e", "kind": 10}]
    answers = spark.createDataFrame([("a.py", json.dumps(nested)), ("b.go", json.dumps(flat)), ("c.go", "no json"), ("d.go", None)], "file_path string, symbols string")
    found = symbols.symbols(answers)
    got = sorted((r.file_path, r.symbol_id, r.parent_id, r.name, r.unit_type, r.parent_name) for r in found.collect())
    assert got == [("a.py", 0, None, "A", "class", None), ("a.py", 1, 0, "f", "method", "A"), ("a.py", 2, 1, "v", None, "f"), ("a.py", 3, None, "os", "function", None), ("a.py", 4, None, "late", "function", None), ("b.go", 0, None, "g", "method", None), ("b.go", 1, None, "e", None, None)]
    files = spark.createDataFrame([("a.py", "python", "class A:\n    def f(self):\n        return 1\n\nimport os\nx = 1\n"), ("b.go", "go", "func g() {\r\n}\r\n"), ("c.go", "go", None)], "file_path string, language string, text string")
    units = {(r.file_path, r.name): r for r in symbols.symbol_units(found, files).collect()}
    assert set(units) == {("a.py", "A"), ("a.py", "f"), ("a.py", "late"), ("b.go", "g")}
    f = units["a.py", "f"]
    assert (f.line_start, f.line_end, f.code) == (2, 3, "def f(self):\n    return 1") and units["a.py", "late"].code == "x = 1" and units["b.go", "g"].line_end == 2
    flat_python = spark.createDataFrame([("a.py", json.dumps([{"name": "f", "kind": 12, "location": {"range": at(1, 2)}}]))], "file_path string, symbols string")
    served = [(r.name, r.unit_type, r.parent_name) for r in symbols.served_units(flat_python, files).collect()]
    assert served == [("f", "method", "A")]


class Sign:
    def __init__(self, kind, children=(), rows=(0, 0), name=""):
        self.type, self.children, self.start_point, self.end_point, self.name = kind, list(children), (rows[0], 0), (rows[1], 0), name


class ToyPlugin(registry.SyntaxTreePlugin):
    language_id, file_extensions, skip_dirs = "toy", frozenset({".toy"}), frozenset({"toys"})

    def parse(self, code):
        return Sign("root", [Sign("class", [Sign("{"), Sign("func", [], (1, 1), "m")], (0, 2), "K"), Sign("func", [Sign("x")], (3, 3), "f")], (0, 3))

    def is_function(self, node):
        return node.type == "func"

    def is_class(self, node):
        return node.type == "class"

    def name_of(self, node):
        return node.name


def test_plugins():
    toy = ToyPlugin()
    assert toy.tree("") == (["root", "class", "func", "func", "x"], [-1, 0, 1, 0, 3])
    assert [r[2:5] for r in toy.units("class K\n m\nend\nf")] == [("K", "class", None), ("m", "method", "K"), ("f", "function", None)]
    assert toy.entry("")[0] == 5 and toy.entry("")[2] == toy.entry("")[3] and not toy.is_block(None)
    found = registry.discover([f"{__name__}:ToyPlugin", "no.such:Plugin", "json:JSONDecoder"])
    reg = registry.Registry(found)
    assert reg.languages == ["c", "cpp", "go", "java", "javascript", "python", "toy", "typescript"] and reg.for_file("a/b.toy").language_id == "toy" and reg.for_file("a.tsx").language_id == "typescript" and reg.for_file("x") is None
    assert {"toys", "node_modules", ".gradle"} <= reg.skip_dirs and ".hpp" in reg.extensions and reg.get("nothing") is None
    with pytest.raises(ValueError):
        reg.register(type("Other", (registry.BasePlugin,), {"language_id": "other", "file_extensions": frozenset({".py"})})())
    assert registry.env_paths(" a:B, ,c:D") == ["a:B", "c:D"] and isinstance(reg.get("go"), registry.LanguagePlugin)
    assert reg.get("python").units("def f(): pass")[0][2] == "f" and reg.get("c").pattern(["Stmt:Op(+)"]) == ["Stmt:Op"]
