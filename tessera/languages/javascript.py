"""A reader of JavaScript (ECMAScript 2017): syntax trees, their labelled trees, functions and blocks.

A Pratt parser over one token of lookahead; a slash is read again as a regular expression where an operand must stand,
and an arrow's parameters are read as an expression first and turned into patterns once the arrow shows. Newer syntax
(optional chaining, class fields, spread of objects) is no part of the language here and fails like any other error: the
caller falls back to lines.
"""

from __future__ import annotations

import functools
import re
import textwrap
from collections import Counter
from collections.abc import Iterator

# The fields of a node that hold children, in the order in which a tree lists them.
FIELDS = (
    "body", "declarations", "init", "test", "update", "consequent", "alternate", "left", "right", "argument", "arguments", "callee",
    "object", "property", "params", "expression", "elements", "properties", "value", "key", "discriminant", "cases", "handler",
    "block", "finalizer", "guardedHandlers", "param", "id", "superClass", "tag", "quasi", "quasis", "expressions",
)
OPERATED = ("BinaryExpression", "UnaryExpression", "UpdateExpression", "AssignmentExpression", "LogicalExpression")
BLOCKS = {"ForStatement": "for", "ForInStatement": "for_in", "ForOfStatement": "for_of", "WhileStatement": "while", "DoWhileStatement": "do_while", "IfStatement": "if", "TryStatement": "try", "SwitchStatement": "switch"}
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression")
# Binding powers of binary operators, reserved words, assignments.
POWER = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, **dict.fromkeys(("==", "!=", "===", "!=="), 6), **dict.fromkeys(("<", ">", "<=", ">=", "instanceof", "in"), 7), **dict.fromkeys(("<<", ">>", ">>>"), 8), "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^=".split())
PREFIX = frozenset("! ~ + - typeof void delete".split())

SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)*", re.S)
TOKEN = re.compile(
    r"""(?P<num>0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![\w$])|(?P<name>[^\W\d]|[$_\\])(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4})*"""
    r"""|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|=>|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.`@#])""",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([\w$]*)")
QUASI = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)


# Names that the grammar tells from others though they aren't reserved.
KNOWN = frozenset("abstract as asserts async await constructor declare from get implements infer interface is keyof let namespace of override private protected public readonly satisfies set static target type unique using yield".split())
NAME = re.compile(r"(?<![\w\u200c\u200d])[^\W\d][\w\u200c\u200d]*")
#: Characters of a text whose structure is remembered, and such texts a worker remembers.
SHORT, REMEMBERED = 4096, 2000


class SyntaxProblem(ValueError):
    """The text isn't JavaScript as far as this reader knows it."""


class Node(dict):
    """A syntax node: its fields by name; type, and first and last line, are there always."""

    def children(self) -> Iterator[Node]:
        for f in FIELDS:
            child = self.get(f)
            for c in child if isinstance(child, list) else (child,):
                if isinstance(c, Node):
                    yield c


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.breaks = [m.end() for m in re.finditer(r"\r\n|[\n\r\u2028\u2029]", text)]
        self.kind, self.value, self.start, self.end, self.newline = "", "", 0, 0, False
        self.last_end, self.in_function, self.in_async, self.in_generator, self.no_in = 0, 0, False, False, False
        self.step()

    # ---- tokens

    def line(self, pos: int) -> int:
        lo, hi = 0, len(self.breaks)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.breaks[mid] <= pos else (lo, mid)
        return lo + 1

    def fail(self, what: str = "unexpected") -> SyntaxProblem:
        return SyntaxProblem(f"{what} {self.value!r} on line {self.line(self.start)}")

    def step(self) -> None:
        """Reads the next token: kind is num, name, word (reserved), str, op or end."""
        self.last_end = self.end
        m = SKIP.match(self.text, self.at)
        self.start = m.end()
        if self.text.startswith("/*", self.start):
            raise SyntaxProblem("open comment")
        self.newline = any(c in self.text[m.start() : m.end()] for c in "\n\r\u2028\u2029")
        if self.start >= len(self.text):
            self.kind, self.value, self.at = "end", "", self.start
        else:
            m = TOKEN.match(self.text, self.start)
            if not m:
                self.value = self.text[self.start]
                raise self.fail()
            self.kind, self.value, self.at = m.lastgroup, m[0], m.end()
            if self.kind == "name" and self.value in RESERVED:
                self.kind = "word"
        self.end = self.at

    def has(self, *values: str) -> bool:
        return self.kind in ("op", "word", "name") and self.value in values

    def take(self, *values: str) -> bool:
        if self.has(*values):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.fail(f"no {value} before")

    def semicolon(self) -> None:
        if not self.take(";") and not (self.has("}") or self.kind == "end" or self.newline):
            raise self.fail()

    def node(self, of: str, at: int, **fields) -> Node:
        return Node(type=of, line=self.line(at), end_line=self.line(max(at, self.last_end - 1)), **fields)

    def peek(self) -> tuple[str, str, bool]:
        """Kind, value and line break before the token after the present one."""
        held = self.kind, self.value, self.start, self.end, self.newline, self.last_end, self.at
        try:
            self.step()
            return self.kind, self.value, self.newline
        except SyntaxProblem:
            return "bad", "", False
        finally:
            self.kind, self.value, self.start, self.end, self.newline, self.last_end, self.at = held

    # ---- what a dialect with types adds; nothing here

    def type_after(self, target: Node | None = None) -> None:
        """Passes over a colon and a type behind a name, a pattern or parameters."""

    def type_parameters(self) -> None:
        """Passes over type parameters, or arguments, in angle brackets."""

    def modifiers(self) -> None:
        """Passes over what may stand before a parameter or a member."""

    def typed_parameter(self) -> Node | None:
        """A parameter of an arrow that shows to be one by its type."""
        return None

    def typed_tail(self) -> bool:
        """Passes over what types add behind an operand; whether there was any."""
        return False

    def only_types(self) -> bool:
        """Passes over a statement that declares nothing but types; whether there was one."""
        return False

    # ---- statements

    def program(self) -> Node:
        body = []
        while self.kind != "end":
            if not self.only_types():
                body.append(self.statement())
        return self.node("Program", 0, body=body)

    def statement(self) -> Node:
        s, v = self.start, self.value
        if self.kind == "op":
            if v == "{":
                return self.braces()
            if v == ";":
                self.step()
                return self.node("EmptyStatement", s)
        if self.kind == "word":
            if v in ("var", "const"):
                return self.variables(v)
            if f := getattr(self, f"word_{v}", None):
                return f(s)
        if self.kind == "name":
            kind, value, broken = self.peek()
            if v == "let" and (kind == "name" or value in ("[", "{")):
                return self.variables("let")
            if v == "async" and value == "function" and not broken:
                return self.function(s, "FunctionDeclaration")
            if value == ":" and kind == "op":
                self.step()
                self.step()
                return self.node("LabeledStatement", s, body=self.statement())
        e = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", s, expression=e)

    def braces(self) -> Node:
        s = self.start
        self.need("{")
        body = []
        while not self.has("}"):
            if self.kind == "end":
                raise self.fail("open block at")
            if not self.only_types():
                body.append(self.statement())
        self.step()
        return self.node("BlockStatement", s, body=body)

    def variables(self, kind: str, closed: bool = True) -> Node:
        s = self.start
        self.step()
        found = []
        while True:
            own = self.start
            target = self.pattern()
            self.type_after(target)
            init = self.assignment() if self.take("=") else None
            if closed and init is None and (kind == "const" or target["type"] != "Identifier"):
                raise self.fail("no value before")
            found.append(self.node("VariableDeclarator", own, id=target, init=init))
            if not self.take(","):
                break
        if closed:
            self.semicolon()
        return self.node("VariableDeclaration", s, declarations=found, kind=kind)

    def parenthesized(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def word_if(self, s: int) -> Node:
        self.step()
        test, then = self.parenthesized(), self.statement()
        other = self.statement() if self.take("else") else None
        return self.node("IfStatement", s, test=test, consequent=then, alternate=other)

    def word_while(self, s: int) -> Node:
        self.step()
        test = self.parenthesized()
        return self.node("WhileStatement", s, test=test, body=self.statement())

    def word_do(self, s: int) -> Node:
        self.step()
        body = self.statement()
        self.need("while")
        test = self.parenthesized()
        self.take(";")
        return self.node("DoWhileStatement", s, body=body, test=test)

    def word_with(self, s: int) -> Node:
        self.step()
        target = self.parenthesized()
        return self.node("WithStatement", s, object=target, body=self.statement())

    def word_for(self, s: int) -> Node:
        self.step()
        self.need("(")
        first, held = None, self.no_in
        self.no_in = True
        if not self.has(";"):
            let = self.has("let") and self.peek()[0] == "name" or self.has("let") and self.peek()[1] in ("[", "{")
            first = self.variables(self.value, closed=False) if self.has("var", "const") or let else self.expression()
        self.no_in = held
        if first is not None and self.has("in", "of"):
            kind = "ForInStatement" if self.value == "in" else "ForOfStatement"
            if first["type"] != "VariableDeclaration":
                first = self.as_pattern(first)
            self.step()
            right = self.expression() if kind == "ForInStatement" else self.assignment()
            self.need(")")
            return self.node(kind, s, left=first, right=right, body=self.statement())
        self.need(";")
        test = None if self.has(";") else self.expression()
        self.need(";")
        update = None if self.has(")") else self.expression()
        self.need(")")
        return self.node("ForStatement", s, init=first, test=test, update=update, body=self.statement())

    def word_switch(self, s: int) -> Node:
        self.step()
        what, cases = self.parenthesized(), []
        self.need("{")
        while not self.take("}"):
            own = self.start
            test = None
            if not self.take("default"):
                self.need("case")
                test = self.expression()
            self.need(":")
            body = []
            while not self.has("case", "default", "}"):
                body.append(self.statement())
            cases.append(self.node("SwitchCase", own, test=test, consequent=body))
        return self.node("SwitchStatement", s, discriminant=what, cases=cases)

    def word_try(self, s: int) -> Node:
        self.step()
        block, handler, finalizer = self.braces(), None, None
        own = self.start
        if self.take("catch"):
            self.need("(")
            param = self.pattern()
            self.type_after(param)
            self.need(")")
            body = self.braces()
            handler = self.node("CatchClause", own, param=param, body=body)
        if self.take("finally"):
            finalizer = self.braces()
        if handler is None and finalizer is None:
            raise self.fail("no catch before")
        return self.node("TryStatement", s, block=block, handler=handler, finalizer=finalizer)

    def word_return(self, s: int) -> Node:
        if not self.in_function:
            raise self.fail("return outside of functions:")
        self.step()
        e = None if self.has(";", "}") or self.newline or self.kind == "end" else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", s, argument=e)

    def word_throw(self, s: int) -> Node:
        self.step()
        if self.newline:
            raise self.fail("line break before")
        e = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", s, argument=e)

    def jump(self, s: int, kind: str) -> Node:
        self.step()
        if self.kind == "name" and not self.newline:
            self.step()
        self.semicolon()
        return self.node(kind, s)

    def word_break(self, s: int) -> Node:
        return self.jump(s, "BreakStatement")

    def word_continue(self, s: int) -> Node:
        return self.jump(s, "ContinueStatement")

    def word_debugger(self, s: int) -> Node:
        self.step()
        self.semicolon()
        return self.node("DebuggerStatement", s)

    def word_function(self, s: int) -> Node:
        return self.function(s, "FunctionDeclaration")

    def word_class(self, s: int) -> Node:
        return self.class_(s, "ClassDeclaration")

    def word_import(self, s: int) -> Node:
        if self.peek()[1] == "(":
            e = self.expression()
            self.semicolon()
            return self.node("ExpressionStatement", s, expression=e)
        self.step()
        if self.kind != "str":
            while not self.has("from"):
                if self.kind in ("end", "str", "num") or self.has(";"):
                    raise self.fail()
                self.step()
            self.step()
        if self.kind != "str":
            raise self.fail()
        self.step()
        self.semicolon()
        return self.node("ImportDeclaration", s)

    def word_export(self, s: int) -> Node:
        self.step()
        self.modifiers()
        if self.take("*"):
            self.need("from")
            self.step()
            self.semicolon()
            return self.node("ExportAllDeclaration", s)
        if self.take("default"):
            own = self.start
            if self.has("function") or self.has("async") and self.peek()[1] == "function":
                inner = self.function(own, "FunctionDeclaration", named=False)
            elif self.has("class"):
                inner = self.class_(own, "ClassDeclaration", named=False)
            else:
                inner = self.assignment()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", s, declaration=inner)
        if self.has("{"):
            while not self.take("}"):
                if self.kind == "end":
                    raise self.fail()
                self.step()
            if self.take("from"):
                self.step()
            self.semicolon()
            return self.node("ExportNamedDeclaration", s)
        if not self.has("var", "const", "let", "function", "class", "async"):
            raise self.fail()
        return self.node("ExportNamedDeclaration", s, declaration=self.statement())

    # ---- functions, classes, patterns

    def body(self, is_async: bool, generator: bool) -> Node:
        held = self.in_async, self.in_generator, self.no_in
        self.in_async, self.in_generator, self.no_in = is_async, generator, False
        self.in_function += 1
        out = self.braces()
        self.in_function -= 1
        self.in_async, self.in_generator, self.no_in = held
        return out

    def params(self) -> list[Node]:
        self.type_parameters()
        self.need("(")
        found = []
        while not self.take(")"):
            self.modifiers()
            found.append(self.rest() if self.has("...") else self.pattern(default=True))
            if not self.has(")"):
                self.need(",")
        self.type_after()
        return found

    def rest(self) -> Node:
        s = self.start
        self.need("...")
        inner = self.pattern()
        self.type_after(inner)
        return self.node("RestElement", s, argument=inner)

    def function(self, s: int, kind: str, named: bool = True) -> Node:
        is_async = self.take("async")
        self.need("function")
        generator = self.take("*")
        name = self.identifier() if self.kind == "name" else None
        if name is None and named and kind == "FunctionDeclaration":
            raise self.fail("no name before")
        params = self.params()
        body = self.body(is_async, generator)
        return self.node(kind, s, id=name, params=params, body=body)

    def method(self, s: int, is_async: bool = False, generator: bool = False) -> Node:
        params = self.params()
        body = self.body(is_async, generator)
        return self.node("FunctionExpression", s, id=None, params=params, body=body)

    def key(self) -> tuple[Node, bool]:
        """A property's name, and whether it is computed."""
        s = self.start
        if self.take("["):
            held, self.no_in = self.no_in, False
            e = self.assignment()
            self.no_in = held
            self.need("]")
            return e, True
        if self.kind in ("str", "num"):
            return self.literal(), False
        if self.kind in ("name", "word"):
            v = self.value
            self.step()
            return self.node("Identifier", s, name=v), False
        raise self.fail()

    def member(self) -> tuple[str, bool, bool, bool]:
        """What stands before a class's or an object's name: kind (get, set or nothing), async, generator, static."""
        is_static = is_async = generator = False
        kind = ""
        for word in ("static", "async"):
            if self.has(word) and not (self.peek()[1] in ("(", ",", "}", ":", "=") and self.peek()[0] == "op"):
                self.step()
                is_static |= word == "static"
                is_async |= word == "async"
        if self.take("*"):
            generator = True
        if self.has("get", "set") and not (self.peek()[1] in ("(", ",", "}", ":", "=") and self.peek()[0] == "op"):
            kind = self.value
            self.step()
        return kind, is_async, generator, is_static

    def class_(self, s: int, kind: str, named: bool = True) -> Node:
        self.need("class")
        name = self.identifier() if self.kind == "name" else None
        if name is None and named and kind == "ClassDeclaration":
            raise self.fail("no name before")
        self.type_parameters()
        parent = self.unary() if self.take("extends") else None
        self.type_parameters()
        while not self.has("{") and self.only_types():
            pass
        own, body = self.start, []
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            self.modifiers()
            at = self.start
            what, is_async, generator, is_static = self.member()
            key, computed = self.key()
            inner = self.start
            value = self.method(inner, is_async, generator)
            if not what:
                what = "constructor" if not is_static and not computed and key.get("name", key.get("value")) == "constructor" else "method"
            body.append(self.node("MethodDefinition", at, key=key, value=value, kind=what))
        return self.node(kind, s, id=name, superClass=parent, body=self.node("ClassBody", own, body=body))

    def identifier(self) -> Node:
        if self.kind != "name":
            raise self.fail()
        s, v = self.start, self.value
        self.step()
        return self.node("Identifier", s, name=v)

    def pattern(self, default: bool = False) -> Node:
        s = self.start
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(None if self.has(",") else self.rest() if self.has("...") else self.pattern(default=True))
                if not self.has("]"):
                    self.need(",")
            out = self.node("ArrayPattern", s, elements=items)
        elif self.take("{"):
            items = []
            while not self.take("}"):
                at = self.start
                key, computed = self.key()
                if self.take(":"):
                    value = self.pattern(default=True)
                else:
                    if computed or key["type"] != "Identifier" or key["name"] in RESERVED:
                        raise self.fail()
                    value = key
                    if self.take("="):
                        right = self.assignment()
                        value = self.node("AssignmentPattern", at, left=key, right=right)
                items.append(self.node("Property", at, key=key, value=value))
                if not self.has("}"):
                    self.need(",")
            out = self.node("ObjectPattern", s, properties=items)
        else:
            out = self.identifier()
        if default:
            self.type_after(out)
        if default and self.take("="):
            held, self.no_in = self.no_in, False
            right = self.assignment()
            self.no_in = held
            return self.node("AssignmentPattern", s, left=out, right=right)
        return out

    def as_pattern(self, e: Node) -> Node:
        """An expression that turned out to be a target of assignment."""
        kind = e["type"]
        if kind in ("Identifier", "MemberExpression", "ArrayPattern", "ObjectPattern", "RestElement") or kind == "AssignmentPattern":
            return e
        if kind == "ArrayExpression":
            return Node(e, type="ArrayPattern", elements=[x and self.as_pattern(x) for x in e["elements"]])
        if kind == "ObjectExpression":
            return Node(e, type="ObjectPattern", properties=[Node(p, value=self.as_pattern(p["value"])) for p in e["properties"]])
        if kind == "AssignmentExpression" and e["operator"] == "=":
            return Node(type="AssignmentPattern", line=e["line"], end_line=e["end_line"], left=self.as_pattern(e["left"]), right=e["right"])
        if kind == "SpreadElement":
            return Node(e, type="RestElement", argument=self.as_pattern(e["argument"]))
        raise self.fail("no target of assignment before")

    # ---- expressions

    def expression(self) -> Node:
        s = self.start
        first = self.assignment()
        if not self.has(","):
            return first
        items = [first]
        while self.take(","):
            items.append(self.assignment())
        return self.node("SequenceExpression", s, expressions=items)

    def arrow(self, s: int, params: list[Node], is_async: bool) -> Node:
        self.need("=>")
        if self.has("{"):
            body = self.body(is_async, False)
        else:
            held, self.in_async = self.in_async, is_async
            self.in_function += 1
            body = self.assignment()
            self.in_function -= 1
            self.in_async = held
        return self.node("ArrowFunctionExpression", s, id=None, params=params, body=body)

    def assignment(self) -> Node:
        s = self.start
        if self.kind == "name":
            if self.value == "yield" and self.in_generator:
                self.step()
                if self.newline or self.has(")", "]", "}", ",", ";", ":") or self.kind == "end":
                    return self.node("YieldExpression", s, argument=None)
                self.take("*")
                return self.node("YieldExpression", s, argument=self.assignment())
            kind, value, broken = self.peek()
            if self.value == "async" and kind == "name" and not broken:
                held = self.at, self.kind, self.value, self.start, self.end, self.newline, self.last_end
                self.step()
                if self.peek()[1] == "=>":
                    return self.arrow(s, [self.identifier()], True)
                self.at, self.kind, self.value, self.start, self.end, self.newline, self.last_end = held
            elif value == "=>" and not broken:
                return self.arrow(s, [self.identifier()], False)
        left = self.conditional()
        if left["type"] == "_params" or left["type"] == "_async":
            if not self.has("=>") or self.newline:
                raise self.fail()
            return self.arrow(s, [self.as_pattern(x) for x in left["items"]], left["type"] == "_async")
        if self.has("=>") and not self.newline and left.get("wrapped"):
            items = left["expressions"] if left["type"] == "SequenceExpression" else [left]
            return self.arrow(s, [self.as_pattern(x) for x in items], False)
        if self.kind == "op" and self.value in ASSIGN:
            op = self.value
            if op == "=":
                left = self.as_pattern(left)
            elif left["type"] not in ("Identifier", "MemberExpression"):
                raise self.fail()
            self.step()
            right = self.assignment()
            return self.node("AssignmentExpression", s, operator=op, left=left, right=right)
        return left

    def conditional(self) -> Node:
        s = self.start
        test = self.binary(0)
        if not self.has("?") or test["type"].startswith("_"):
            return test
        self.step()
        held, self.no_in = self.no_in, False
        then = self.assignment()
        self.no_in = held
        self.need(":")
        return self.node("ConditionalExpression", s, test=test, consequent=then, alternate=self.assignment())

    def binary(self, least: int) -> Node:
        s = self.start
        left = self.unary()
        while self.kind in ("op", "word") and self.value in POWER and not (self.no_in and self.value == "in"):
            op = self.value
            power = POWER[op]
            if power <= least:
                break
            if left["type"].startswith("_") or op == "**" and left["type"] == "UnaryExpression" and not left.get("wrapped"):
                raise self.fail()
            self.step()
            right = self.binary(power - 1 if op == "**" else power)
            left = self.node("LogicalExpression" if op in ("||", "&&") else "BinaryExpression", s, operator=op, left=left, right=right)
        return left

    def unary(self) -> Node:
        s, v = self.start, self.value
        if self.kind in ("op", "word") and v in PREFIX:
            self.step()
            return self.node("UnaryExpression", s, operator=v, argument=self.unary())
        if self.has("++", "--"):
            self.step()
            return self.node("UpdateExpression", s, operator=v, argument=self.unary())
        if self.kind == "name" and v == "await" and self.in_async:
            self.step()
            return self.node("AwaitExpression", s, argument=self.unary())
        e = self.calls(self.primary(), s)
        if self.has("++", "--") and not self.newline:
            op = self.value
            if e["type"] not in ("Identifier", "MemberExpression"):
                raise self.fail()
            self.step()
            return self.node("UpdateExpression", s, operator=op, argument=e)
        return e

    def arguments(self) -> list[Node]:
        self.need("(")
        held, self.no_in = self.no_in, False
        out = []
        while not self.take(")"):
            s = self.start
            out.append(self.node("SpreadElement", s, argument=self.assignment()) if self.take("...") else self.assignment())
            if not self.has(")"):
                self.need(",")
        self.no_in = held
        return out

    def calls(self, e: Node, s: int, new: bool = False) -> Node:
        while not e["type"].startswith("_"):
            if self.typed_tail():
                continue
            if self.take("."):
                at = self.start
                if self.kind not in ("name", "word"):
                    raise self.fail()
                v = self.value
                self.step()
                e = self.node("MemberExpression", s, object=e, property=self.node("Identifier", at, name=v))
            elif self.take("["):
                held, self.no_in = self.no_in, False
                p = self.expression()
                self.no_in = held
                self.need("]")
                e = self.node("MemberExpression", s, object=e, property=p)
            elif self.has("`"):
                e = self.node("TaggedTemplateExpression", s, tag=e, quasi=self.template())
            elif self.has("(") and not new:
                plain = e["type"] == "Identifier" and e["name"] == "async" and not self.newline
                args = self.arguments()
                if plain and self.has("=>") and not self.newline:
                    return Node(type="_async", items=args)
                e = self.node("CallExpression", s, callee=e, arguments=args)
            else:
                return e
        return e

    def literal(self) -> Node:
        s, v, kind = self.start, self.value, self.kind
        self.step()
        if kind == "str":
            return self.node("Literal", s, value=v[1:-1])
        if re.match("0[xX]", v):
            return self.node("Literal", s, value=int(v, 16))
        if re.match("0[oObB]", v):
            return self.node("Literal", s, value=int(v, 0))
        x = float(v)
        return self.node("Literal", s, value=int(x) if x.is_integer() else x)

    def template(self) -> Node:
        s, quasis, found = self.start, [], []
        while True:
            # the token before (a grave accent or a closing brace) has just been seen: text goes on after it
            at = self.end
            m = QUASI.match(self.text, at)
            self.at = self.end = m.end()
            if self.at >= len(self.text):
                raise SyntaxProblem("open template")
            last = self.text[self.at] == "`"
            self.at += 1 if last else 2
            self.end = self.at
            quasis.append(Node(type="TemplateElement", line=self.line(at), end_line=self.line(m.end())))
            self.step()
            if last:
                return self.node("TemplateLiteral", s, quasis=quasis, expressions=found)
            held, self.no_in = self.no_in, False
            found.append(self.expression())
            self.no_in = held
            if not self.has("}"):
                raise self.fail()

    def primary(self) -> Node:
        s, v, kind = self.start, self.value, self.kind
        if kind in ("str", "num"):
            return self.literal()
        if kind == "name":
            if v == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                return self.function(s, "FunctionExpression")
            return self.identifier()
        if kind == "word":
            if v in ("null", "true", "false"):
                self.step()
                return self.node("Literal", s, value={"null": None, "true": True, "false": False}[v])
            if v == "this":
                self.step()
                return self.node("ThisExpression", s)
            if v == "function":
                return self.function(s, "FunctionExpression")
            if v == "class":
                return self.class_(s, "ClassExpression", named=False)
            if v == "super":
                self.step()
                if not self.has("(", ".", "["):
                    raise self.fail()
                return self.node("Super", s)
            if v == "import":
                self.step()
                if not self.has("("):
                    raise self.fail()
                return self.node("Import", s)
            if v == "new":
                self.step()
                if self.take("."):
                    at = self.start
                    self.need("target")
                    return self.node("MetaProperty", s, property=self.node("Identifier", at, name="target"))
                own = self.start
                callee = self.calls(self.primary(), own, new=True)
                return self.node("NewExpression", s, callee=callee, arguments=self.arguments() if self.has("(") else [])
            raise self.fail()
        if v == "`":
            return self.template()
        if v in ("/", "/="):
            m = REGEX.match(self.text, self.start)
            if not m:
                raise self.fail()
            self.at = self.end = m.end()
            self.step()
            return self.node("Literal", s, value=re.compile(""))
        if v == "[":
            self.step()
            held, self.no_in = self.no_in, False
            items = []
            while not self.take("]"):
                own = self.start
                if self.has(","):
                    self.step()
                    items.append(None)
                    continue
                items.append(self.node("SpreadElement", own, argument=self.assignment()) if self.take("...") else self.assignment())
                if not self.has("]"):
                    self.need(",")
            self.no_in = held
            return self.node("ArrayExpression", s, elements=items)
        if v == "{":
            return self.object(s)
        if v == "(":
            self.step()
            held, self.no_in = self.no_in, False
            items, only = [], False
            while not self.has(")"):
                own = self.start
                if self.has("..."):
                    items.append(self.rest())
                    only = True
                    break
                if typed := self.typed_parameter():
                    items.append(typed)
                    only = True
                else:
                    items.append(self.assignment())
                if not self.take(","):
                    break
                only |= self.has(")")
            self.no_in = held
            self.need(")")
            if only or not items:
                self.type_after()
                return Node(type="_params", items=items)
            out = items[0] if len(items) == 1 else self.node("SequenceExpression", own, expressions=items)
            return Node(out, wrapped=True)
        raise self.fail()

    def object(self, s: int) -> Node:
        self.need("{")
        held, self.no_in = self.no_in, False
        found = []
        while not self.take("}"):
            at = self.start
            what, is_async, generator, _ = self.member()
            key, computed = self.key()
            inner = self.start
            if what or is_async or generator or self.has("("):
                value = self.method(inner, is_async, generator)
            elif self.take(":"):
                value = self.assignment()
            else:
                if computed or key["type"] != "Identifier" or key["name"] in RESERVED:
                    raise self.fail()
                value = key
                if self.take("="):  # a pattern's default; as_pattern has it later
                    value = self.node("AssignmentPattern", at, left=key, right=self.assignment())
            found.append(self.node("Property", at, key=key, value=value))
            if not self.has("}"):
                self.need(",")
        self.no_in = held
        return self.node("ObjectExpression", s, properties=found)


class Typed(Parser):
    """TypeScript: types are passed over, and where they stood is kept in ``erased``."""

    def __init__(self, text: str):
        self.erased: list[tuple[int, int]] = []
        super().__init__(text)

    def type(self) -> None:
        """Passes over a type."""
        while True:
            while self.has("|", "&", "keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "-") and self.peek()[1] not in (",", ")", ";", "="):
                self.step()
            if self.has("<"):
                self.angles()
            if self.has("(", "{", "["):
                arrow = self.value == "("
                self.group()
                if arrow and self.take("=>"):
                    self.type()
            elif self.has("`"):
                self.template()
            elif self.kind in ("name", "word", "str", "num"):
                self.step()
                while self.take("."):
                    self.step()
                if self.has("<"):
                    self.angles()
            else:
                raise self.fail("no type before")
            while self.has("[") and not self.newline:
                self.group()
            if self.take("is"):
                self.type()
            if self.has("extends") and not self.newline:
                self.step()
                self.type()
                if self.take("?"):
                    self.type()
                    self.need(":")
                    self.type()
            if not self.has("|", "&"):
                return

    def group(self) -> None:
        """Passes over brackets and what is in them."""
        depth = 0
        while True:
            if self.kind == "end":
                raise self.fail("open bracket at")
            depth += self.has("(", "{", "[") - self.has(")", "}", "]")
            self.step()
            if not depth:
                return

    def angles(self) -> None:
        depth = 0
        while True:
            if self.has("<"):
                depth += 1
            elif self.kind == "op" and self.value[0] == ">":
                self.at = self.end = self.start + 1  # the rest of the sign is the next token's
                depth -= 1
            elif self.has("(", "{", "["):
                self.group()
                continue
            elif self.kind == "end" or self.has(";", ")", "}", "]"):
                raise self.fail("open angle bracket at")
            self.step()
            if not depth:
                return

    def erase(self, since: int) -> None:
        self.erased.append((since, self.last_end))

    def type_after(self, target: Node | None = None) -> None:
        s = self.start
        if self.has("?", "!") and self.peek()[1] in (":", ",", ")", "="):
            self.step()
        if self.take(":"):
            if target is not None and self.kind in ("name", "word"):
                target["annotation"] = self.value
            self.type()
        if self.start > s:
            self.erase(s)

    def type_parameters(self) -> None:
        if self.has("<"):
            s = self.start
            self.angles()
            self.erase(s)

    def modifiers(self) -> None:
        s = self.start
        while self.has("@"):
            self.step()
            while self.kind in ("name", "word") and not self.newline or self.last_end == self.start:
                self.step()
                if not self.take("."):
                    break
            if self.has("("):
                self.group()
        while self.has("public", "private", "protected", "readonly", "override", "abstract", "declare") and self.peek()[1] not in ("(", ",", ")", ":", "=", "?"):
            self.step()
        if self.start > s:
            self.erase(s)

    def typed_parameter(self) -> Node | None:
        if self.kind == "name":
            if re.match(r"\s*(?::|\?\s*[:,)])", self.text[self.end :]):
                return self.pattern(default=True)
        return None

    def typed_tail(self) -> bool:
        s = self.start
        if self.has("!") and not self.newline and self.text[self.end : self.end + 1] in tuple(".[)],;"):
            self.step()
        elif self.has("as", "satisfies") and not self.newline:
            self.step()
            self.type()
        elif self.has("<") and re.match(r"<[\w$.,\s\[\]|<>]*>\s*\(", self.text[self.start :]):
            self.angles()
        else:
            return False
        self.erase(s)
        return True

    def only_types(self) -> bool:
        s, v = self.start, self.value
        if self.kind == "op" and v == "@":
            self.modifiers()
            return False
        if self.kind not in ("name", "word"):
            return False
        kind, value, broken = self.peek()
        if v == "export" and value in ("interface", "type", "enum", "namespace", "declare") or v == "const" and value == "enum":
            self.step()
            if not self.only_types():
                return False
            self.erase(s)
            return True
        if v == "implements" and kind == "name":
            self.step()
            self.type()
            while self.take(","):
                self.type()
        elif v in ("interface", "enum", "namespace") and kind in ("name", "word") and not broken:
            while not self.has("{"):
                if self.kind == "end" or self.has(";"):
                    raise self.fail()
                self.step()
            self.group()
        elif v == "type" and kind == "name" and not broken:
            self.step()
            self.step()
            self.type_parameters()
            self.need("=")
            self.type()
            self.take(";")
        elif v == "abstract" and value == "class":
            self.step()
            self.erase(s)
            return False
        elif v == "declare" and kind in ("name", "word") and not broken:
            self.step()
            if not self.only_types():
                while not self.has(";", "}") and self.kind != "end" and not self.newline:
                    self.group() if self.has("(", "{", "[") else self.step()
                self.take(";")
        elif v == "using" and kind == "name" and not broken:
            self.kind, self.value = "word", "const"  # it declares like const
            return False
        else:
            return False
        self.erase(s)
        return True


def parse(code: str, typed: bool = False) -> Node | None:
    """The syntax tree; None for text that can't be read."""
    try:
        return (Typed if typed else Parser)(code).program()
    except (SyntaxProblem, RecursionError):
        return None


def strip_types(code: str) -> str | None:
    """The text with blanks in place of its types, so that lines and columns stay; None for text that can't be read."""
    try:
        p = Typed(code)
        p.program()
    except (SyntaxProblem, RecursionError):
        return None
    out = list(code)
    for a, b in p.erased:
        out[a:b] = (c if c in "\n\r\u2028\u2029" else " " for c in out[a:b])
    return "".join(out)


# ---- trees


def label(node: Node) -> str:
    kind = node["type"]
    if kind in OPERATED:
        return f"{kind}:{node['operator']}"
    if kind in ("VariableDeclaration", "MethodDefinition"):
        return f"{kind}:{node['kind']}"
    if kind == "Literal":
        return f"Literal:{type(node['value']).__name__}"
    return "ArrowFunction" if kind == "ArrowFunctionExpression" else kind


def pattern_label(text: str) -> str:
    """A node's label whatever the operator."""
    head = text.partition(":")[0]
    return f"{head}:Op" if head in OPERATED else text


def bare(code: str) -> tuple[str, list[str]]:
    """The text with numbers ($0, $1, ...) in place of the names that the grammar doesn't know, and these names: texts that
    differ in names alone have one structure. Texts in which a name may be written otherwise, or hold a $, stay."""
    if len(code) > SHORT or any(c in code for c in "$\\`"):
        return code, []
    number: dict[str, int] = {}

    def new(m: re.Match) -> str:
        name = m[0]
        return name if name in RESERVED or name in KNOWN else f"${number.setdefault(name, len(number))}"

    return NAME.sub(new, code), list(number)


def named(text: str, names: list[str]) -> str:
    """The text with its names again."""
    return re.sub(r"\$(\d+)", lambda m: names[int(m[1])], text) if names else text


def structure(code: str, typed: bool) -> tuple[tuple[str, ...], tuple[int, ...]] | None:
    root = parse(code, typed)
    if root is None:
        return None
    labels, parents, todo = [], [], [(root, -1)]
    while todo:
        node, parent = todo.pop()
        labels.append(label(node))
        parents.append(parent)
        own = len(labels) - 1
        todo += [(c, own) for c in reversed(list(node.children()))]
    return tuple(labels), tuple(parents)


remembered_structure = functools.lru_cache(REMEMBERED)(structure)


def tree(code: str, typed: bool = False) -> tuple[list[str], list[int]] | None:
    """(labels, parents) in pre-order; None for text that can't be read."""
    found = remembered_structure(bare(code)[0], typed) if len(code) <= SHORT else structure(code, typed)
    return found and (list(found[0]), list(found[1]))


def every(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(list(n.children()))


# ---- units


def named_functions(root: Node) -> Iterator[tuple[Node, str, str, str | None]]:
    """(node, name, unit type, class) of classes, methods and functions; a function without a name of its own is called
    like the variable, property or member that it is assigned to."""
    todo: list[tuple[Node, str | None, str | None]] = [(root, None, None)]
    while todo:
        node, name, owner = todo.pop()
        kind = node["type"]
        below = owner
        if kind in ("ClassDeclaration", "ClassExpression"):
            own = node["id"]["name"] if node["id"] else name
            if own:
                yield node, own, "class", None
            below = own
        elif kind == "MethodDefinition":
            yield node, str(node["key"].get("name", node["key"].get("value", "<computed>"))), "method", owner
            todo += [(c, None, None) for c in reversed(list(node["value"].children()))]
            continue
        elif kind in FUNCTIONS:
            own = node["id"]["name"] if node.get("id") else name
            if own:
                yield node, own, "function", None
            below = None
        children = list(node.children())
        if isinstance(node.get("declaration"), Node):
            children.append(node["declaration"])
        for c in reversed(children):
            given = None
            if kind == "VariableDeclarator" and c is node["init"]:
                given = node["id"].get("name")
            elif kind == "Property" and c is node["value"]:
                given = node["key"].get("name")
            elif kind == "AssignmentExpression" and c is node["right"]:
                target = node["left"]
                given = target.get("name") or (target.get("property") or {}).get("name")
            todo.append((c, given, below))


def function_blocks(node: Node, name: str, most: int) -> Iterator[tuple]:
    """(name, type, depth, block around it, first line, last line) of the blocks within a function, whatever stands between
    them and it."""
    counts: Counter = Counter()
    body = node["value"]["body"] if node["type"] == "MethodDefinition" else node["body"]
    # entries: a node whose children are looked at, the block around it, depth
    todo: list[tuple[Node, str, int]] = [(body, name, 1)]
    while todo:
        at, parent, depth = todo.pop()
        if at["type"] == "_turn":  # a block whose turn has come
            block = at["turn"]
            kind = BLOCKS[block["type"]]
            counts[parent, kind] += 1
            own = f"{parent}.{kind}_{counts[parent, kind]}"
            yield own, kind, depth, None if parent == name else parent, block["line"], block["end_line"]
            if depth < most:
                todo.append((block, own, depth + 1))
            continue
        todo += [(Node(type="_turn", turn=c) if c["type"] in BLOCKS else c, parent, depth) for c in reversed(list(at.children()))]


def outline(code: str, typed: bool, most: int) -> list[tuple] | None:
    """(name, unit type, class or function, block type, depth, block around it, first line, last line) of a text's units;
    None for text that can't be read."""
    root = parse(code, typed)
    if root is None:
        return None
    out, seen = [], set()
    for node, name, kind, owner in named_functions(root):
        out.append((name, kind, owner, None, None, None, node["line"], node["end_line"]))
        if kind == "class":
            continue
        for own, block, depth, parent, first, last in function_blocks(node, name, most):
            if (block, first, last) not in seen:
                seen.add((block, first, last))
                out.append((own, "block", name, block, depth, parent, first, last))
    return out


remembered_outline = functools.lru_cache(REMEMBERED)(outline)


def units(code: str, path: str, language: str, most: int) -> list[tuple] | None:
    """Rows of a unit table; None for text that can't be read. A block that several functions hold, one in another, is the
    outermost one's."""
    text, names = bare(code)
    found = (remembered_outline if len(code) <= SHORT else outline)(text, language == "typescript", most)
    if found is None:
        return None
    lines = code.splitlines()
    as_was = lambda x: x and named(x, names)
    return [(path, language, as_was(name), kind, as_was(owner), block, depth, as_was(parent), first, last, textwrap.dedent("\n".join(lines[first - 1 : last]))) for name, kind, owner, block, depth, parent, first, last in found]


# ---- what an addition adds


def plus_binding(code: str, typed: bool = False) -> tuple[str, float] | None:
    """What the operands of + are, and how sure that is; None without any, or for text that can't be read."""
    root = parse(code, typed)
    if root is None:
        return None
    known: dict[str, str] = {}
    kinds = set()
    nodes = list(every(root))
    for f in nodes:
        if f["type"] in FUNCTIONS:
            for p in f["params"]:
                p = p["left"] if p["type"] == "AssignmentPattern" else p
                if p["type"] == "Identifier" and p.get("annotation"):
                    known[p["name"]] = p["annotation"]

    def kind_of(n: Node) -> str | None:
        if n["type"] == "Identifier":
            return known.get(n["name"])
        if n["type"] == "TemplateLiteral" or n["type"] == "Literal" and isinstance(n["value"], str):
            return "string"
        return "number" if n["type"] == "Literal" and isinstance(n["value"], (int, float)) else None

    for n in nodes:
        if n["type"] == "BinaryExpression" and n["operator"] == "+":
            a, b = kind_of(n["left"]), kind_of(n["right"])
            numeric = ("number", "bigint", "Number", "BigInt")
            kinds.add("numeric" if a in numeric and b in numeric else "str_concat" if a == b == "string" else "unknown")
    if not kinds:
        return None
    if {"numeric", "str_concat"} <= kinds:
        return "mixed", 0.6
    known_kind = kinds - {"unknown"}
    return (known_kind.pop(), 0.9) if known_kind else ("unknown", 0.5)
