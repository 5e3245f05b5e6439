"""Units of languages with braces (C, C++, Java, Go, and scripts that can't be read otherwise), character by character.

Comments and literals are blanked out first, each character by a blank, so that offsets and lines stay. What stands
between the last statement's end and an opening brace is the brace's head; it tells whether a class, a function or
something else begins there. Within a function the blocks are keywords with their own brace.
"""

from __future__ import annotations

import re
import textwrap
from collections import Counter
from collections.abc import Iterator

# Words that begin blocks, and what their blocks are called.
BLOCKS = {"for": "for", "while": "while", "do": "do_while", "if": "if", "switch": "switch", "try": "try", "select": "select", "defer": "defer"}
#: Words before a brace that are no function's name.
CONTROL = frozenset("if else for while do switch try catch finally synchronized select defer return new throw case go range sizeof with".split())
HIDDEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
RAW = re.compile(r"`[^`]*`")
DIRECTIVE = re.compile(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*")
ANNOTATION = re.compile(r"@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?")
TYPE = re.compile(r"\b(class|struct|interface|record|union)\b")
NATIVE_ENUM, JAVA_ENUM = re.compile(r"\benum\b[^()=]*$"), re.compile(r"\benum\s+[A-Za-z_]\w*\s*(?:implements\b[^()]*)?$")
#: What may stand between a type's keyword and its name: attributes, and calls such as alignas(8) or EXPORT(x).
ATTRIBUTE = re.compile(r"\[\[.*?\]\]|\b\w+\s*\((?:[^()]|\([^()]*\))*\)", re.S)
#: A C function's head before types stood in its parentheses, up to its first declaration; one more declaration.
OLD_HEAD, OLD_DECLARATION = re.compile(r"[A-Za-z_]\w*\s*\([\w\s,]+\)\s*[A-Za-z_][\w\s*,\[\]]*$"), re.compile(r"\s*[A-Za-z_][\w\s*,\[\]]*")
GO_TYPE = re.compile(r"\btype\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(struct|interface)\s*$")
GO_FUNC = re.compile(r"\bfunc\s*(?:\(\s*(?:\w+\s+)?\*?\s*([A-Za-z_]\w*)(?:\[[^\]]*\])?\s*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?\(")
SCRIPT_FUNC = re.compile(r"(?:\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\([^()]*\)|([A-Za-z_$][\w$]*)\s*[=:]\s*(?:async\s+)?(?:function\s*\*?\s*\([^()]*\)|\([^()]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)|^\s*(?:(?:async|static|get|set|public|private|protected)\s+)*([A-Za-z_$][\w$]*)\s*\([^()]*\))[^;{}]*$")
NAME = re.compile(r"(~?[A-Za-z_]\w*|\boperator\s*[^\s\w(]{1,3}|\boperator\s*\(\s*\))\s*$")
QUALIFIED = re.compile(r"([A-Za-z_]\w*)(?:<[^<>]*>)?\s*::\s*$")
KEYWORD = re.compile(r"\b(" + "|".join(BLOCKS) + r")\b\s*(?=[({])")


def cleaned(code: str, language: str) -> str:
    """The code with comments, literals and preprocessor lines blanked out; lines and offsets stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    if language in ("c", "cpp"):
        code = DIRECTIVE.sub(blank, code)
    if language not in ("c", "cpp", "java"):
        code = RAW.sub(blank, code)
    return HIDDEN.sub(blank, code)


def matching(text: str) -> dict[int, int]:
    """Where each brace, bracket and parenthesis is closed; those that stay open are left out."""
    pairs, open_ = {"}": "{", ")": "(", "]": "["}, []
    out = {}
    for m in re.finditer(r"[{}()\[\]]", text):
        c = m[0]
        if c in "{([":
            open_.append((c, m.start()))
        else:
            while open_ and open_[-1][0] != pairs[c] and c == "}" and open_[-1][0] != "{":
                open_.pop()  # an open parenthesis doesn't outlive its block
            if open_ and open_[-1][0] == pairs[c]:
                out[open_.pop()[1]] = m.start()
    return out


def without_template(head: str) -> str:
    """A head with its template parameter lists blanked out; places stay."""
    while m := re.search(r"\btemplate\s*<", head):
        depth, round_, at = 1, 0, m.end()
        while at < len(head) and depth:
            c = head[at]
            round_ += (c == "(") - (c == ")")
            depth += 0 if round_ else (c == "<") - (c == ">")
            at += 1
        head = head[: m.start()] + " " * (at - m.start()) + head[at:]
    return head


def type_name(head: str, at: int, language: str) -> re.Match | None:
    """The name of the type whose keyword ends at a place of its head. In C and C++ macros and qualifiers may stand before it:
    it is the last name before bases, type arguments, ``final`` or the brace; what is initialized is no type."""
    if language == "java":
        return re.compile(r"\s+([A-Za-z_]\w*)").match(head, at)
    rest = ATTRIBUTE.sub(lambda m: " " * len(m[0]), head[at:])
    end = re.search(r"(?<!:):(?!:)|<|\bfinal\b|=|$", rest)
    if end[0] == "=":
        return None
    return next(iter([*re.compile(r"([A-Za-z_]\w*)").finditer(head[:at] + rest, at, at + end.start())][::-1]), None)


def declared(head: str, language: str, within: tuple[str, str] | None) -> tuple[str, str, str | None, int] | None:
    """(kind, name, class, where the name is) of what a head declares, if it declares anything; within: kind and name of
    what it stands in. An enum is no unit: what it holds are methods of what stands around it."""
    owner = within[1] if within and within[0] in ("class", "enum") else None
    if language == "go":
        if m := GO_TYPE.search(head):
            return "class", m[1], None, m.start(1)
        m = GO_FUNC.search(head)
        return m and (("method" if m[1] else "function"), m[2], m[1], m.start(2))
    if language in ("javascript", "typescript"):
        if m := re.search(r"\bclass\s+([A-Za-z_$][\w$]*)", head):
            return "class", m[1], None, m.start(1)
        m = SCRIPT_FUNC.search(head)
        name = m and (m[1] or m[2] or m[3])
        if not name or name in CONTROL:
            return None
        return ("method" if owner and m[3] else "function"), name, owner if m[3] else None, m.start(m.lastindex)
    head = ANNOTATION.sub(lambda m: " " * len(m[0]), head)
    first = re.match(r"\s*(?:\}\s*)?([A-Za-z_]\w*)", head)
    if first and first[1] in CONTROL:
        return None
    if language != "java":
        head = without_template(head)
    if (JAVA_ENUM if language == "java" else NATIVE_ENUM).search(head):
        return "enum", owner, None, 0
    m = TYPE.search(head)
    if m and (m[1] == "record" or not re.search(r"\)\s*(?:const|noexcept|override|final|throws\b.*)?\s*$", head[m.end() :])):
        name = type_name(head, m.end(), language)
        return name and ("class", name[1], None, name.start(1))
    opening = head.find("(")
    while opening >= 0:
        m = NAME.search(head[:opening])
        if m and m[1] not in CONTROL and m[1] not in ("__attribute__", "__declspec", "alignas", "decltype", "throw", "noexcept"):
            break
        if m and m[1] in CONTROL:
            return None
        opening = head.find("(", opening + 1)
    if opening < 0 or "=" in head[:opening] and not m[1].startswith("operator") or re.search(r"\bnew\b|->\s*$", head[:opening] if "->" not in head else head[:opening] + head[head.rfind("->") :]):
        return None
    name = re.sub(r"\s+", "", m[1])
    outer = QUALIFIED.search(head[: m.start()])
    if outer:
        return "method", name, outer[1], m.start()
    return ("method" if owner or within and within[0] == "enum" else "function"), name, owner, m.start()


def units(code: str, path: str, language: str, most: int) -> list[tuple]:
    """Rows of a unit table, by line: classes (structs and interfaces too), methods, functions, and the blocks in them."""
    text = cleaned(code, language)
    close = matching(text)
    lines = code.split("\n")
    breaks = [i for i, c in enumerate(text) if c == "\n"]

    def line(at: int) -> int:
        lo, hi = 0, len(breaks)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if breaks[mid] < at else (lo, mid)
        return lo + 1

    cut = lambda a, b: textwrap.dedent("\n".join(x.rstrip("\r") for x in lines[a - 1 : b]))
    out: list[tuple] = []
    open_: list[tuple[int, tuple[str, str] | None]] = []  # end of what stands around, and what it is
    since, depth, old = 0, 0, None  # old: where a head began whose parameters are declared behind it
    constants = -1  # the end of the enum whose constants are being listed
    for m in re.finditer(r"[;{}()]", text):
        c, at = m[0], m.start()
        if c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
            continue
        while open_ and open_[-1][0] < at:
            open_.pop()
        if c == "{" and at in close:
            if old is not None and not text[since:at].strip():
                since = old
            head, old = text[since:at], None
            if language == "c" and ";" in head:
                head = head[: head.find(")") + 1]
            within = open_[-1][1] if open_ else None
            in_constant = open_ and open_[-1][0] == constants
            found = None if in_constant or within and within[0] in ("function", "method") and language not in ("javascript", "typescript") else declared(head, language, within)
            if found and found[0] == "enum":
                constants = close[at] if language == "java" else -1
            elif found:
                kind, name, owner, offset = found
                # where statements need no semicolon, a declaration starts on its name's line
                first = line(since + (len(head) - len(head.lstrip()) if language in ("c", "cpp", "java") else offset))
                last = line(close[at])
                out.append((path, language, name, kind, owner, None, None, None, first, last, cut(first, last)))
                if kind != "class":
                    out += blocks(text, close, at + 1, close[at], name, path, language, most, line, cut)
            # what stands in a namespace stands where the namespace stands
            open_.append((close[at], (found[0], found[1]) if found else within if within and within[0] != "class" else None))
            since, depth = at + 1, 0
        elif c != ";" or not depth:
            if c == ";" and open_ and open_[-1][0] == constants:
                constants = -1
            if language == "c":
                said = text[since:at]
                old = since if c == ";" and not open_ and OLD_HEAD.search(said) else old if c == ";" and OLD_DECLARATION.fullmatch(said) else None
            since = at + 1
    return sorted(out, key=lambda r: (r[8], -r[9], r[6] or 0))


def blocks(text: str, close: dict[int, int], start: int, end: int, function: str, path: str, language: str, most: int, line, cut) -> Iterator[tuple]:
    """Rows of the blocks between start and end: a keyword, what it has in parentheses, and a brace right after; blocks on
    one line are passed over with all that is in them."""
    counts: Counter = Counter()

    def within(start: int, end: int, parent: str, depth: int) -> Iterator[tuple]:
        at = start
        while m := KEYWORD.search(text, at, end):
            at = m.end()
            brace = at
            if text[at] == "(":
                if at not in close:
                    continue
                brace = close[at] + 1
                while brace < end and text[brace].isspace():
                    brace += 1
            if brace >= end or text[brace] != "{" or brace not in close:
                continue
            at = close[brace] + 1
            first, last = line(m.start()), line(close[brace])
            if first == last:
                continue
            kind = BLOCKS[m[1]]
            counts[parent, kind] += 1
            name = f"{parent}.{kind}_{counts[parent, kind]}"
            yield path, language, name, "block", function, kind, depth, None if parent == function else parent, first, last, cut(first, last)
            if depth < most:
                yield from within(brace + 1, close[brace], name, depth + 1)

    return within(start, end, function, 1)
