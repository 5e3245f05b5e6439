"""Units of source files: functions, methods, classes and blocks."""

from __future__ import annotations

import ast
import textwrap
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.languages import braces, javascript

MAX_BLOCK_DEPTH = 3
UNIT = "file_path string, language string, name string, unit_type string, parent_name string, block_type string, nesting_depth int, parent_block string, line_start int, line_end int, code string"
# Statements that are blocks of their own, and their names.
PYTHON_BLOCKS = {"For": "for", "AsyncFor": "async_for", "While": "while", "If": "if", "Try": "try", "TryStar": "try", "With": "with", "AsyncWith": "async_with", "Match": "match"}


def python_units(code: str, path: str = "", max_depth: int = MAX_BLOCK_DEPTH) -> Iterator[tuple]:
    """Rows of UNIT. Text that isn't Python has none; a unit starts at its def or class line, decorators stay outside."""
    try:
        root = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = code.splitlines()
    cut = lambda n: textwrap.dedent("\n".join(lines[n.lineno - 1 : n.end_lineno]))
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def blocks(node: ast.AST, function: str, parent: str, depth: int, counts: Counter) -> Iterator[tuple]:
        if depth > max_depth:
            return
        for child in ast.iter_child_nodes(node):
            kind = PYTHON_BLOCKS.get(type(child).__name__)
            if kind:
                counts[parent, kind] += 1
                name = f"{parent}.{kind}_{counts[parent, kind]}"
                yield path, "python", name, "block", function, kind, depth, None if parent == function else parent, child.lineno, child.end_lineno, cut(child)
                yield from blocks(child, function, name, depth + 1, counts)

    def function(node: ast.AST, kind: str, parent: str | None) -> Iterator[tuple]:
        yield path, "python", node.name, kind, parent, None, None, None, node.lineno, node.end_lineno, cut(node)
        yield from blocks(node, node.name, node.name, 1, Counter())

    methods = set()
    for node in ast.walk(root):
        if isinstance(node, ast.ClassDef):
            yield path, "python", node.name, "class", None, None, None, None, node.lineno, node.end_lineno, cut(node)
            for child in node.body:
                if isinstance(child, functions):
                    methods.add((child.lineno, child.end_lineno))
                    yield from function(child, "method", node.name)
    for node in ast.walk(root):
        if isinstance(node, functions) and (node.lineno, node.end_lineno) not in methods:
            yield from function(node, "function", None)


def text_units(code: str, path: str = "", language: str = "python", max_depth: int = MAX_BLOCK_DEPTH) -> list[tuple]:
    """Rows of UNIT of a text in any language: Python and the two scripts by their syntax, all others, and scripts that
    can't be read, by their braces."""
    if language == "python":
        return list(python_units(code, path, max_depth))
    found = javascript.units(code, path, language, max_depth) if language in ("javascript", "typescript") else None
    return braces.units(code, path, language, max_depth) if found is None else found


def units(files: DataFrame, max_depth: int = MAX_BLOCK_DEPTH) -> DataFrame:
    """Rows of UNIT for files (file_path, language, text); null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.string()] * 6, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            rows: list[tuple] = []
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("file_path", "language", "text"))):
                rows += text_units(text or "", path, language or "", max_depth)
            cols = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in UNIT.split(", ")])

    return files.select("file_path", "language", "text").mapInArrow(run, UNIT)
