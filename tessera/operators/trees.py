"""Labelled trees of code, their hashes and the entries of the index.

A unit's tree never leaves its task: parsing, refinement and canonical form are one narrow Arrow pass over the units, so
building the index shuffles nothing.
"""

from __future__ import annotations

import ast
import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.languages import javascript
from tessera.operators.labels import line_label, line_pattern, node_label, node_pattern

WL_ROUNDS, LEVEL_ROUNDS, LEVELS = 3, 2, 5
EMPTY = "empty"
#: Languages whose trees are of lines, and whose patterns drop the lines' operators.
BRACED = ("c", "cpp", "java", "go")
#: (labels, parents) with nodes in pre-order; the root's parent is -1.
Tree = tuple[list[str], list[int]]


def line_tree(code: str) -> Tree:
    """Root Module and a node for each line that isn't blank; lines that end in { or : hold those that follow, up to a
    line that starts with }."""
    labels, parents, open_ = ["Module"], [-1], [0]
    for raw in code.splitlines():
        line = raw.strip()
        if not line:
            continue
        if line[0] == "}" and len(open_) > 1:
            open_.pop()
        labels.append(line_label(line))
        parents.append(open_[-1])
        if line[-1] in "{:":
            open_.append(len(labels) - 1)
    return labels, parents


def python_tree(code: str) -> Tree:
    """The syntax tree; nothing for text that isn't Python."""
    try:
        root = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    labels, parents, todo = [], [], [(root, -1)]
    while todo:
        node, parent = todo.pop()
        labels.append(node_label(node))
        parents.append(parent)
        own = len(labels) - 1
        todo += [(c, own) for c in reversed(list(ast.iter_child_nodes(node)))]
    return labels, parents


def tree_of(code: str, language: str) -> Tree:
    """The tree of a text; scripts that can't be read, and all other languages, have one of lines."""
    if language == "python":
        return python_tree(code)
    found = javascript.tree(code, language == "typescript") if language in ("javascript", "typescript") else None
    return found or line_tree(code)


def pattern_of(labels: list[str], language: str) -> list[str]:
    """Labels whatever the operators; languages without such a rule keep theirs."""
    if language == "python":
        return [node_pattern(x) for x in labels]
    if language in ("javascript", "typescript"):
        return [javascript.pattern_label(x) for x in labels]
    return [line_pattern(x) for x in labels] if language in BRACED else labels


def md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def wl_hash(tree: Tree, rounds: int = WL_ROUNDS) -> str:
    """Weisfeiler-Leman refinement: each round a node's value takes in its parent's and its children's, sorted."""
    labels, parents = tree
    if not labels:
        return EMPTY
    h = [md5(x) for x in labels]
    for _ in range(rounds):
        below: list[list[str]] = [[] for _ in h]
        for v, p in enumerate(parents):
            if p >= 0:
                below[p].append(h[v])
        h = [md5(f"{h[v]}|{h[p] if p >= 0 else ''}|{','.join(sorted(below[v]))}") for v, p in enumerate(parents)]
    return md5(",".join(sorted(h)))


def canonical_hash(tree: Tree) -> str:
    """Equal for two trees if and only if they are isomorphic with their labels (but for SHA-256 collisions)."""
    labels, parents = tree
    if not labels:
        return EMPTY
    below: list[list[str]] = [[] for _ in labels]
    form = ""
    for v in range(len(labels) - 1, -1, -1):
        form = hashlib.sha256(f"{labels[v]}({''.join(sorted(below[v]))})".encode("utf-8", "surrogatepass")).hexdigest()
        if parents[v] >= 0:
            below[parents[v]].append(form)
    return form


def node_levels(tree: Tree) -> list[int]:
    out: list[int] = []
    for p in tree[1]:
        out.append(out[p] + 1 if p >= 0 else 0)
    return out


def hierarchy(tree: Tree, levels: int = LEVELS) -> list[str]:
    """Hashes of the tree cut below depth 1, 2, ...; below its height they repeat."""
    labels, parents = tree
    depth = node_levels(tree)
    out: list[str] = []
    for d in range(1, levels + 1):
        if out and d > max(depth, default=0) + 1:
            out.append(out[-1])
            continue
        keep = [v for v in range(len(labels)) if depth[v] < d]
        index = {v: i for i, v in enumerate(keep)}
        out.append(wl_hash(([labels[v] for v in keep], [index.get(parents[v], -1) for v in keep]), LEVEL_ROUNDS))
    return out


def fingerprint(tree: Tree) -> str:
    """Counts of nodes, edges, labels and degrees as text; equal texts are compatible trees."""
    labels, parents = tree
    if not labels:
        return EMPTY
    out = Counter(p for p in parents if p >= 0)
    counts = ",".join(f"{k}={n}" for k, n in sorted(Counter(labels).items()))
    degrees = ",".join(map(str, sorted(out.get(v, 0) for v in range(len(labels)))))
    return f"{len(labels)};{len(labels) - 1};{counts};{degrees}"


ENTRY = "node_count int, depth int, wl_hash string, pattern_hash string, canonical_hash string, fingerprint string, hierarchy array<string>, pattern_form string"


@functools.lru_cache(20_000)
def shape(labels: tuple[str, ...], parents: tuple[int, ...], language: str) -> tuple:
    """What ENTRY says of a tree: units of one structure are hashed once a worker."""
    tree = list(labels), list(parents)
    pattern = (pattern_of(tree[0], language), tree[1])
    return len(tree[0]), max(node_levels(tree), default=0), wl_hash(tree), wl_hash(pattern), canonical_hash(tree), fingerprint(tree), hierarchy(tree), canonical_hash(pattern)


def describe(code: str | None, language: str) -> tuple:
    labels, parents = tree_of(code or "", language)
    return shape(tuple(labels), tuple(parents), language)


def entries(units: DataFrame) -> DataFrame:
    """units with the columns of ENTRY added; reads code and language, keeps all columns."""
    kinds = [pa.int32(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string()]
    names = [x.split()[0] for x in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(*x) for x in zip(b.column("code").to_pylist(), b.column("language").to_pylist())]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names])

    return units.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in units.dtypes)}, {ENTRY}")
