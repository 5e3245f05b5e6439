"""Plugins of languages, and how they are found.

A plugin says which files are its language's, cuts units, builds labelled trees, and normalises labels for patterns. Those
of the known languages are here; others come as class paths, given or from TESSERA_PLUGINS, or as entry points. Of
several plugins of a language the first counts. What fails to load is passed over with a warning.
"""

from __future__ import annotations

import importlib
import logging
import os
import textwrap
from collections.abc import Iterable, Iterator
from importlib import metadata
from pathlib import PurePath
from typing import Any, Protocol, runtime_checkable

from tessera.operators import extract, trees
from tessera.sources.scan import LANGUAGES, SKIP

log = logging.getLogger(__name__)
GROUP = "tessera.languages"
VARIABLE = "TESSERA_PLUGINS"
# Folders of each language that are never entered.
SKIPPED = {"python": "__pycache__ venv .venv .tox .mypy_cache", "javascript": "node_modules .next .nuxt coverage", "typescript": "node_modules .next dist build", "c": "build cmake-build-debug cmake-build-release", "cpp": "build cmake-build-debug cmake-build-release", "java": "build out target .gradle", "go": "vendor"}


@runtime_checkable
class LanguagePlugin(Protocol):
    language_id: str
    file_extensions: frozenset[str]
    skip_dirs: frozenset[str]

    def units(self, code: str, path: str = "", max_depth: int = 3) -> list[tuple]:
        """Rows of extract.UNIT."""

    def tree(self, code: str) -> trees.Tree:
        """(labels, parents)."""

    def pattern(self, labels: list[str]) -> list[str]:
        """Labels whatever the operators."""


class BasePlugin:
    """A plugin's defaults: line trees, no units, patterns that are the labels themselves."""

    language_id = ""
    file_extensions: frozenset[str] = frozenset()
    skip_dirs: frozenset[str] = frozenset()

    def units(self, code: str, path: str = "", max_depth: int = 3) -> list[tuple]:
        return []

    def tree(self, code: str) -> trees.Tree:
        return trees.line_tree(code)

    def pattern(self, labels: list[str]) -> list[str]:
        return labels

    def entry(self, code: str) -> tuple:
        """What trees.ENTRY says of a text."""
        labels, parents = self.tree(code)
        own = (self.pattern(labels), parents)
        tree = (labels, parents)
        return len(labels), max(trees.node_levels(tree), default=0), trees.wl_hash(tree), trees.wl_hash(own), trees.canonical_hash(tree), trees.fingerprint(tree), trees.hierarchy(tree), trees.canonical_hash(own)


class KnownPlugin(BasePlugin):
    """One of the languages that the engine reads itself."""

    def __init__(self, language: str):
        self.language_id = language
        self.file_extensions = frozenset(f".{x}" for x, lang in LANGUAGES.items() if lang == language)
        self.skip_dirs = frozenset(SKIPPED[language].split())

    def units(self, code: str, path: str = "", max_depth: int = 3) -> list[tuple]:
        return extract.text_units(code, path, self.language_id, max_depth)

    def tree(self, code: str) -> trees.Tree:
        return trees.tree_of(code, self.language_id)

    def pattern(self, labels: list[str]) -> list[str]:
        return trees.pattern_of(labels, self.language_id)


class SyntaxTreePlugin(BasePlugin):
    """For parsers that give concrete syntax trees: nodes with type, children, start_point and end_point (row, column).

    A subclass parses, names nodes and tells functions and classes. Signs that stand alone are no nodes of the labelled
    tree; what they hold hangs on what holds them."""

    def parse(self, code: str) -> Any:
        raise NotImplementedError

    def is_function(self, node: Any) -> bool:
        raise NotImplementedError

    def is_class(self, node: Any) -> bool:
        raise NotImplementedError

    def name_of(self, node: Any) -> str:
        raise NotImplementedError

    def is_block(self, node: Any) -> bool:
        return False

    def block_type(self, node: Any) -> str:
        return str(node.type)

    def label(self, node: Any) -> str:
        return str(node.type)

    def skips(self, node: Any) -> bool:
        return not node.children and len(node.type) == 1 and not node.type.isalnum()

    def tree(self, code: str) -> trees.Tree:
        labels, parents, todo = [], [], [(self.parse(code), -1)]
        while todo:
            node, parent = todo.pop()
            if not self.skips(node):
                labels.append(self.label(node))
                parents.append(parent)
                parent = len(labels) - 1
            todo += [(c, parent) for c in reversed(node.children)]
        return labels, parents

    def every(self, node: Any) -> Iterator[Any]:
        todo = [node]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.children)

    def units(self, code: str, path: str = "", max_depth: int = 3) -> list[tuple]:
        lines, root = code.splitlines(), self.parse(code)

        def row(node: Any, kind: str, owner: str | None) -> tuple:
            first, last = node.start_point[0], node.end_point[0] + 1
            return path, self.language_id, self.name_of(node), kind, owner, None, None, None, first + 1, last, textwrap.dedent("\n".join(lines[first:last]))

        out, methods = [], set()
        for node in self.every(root):
            if self.is_class(node):
                out.append(row(node, "class", None))
                for child in node.children:
                    if self.is_function(child):
                        out.append(row(child, "method", out[-1][2] if out[-1][3] == "class" else out[-1][4]))
                        methods.add(out[-1][8:10])
        for node in self.every(root):
            if self.is_function(node) and (node.start_point[0] + 1, node.end_point[0] + 1) not in methods:
                out.append(row(node, "function", None))
        return out


class Registry:
    """Plugins by language and by file suffix."""

    def __init__(self, plugins: Iterable[LanguagePlugin] = ()):
        self.plugins: dict[str, LanguagePlugin] = {}
        self.suffixes: dict[str, str] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: LanguagePlugin) -> None:
        """Adds a plugin; a language's again replaces it, a suffix of another language is an error."""
        for x in plugin.file_extensions:
            if self.suffixes.get(x, plugin.language_id) != plugin.language_id:
                raise ValueError(f"{x} is {self.suffixes[x]}'s, not {plugin.language_id}'s")
        self.suffixes = {x: lang for x, lang in self.suffixes.items() if lang != plugin.language_id} | dict.fromkeys(plugin.file_extensions, plugin.language_id)
        self.plugins[plugin.language_id] = plugin

    def get(self, language: str) -> LanguagePlugin | None:
        return self.plugins.get(language)

    def for_file(self, path: str) -> LanguagePlugin | None:
        return self.plugins.get(self.suffixes.get(PurePath(path).suffix, ""))

    @property
    def languages(self) -> list[str]:
        return sorted(self.plugins)

    @property
    def extensions(self) -> frozenset[str]:
        return frozenset(self.suffixes)

    @property
    def skip_dirs(self) -> frozenset[str]:
        return frozenset(SKIP).union(*(p.skip_dirs for p in self.plugins.values()))


def load(path: str) -> LanguagePlugin | None:
    """The plugin of a class path ``module:Class``; None if it can't be made or is none."""
    module, _, name = path.strip().partition(":")
    try:
        plugin = getattr(importlib.import_module(module), name)()
    except Exception:  # whatever a foreign module does
        log.warning("no plugin at %s", path, exc_info=True)
        return None
    return plugin if isinstance(plugin, LanguagePlugin) and plugin.language_id else None


def env_paths(value: str | None = None) -> list[str]:
    return [x.strip() for x in (os.environ.get(VARIABLE, "") if value is None else value).split(",") if x.strip()]


def entry_points(group: str = GROUP) -> list[LanguagePlugin]:
    return [p for e in metadata.entry_points(group=group) if (p := load(e.value))]


def discover(paths: Iterable[str] = ()) -> list[LanguagePlugin]:
    """The known languages' plugins, then those of class paths, of the environment and of entry points."""
    out: dict[str, LanguagePlugin] = {lang: KnownPlugin(lang) for lang in SKIPPED}
    for p in [*filter(None, map(load, [*paths, *env_paths()])), *entry_points()]:
        out.setdefault(p.language_id, p)
    return list(out.values())


def default() -> Registry:
    return Registry(discover())
