"""Semantic tokens: decoding of relative positions, and views over the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "file_path string, line int, start_char int, length int, token_type string, modifiers array<string>, text string"


def decode(data: list[int], types: list[str], modifiers: list[str], lines: list[str]) -> Iterator[tuple]:
    """(line, start, length, type, modifiers, text) of values in groups of five: line and start relative to the token
    before, length, index of the type, bits of the modifiers. Data of another length than a multiple of five has none;
    lines that don't exist have no text, types that don't exist are named after their index."""
    if len(data) % 5:
        return
    line = start = 0
    for down, right, length, kind, bits in zip(*(iter(data),) * 5):
        line += down
        start = max(0, right if down > 0 else start + right)
        name = types[kind] if 0 <= kind < len(types) else f"unknown_{kind}"
        own = sorted(m for i, m in enumerate(modifiers) if bits >> i & 1)
        yield line, start, length, name, own, lines[line][start : start + length] if 0 <= line < len(lines) else ""


def tokens(raw: DataFrame) -> DataFrame:
    """Rows of TOKEN for raw (file_path, data, token_types, token_modifiers, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
        for b in batches:
            rows = [(p, *t) for p, *x in zip(*(c.to_pylist() for c in b.columns)) for t in decode(*(y or [] for y in x))]
            cols = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in TOKEN.split(", ")])

    return raw.select("file_path", "data", "token_types", "token_modifiers", "lines").mapInArrow(run, TOKEN)


def by_type(found: DataFrame) -> DataFrame:
    """(file_path, token_type, n, texts): how many tokens of each type, and their different texts in order."""
    return found.groupBy("file_path", "token_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("text")).alias("texts"))


# ---- an index of a file's tokens, and what language servers' tokens tell


def indexed(found: DataFrame) -> DataFrame:
    """(file_path, types, modifiers, texts array<struct<type, text>>): what tokens each file has."""
    return found.groupBy("file_path").agg(
        F.collect_set("token_type").alias("types"), F.array_distinct(F.flatten(F.collect_set("modifiers"))).alias("modifiers"),
        F.array_sort(F.collect_set(F.struct(F.col("token_type").alias("type"), "text"))).alias("texts"),
    )


def has_type(kind: str) -> Column:
    return F.array_contains("types", kind)


def has_modifier(name: str) -> Column:
    return F.array_contains("modifiers", name)


def has_text(text: str, kind: str | None = None) -> Column:
    return F.exists("texts", lambda x: (x["text"] == text) & (F.lit(kind is None) | (x["type"] == F.lit(kind or ""))))


def texts_of(kind: str) -> Column:
    """The different texts of a type, in order, as one text; empty without any."""
    return F.array_join(F.array_sort(F.transform(F.filter("texts", lambda x: (x["type"] == kind) & (x["text"] != "")), lambda x: x["text"])), ",")


def count_type(found: DataFrame, kind: str) -> DataFrame:
    """(file_path, n): how many tokens of a type each file has."""
    return found.groupBy("file_path").agg(F.count_if(F.col("token_type") == kind).alias("n"))


def if_type(kind: str, value: str = "yes") -> Column:
    return F.when(has_type(kind), value)


def if_texts(kind: str) -> Column:
    return F.nullif(texts_of(kind), F.lit(""))


def if_keyword(text: str, value: str) -> Column:
    return F.when(has_text(text, "keyword"), value)


def yes_no(x: Column) -> Column:
    return F.when(x, "yes").otherwise("no")


def parts(none: str | None, **found: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(",", *(F.when(x, F.lit(n)) for n, x in found.items())), F.lit("")), F.lit(none).cast("string"))


def either(a: Column, name_a: str, b: Column, name_b: str) -> Column:
    return F.when(a & b, "both").when(a, name_a).when(b, name_b).otherwise("none")


def clangd() -> list[tuple]:
    virtual, abstract = has_modifier("virtual"), has_modifier("abstract")
    return [
        ("typing.user_types.present", F.when(has_type("class") | has_type("struct"), "yes"), 0.95),
        ("cpp.namespace", if_texts("namespace"), 0.95),
        ("cpp.template.present", if_type("typeParameter"), 0.95),
        ("cpp.has_spaceship", F.when(has_text("<=>", "operator"), "yes"), 0.95),
        ("cpp.virtual_override", F.when(virtual | abstract, either(virtual, "virtual", abstract, "override")), 0.95),
        ("cpp.const_correctness", F.when(has_modifier("readonly"), "const_method"), 0.85),
        ("c.composite_types", parts(None, struct=has_type("struct"), enum=has_type("enum")), 0.90),
        ("c.has_macros", if_type("macro"), 0.95),
    ]


def jdtls() -> list[tuple]:
    word = lambda t: has_text(t, "keyword")
    shown = {k: has_text(k, "modifier") | has_modifier(k) for k in ("public", "private", "protected")}
    kind = F.when(word("interface") | has_type("interface"), "interface").when(word("abstract") | has_modifier("abstract"), "abstract").when(has_type("class"), "class").otherwise("none")
    return [
        ("java.annotations", F.coalesce(if_texts("annotation"), F.lit("none")), 0.95),
        ("java.access_modifiers", parts("package", **shown), 0.95),
        ("java.generic.present", yes_no(has_type("typeParameter")), 0.95),
        ("java.exception_handling", either(word("throws"), "throws", word("try") | word("catch"), "try_catch"), 0.95),
        ("java.class_kind", kind, 0.95),
        ("java.modern_features", parts("none", record=has_type("record"), sealed=word("sealed") | has_text("sealed", "modifier"), pattern_instanceof=word("instanceof"), var=word("var")), 0.95),
    ]


def tsserver() -> list[tuple]:
    return [
        ("javascript.async.present", yes_no(has_modifier("async")), 0.95),
        ("javascript.class_pattern", if_type("class", "class"), 0.95),
        ("typescript.generic.present", if_type("typeParameter"), 0.95),
        ("javascript.namespaces", if_texts("namespace"), 0.95),
        ("typescript.has_enum", if_type("enum"), 0.95),
    ]


def pyright() -> list[tuple]:
    return [
        ("python.decorators.present", if_texts("decorator"), 0.95),
        ("python.async.present", yes_no(has_modifier("async") | has_text("async", "keyword")), 0.95),
        ("python.has_type_parameters", if_type("typeParameter"), 0.95),
    ]


def gopls() -> list[tuple]:
    return [
        ("go.interface_usage", if_type("interface", "declaration"), 0.95),
        ("typing.user_types.present", if_type("struct"), 0.95),
        ("go.modern_features", if_type("typeParameter", "generics"), 0.95),
        ("go.packages", if_texts("namespace"), 0.95),
        ("go.defer_recover", if_keyword("defer", "defer"), 0.95),
        ("go.concurrency", if_keyword("go", "goroutine"), 0.95),
    ]


# Names by which servers introduce themselves, in the order in which they are tried.
SERVERS = {"clangd": clangd, "eclipse.jdt.ls": jdtls, "typescript-language-server": tsserver, "basedpyright": pyright, "gopls": gopls, "vtsls": tsserver}


def server_profile(name: Column) -> Column:
    """The known server that a name is, or else holds, in any case; null if there is none."""
    low = F.lower(name)
    return F.coalesce(*(F.when(name == k, F.lit(k)) for k in SERVERS), *(F.when(low.contains(k.lower()), F.lit(k)) for k in SERVERS))


def server_signals(found: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_id, key, value, confidence, origin) of the tokens of files (file_path, unit_id, server); files whose server
    isn't known, or that have no tokens, have none."""
    rows = indexed(found).join(files.select("file_path", "unit_id", server_profile(F.col("server")).alias("profile")), "file_path")
    own = F.lit(None)
    for name, profile in SERVERS.items():
        all_ = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(p).alias("confidence"), F.lit("lsp").alias("origin")) for k, v, p in profile()))
        own = F.when(F.col("profile") == name, F.filter(all_, lambda s: s["value"].isNotNull())).otherwise(own)
    return rows.select(F.col("unit_id").cast("long").alias("unit_id"), F.explode(own).alias("s")).select("unit_id", "s.*")
