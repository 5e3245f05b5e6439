"""Units from a language server's symbols, where a table of them is given.

Symbols come as the server's answer, JSON of either shape (nested document symbols, or flat symbol information). They are
flattened into rows that know what stands around them; units are then cut from the files by joins and column expressions.
"""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.operators import extract

# Kinds of symbols.
CLASS, METHOD, CONSTRUCTOR, INTERFACE, FUNCTION, STRUCT = 5, 6, 9, 11, 12, 23
SYMBOL = "file_path string, symbol_id int, parent_id int, name string, kind int, start_line int, start_char int, end_line int, end_char int, unit_type string, parent_name string"


def symbol(data: Any) -> dict | None:
    """(name, kind, range, children) of a symbol in either shape; None for what is none. A range that is missing, or isn't
    one, is empty at the file's start."""
    if not isinstance(data, dict):
        return None
    where = data.get("range") if "range" in data else (data.get("location") or {}).get("range")
    point = lambda p: tuple(int(((where or {}).get(p) or {}).get(k) or 0) for k in ("line", "character")) if isinstance(where, dict) or where is None else (0, 0)
    children = data.get("children") if "range" in data else None
    return {"name": str(data.get("name", "<anonymous>")), "kind": int(data.get("kind", 0) or 0), "start": point("start"), "end": point("end"), "children": [s for c in children or [] if (s := symbol(c))]}


def unit_type(kind: int, around: str | None) -> str | None:
    if kind in (CLASS, INTERFACE, STRUCT):
        return "class"
    if kind in (METHOD, CONSTRUCTOR):
        return "method"
    return None if kind != FUNCTION else "method" if around == "class" else "function"


def flattened(answer: str | None) -> Iterator[tuple]:
    """(symbol_id, parent_id, name, kind, start line, character, end line, character, unit type, parent's name) of an
    answer's symbols, parents first; what stands in a symbol that is no unit belongs to what stands around that."""
    try:
        items = json.loads(answer or "[]")
    except ValueError:
        return
    todo = [(s, None, None, None) for d in reversed(items if isinstance(items, list) else []) if (s := symbol(d))]
    n = 0
    while todo:
        s, parent, name, around = todo.pop()
        kind = unit_type(s["kind"], around)
        yield n, parent, s["name"], s["kind"], *s["start"], *s["end"], kind, name
        todo += [(c, n, s["name"] if kind else name, kind or around) for c in reversed(s["children"])]
        n += 1


def symbols(answers: DataFrame) -> DataFrame:
    """Rows of SYMBOL for answers (file_path, symbols: JSON). Text that is no JSON has none."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 5, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *s) for p, a in zip(*(c.to_pylist() for c in b.columns)) for s in flattened(a)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], [x.split()[0] for x in SYMBOL.split(", ")])

    return answers.select("file_path", "symbols").mapInArrow(run, SYMBOL)


@F.pandas_udf(StringType())
def dedent(texts: pd.Series) -> pd.Series:
    return texts.map(textwrap.dedent, na_action="ignore")


def symbol_units(found: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of extract.UNIT of the symbols (rows of SYMBOL) that are units, cut from files (file_path, language, text). A
    symbol that ends before its last line's first character ends on the line before; ranges are clamped to the file;
    imports are no units."""
    lines = files.select("file_path", "language", F.split(F.regexp_replace(F.regexp_replace("text", "\\r\\n?", "\n"), "\n$", ""), "\n").alias("lines")).where(F.length(F.array_join("lines", "")) + F.size("lines") > 1)
    rows = found.where("unit_type is not null").join(lines, "file_path")
    last = F.size("lines") - 1
    first = F.greatest(F.lit(0), F.least("start_line", last))
    end = F.when((F.col("end_char") == 0) & (F.col("end_line") > F.col("start_line")), F.col("end_line") - 1).otherwise(F.col("end_line"))
    rows = rows.withColumns({"first": first, "final": F.greatest(first, F.least(end, last))})
    rows = rows.withColumn("code", dedent(F.array_join(F.slice("lines", F.col("first") + 1, F.col("final") - F.col("first") + 1), "\n")))
    none = F.lit(None)
    return rows.where(~F.trim("code").rlike("^(from|import) ")).select(
        "file_path", "language", "name", "unit_type", "parent_name", none.cast("string").alias("block_type"), none.cast("int").alias("nesting_depth"), none.cast("string").alias("parent_block"),
        (F.col("first") + 1).cast("int").alias("line_start"), (F.col("final") + 1).cast("int").alias("line_end"), "code",
    )


def method_parents(files: DataFrame) -> DataFrame:
    """(file_path, name, line_start, line_end, class): the methods of Python files, by their syntax."""
    units = extract.units(files.where("language = 'python'"))
    return units.where("unit_type = 'method'").select("file_path", "name", "line_start", "line_end", F.col("parent_name").alias("class"))


def with_method_parents(units: DataFrame, methods: DataFrame) -> DataFrame:
    """Units whose place is a method's become methods of its class; flat symbols don't say so."""
    out = units.join(methods.dropDuplicates(["file_path", "name", "line_start", "line_end"]), ["file_path", "name", "line_start", "line_end"], "left")
    kind = F.when(F.col("class").isNotNull() & F.col("unit_type").isin("method", "function"), "method").otherwise(F.col("unit_type"))
    return out.withColumns({"unit_type": kind, "parent_name": F.coalesce("class", "parent_name")}).select(*units.columns)


def served_units(answers: DataFrame, files: DataFrame, max_depth: int = 3) -> DataFrame:
    """Units of files by their symbols, with the blocks that the files' text has."""
    own = with_method_parents(symbol_units(symbols(answers), files), method_parents(files))
    blocks = extract.units(files.join(answers.select("file_path").distinct(), "file_path", "left_semi"), max_depth).where("unit_type = 'block'")
    return own.unionByName(blocks)
