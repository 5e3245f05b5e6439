"""New content against the index: snippets, gates of writing and editing, and hints from other languages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import signals
from tessera.operators import duplicates as dup
from tessera.operators import extract, trees
from tessera.operators.report import relative

MIN_NODES = 10


def snippets(contents: DataFrame) -> DataFrame:
    """(content_id, probe_id, language, code) of contents (content_id, file_path, language, text): the whole text and its
    units but for blocks, trimmed, each different one once. A blank text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, path, language, text in zip(*(b.column(c).to_pylist() for c in ("content_id", "file_path", "language", "text"))):
                units = [r[-1] for r in extract.text_units(text or "", path or "", language or "", 0) if r[3] != dup.BLOCK]
                rows += [(i, f"{i}:{n}", language, code) for n, code in enumerate(dict.fromkeys(filter(None, map(str.strip, [text or "", *units]))))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), *[pa.string()] * 3))], ["content_id", "probe_id", "language", "code"])

    rows = contents.select(F.col("content_id").cast("long").alias("content_id"), "file_path", "language", "text")
    return rows.mapInArrow(run, "content_id long, probe_id string, language string, code string")


def matches(contents: DataFrame, entries: DataFrame, min_nodes: int = MIN_NODES) -> DataFrame:
    """(content_id, match, depth, same_language, and the entry's columns but its tree's depth): the strongest match of every
    entry."""
    found = dup.content_matches(trees.entries(snippets(contents)), entries, min_nodes)
    own = contents.select(F.col("content_id").cast("long").alias("content_id"), F.col("language").alias("content_language"))
    rows = found.join(entries.drop("depth"), "unit_id").join(own, "content_id")
    return rows.withColumn("same_language", F.col("language").eqNullSafe(F.col("content_language"))).drop("content_language")


def gate(contents: DataFrame, found: DataFrame, editing: bool = False) -> DataFrame:
    """(content_id, decision, match, file_path, name, line_start, line_end) of contents: BLOCKED where an exact match stands
    in the same language (when editing: in another file), WARNING where it is high (or exact in the edited file), SKIPPED
    where the language isn't known, else WRITE. The match named is the first by path and line."""
    rows = found.where("same_language and match in ('exact', 'high')").join(contents.select(F.col("content_id").cast("long").alias("content_id"), F.col("file_path").alias("own_path")), "content_id")
    stops = (F.col("match") == "exact") & (F.lit(not editing) | (F.col("file_path") != F.col("own_path")))
    order = Window.partitionBy("content_id").orderBy(F.when(stops, 0).otherwise(1), dup.rank(F.col("match")), "file_path", "line_start", "name")
    first = rows.withColumns({"place": F.row_number().over(order), "stops": stops}).where("place = 1")
    out = contents.select(F.col("content_id").cast("long").alias("content_id"), "language").join(first.select("content_id", "match", "stops", "file_path", "name", "line_start", "line_end"), "content_id", "left")
    decision = F.when(F.col("language").isNull(), "SKIPPED").when(F.col("stops"), "BLOCKED").when(F.col("match").isNotNull(), "WARNING").otherwise("WRITE")
    return out.select("content_id", decision.alias("decision"), "match", "file_path", "name", "line_start", "line_end")


def assist(contents: DataFrame, found: DataFrame, shown: int = 3) -> DataFrame:
    """(content_id, place, language, file_path, name, match, score, hint): of matches in other languages the ``shown``
    best, by tier and by how well their signals agree with the content's."""
    other = found.where(~F.col("same_language")).withColumn("pair_id", F.xxhash64("content_id", "unit_id"))
    sides = contents.select(F.concat(F.lit("c"), F.col("content_id").cast("string")).alias("side"), "language", F.col("text").alias("code")).unionByName(other.select(F.concat(F.lit("u"), F.col("unit_id").cast("string")).alias("side"), "language", "code").distinct())
    sides = sides.withColumn("unit_id", F.xxhash64("side"))
    pairs = other.select("pair_id", F.xxhash64(F.concat(F.lit("c"), F.col("content_id").cast("string"))).alias("a"), F.xxhash64(F.concat(F.lit("u"), F.col("unit_id").cast("string"))).alias("b"))
    compared = signals.compare(pairs, signals.signals(sides))
    ranked = signals.best_aligned(signals.aligned(other.withColumn("probe_id", F.col("content_id")), compared), shown)
    return ranked.select("content_id", "place", "language", "file_path", "name", "match", "score", "hint")


def assist_text(rows: DataFrame, root: str = "") -> str:
    own = rows.withColumn("file_path", relative(F.col("file_path"), root)).orderBy("place").collect()
    if not own:
        return ""
    return "\n".join(["ASSIST: Cross-language structural matches found (non-blocking):", *(f"  - [{r.language}] {r.file_path}:{r.name} ({r.match}; {r.hint})" for r in own), "These hints never block writes/edits; use them only for reuse guidance."])


def check_text(best, language: str) -> str:
    """The answer of a check; best: a row (match, file_path, name, line_start, line_end) or None."""
    if best is None or best.match is None:
        return "No same-language similar code found. Safe to proceed."
    place = f"{best.file_path}:{best.name}"
    if best.match == "exact":
        return f"STOP: Identical {language} code exists at {place} (lines {best.line_start}-{best.line_end}). Reuse it."
    if best.match == "high":
        return f"CAUTION: Very similar {language} code at {place}. Consider reusing or extending."
    return f"NOTE: Partially similar {language} code at {place}. Review for potential reuse."


def edited(text: str, old: str, new: str) -> tuple[str | None, str]:
    """The text with its one place of old replaced, or None, and why not."""
    if not old:
        return None, "Edit failed: old_string must not be empty."
    n = text.count(old)
    if n != 1:
        return None, "Edit failed: old_string not found. The file may have changed." if not n else f"Edit failed: old_string appears {n} times. Provide more context to make it unique."
    return text.replace(old, new, 1), ""


def diff(text: str, old: str, new: str, path: str, context: int = 1) -> str:
    """What an edit changes: the lines of old and new, with a line of context on either side, numbered."""
    lines, gone, come = text.split("\n"), old.split("\n"), new.split("\n")
    at = text[: text.index(old)].count("\n")
    delta = len(come) - len(gone)
    n, what = (abs(delta), "Added" if delta > 0 else "Removed") if delta else (len(gone), "Changed")
    row = lambda i, mark, line: f"  {i:>4} {mark}{line}"
    out = [row(i + 1, " ", lines[i]) for i in range(max(0, at - context), at)]
    out += [row(at + i + 1, "-", x) for i, x in enumerate(gone)] + [row(at + i + 1, "+", x) for i, x in enumerate(come)]
    end = at + len(gone)
    out += [row(i + 1 + delta, " ", lines[i]) for i in range(end, min(len(lines), end + context))]
    return "\n".join([f"Edited {path}", f"  {what} {n} line{'s' if n != 1 else ''}", *out])


def compare_text(structure: str, same_hash: bool, mode: str = "off", verdict: str | None = None, matches_: list[str] | None = None, mismatches: list[str] | None = None, reason: str | None = None) -> str:
    """The answer of a comparison: by structure alone (off), with the signals noted (annotate), or decided by both
    (differentiate)."""
    if mode not in ("off", "annotate", "differentiate"):
        return "Invalid semantic_mode. Supported values: off, annotate, differentiate."
    said = {"equivalent": "EQUIVALENT: The code snippets are structurally identical.", "similar": "SIMILAR: Same hash but not fully isomorphic (rare edge case)." if same_hash else "SIMILAR: Compatible structure but not identical.", "different": "DIFFERENT: The code snippets are structurally different."}[structure]
    if mode == "off":
        return said
    if verdict in (None, "inconclusive"):
        return f"{said} SEMANTIC_INCONCLUSIVE: {reason}." if mode == "annotate" else f"INCONCLUSIVE: differentiate mode could not reach high-confidence overlap. {reason}."
    if verdict == "compatible":
        if mode == "differentiate" and structure == "equivalent":
            return "EQUIVALENT: The code snippets are structurally identical and semantically aligned."
        return f"{said} SEMANTIC_MATCH" + (f": compared {', '.join(matches_)}." if matches_ else ".")
    off = "; ".join((mismatches or [])[:3])
    if structure == "equivalent":
        return f"EQUIVALENT (STRUCTURE) but SEMANTIC_MISMATCH: {off}." if mode == "annotate" else f"DIFFERENT: Structurally equivalent snippets diverge semantically ({off})."
    return f"{said} SEMANTIC_MISMATCH: {off}."


def compare(spark: SparkSession, one: str, two: str, language: str, mode: str = "off") -> str:
    """Compares two snippets."""
    a, b = (trees.describe(x, language) for x in (one, two))
    structure = "equivalent" if a[4] == b[4] else "similar" if a[2] == b[2] or a[5] == b[5] else "different"
    if mode not in ("annotate", "differentiate"):
        return compare_text(structure, a[2] == b[2], mode)
    units = spark.createDataFrame([(1, language, one), (2, language, two)], "unit_id long, language string, code string")
    pair = spark.createDataFrame([(1, 1, 2)], "pair_id long, a long, b long")
    r = signals.compare(pair, signals.signals(units)).first()
    return compare_text(structure, a[2] == b[2], mode, r.verdict, r.matches, r.mismatches, r.reason)
