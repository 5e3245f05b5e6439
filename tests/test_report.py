"""Reports that tasks number and write."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import report
from tessera.sources import store

FOUND = "kind string, group_hash string, size long, verified boolean, line_count int, block_type string, is_test boolean, keep string, locations array<string>, parents array<string>"


def findings(spark, n):
    kind = F.element_at(F.array(*map(F.lit, ("exact", "block", "pattern", "near"))), (F.col("id") % 4 + 1).cast("int"))
    return spark.range(n).select(
        kind.alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("group_hash"), F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("id") % 97 + 2).cast("long").alias("size"), (F.col("id") % 4 < 2).alias("verified"), F.lit(4).alias("line_count"),
        F.lit("for").alias("block_type"), (F.col("id") % 5 == 0).alias("is_test"), F.lit(None).cast("string").alias("keep"), F.array(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("locations"), F.lit(None).cast("array<string>").alias("parents"),
    )


def test_a_million_findings_are_numbered_by_tasks(spark):
    """A third of all findings have one size; no plan sorts findings in a single task."""
    rows = findings(spark, 1_000_000)
    got = report.numbered(rows, "is_test", F.desc("size"), "group_hash")
    s = got.agg(F.count("*"), F.count_distinct("place"), F.min("place"), F.max("place")).first()
    assert tuple(s) == (1_000_000, 1_000_000, 1, 1_000_000)
    after = got.select("place", F.struct("is_test", (-F.col("size")).alias("s"), "group_hash").alias("a"))
    later = after.select((F.col("place") - 1).alias("place"), F.col("a").alias("b"))
    assert after.join(later, "place").where("not a < b").count() == 0


def test_text_written_by_tasks_is_the_text(spark, tmp_path):
    rows, root = findings(spark, 3000), str(tmp_path / "s")
    assert store.reports(spark, root) == []
    path = report.write_report(rows, store.new_report(root), 3)
    text = report.report_text(rows, 3)
    assert report.read_report(spark, path) == text
    want = sorted(rows.collect(), key=lambda r: (r.is_test, ["exact", "block", "pattern", "near"].index(r.kind), -r["size"], r.group_hash))
    names = [r.locations[0] for r in want]
    found = [line for line in text.split("\n") if line[:1].isdigit() and " lines)" in line]
    assert len(found) == 3000 and all(line.startswith(f"{i + 1}.") and names[i] in line.split() for i, line in enumerate(found))
    assert text.startswith("=== Source code ===\n\n1. ") and text.count("=== Tests ===\n\n") == 1 and text.endswith("+ 3 suppressed\n3000 duplicate groups.")
    report.write_report(rows.where("not is_test"), store.new_report(root))
    assert len(store.reports(spark, root)) == 2 and "===" not in report.read_report(spark, store.reports(spark, root)[-1])
    assert store.clear_reports(spark, root) == 2 and store.reports(spark, root) == []


@pytest.mark.parametrize("suppressed", [0, 2])
def test_no_findings(spark, tmp_path, suppressed):
    none = spark.createDataFrame([], FOUND)
    want = "**No significant duplicates.**" + (" 2 suppressed." if suppressed else "")
    assert report.report_text(none, suppressed) == want
    assert report.read_report(spark, report.write_report(none, str(tmp_path / "r"), suppressed)) == want
