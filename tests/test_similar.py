"""Ranked similarity without naming every match, and verified groups of patterns."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import duplicates as dup
from tessera.operators import trees

ENTRY = "unit_id long, unit_type string, file_path string, node_count int, wl_hash string, fingerprint string, hierarchy array<string>"


def made(rng, n):
    """Entries of few structures, so that all tiers meet and many are equally strong; the first structure has a third."""
    out = []
    for i in range(n):
        s = 0 if i % 3 == 0 else rng.randrange(1, 12)
        hierarchy = ["r", f"h{s % 3}", f"i{s % 4}", f"j{s % 6}", f"k{s}"]
        out.append((i, rng.choice(["function", "method", "block"]), f"p{rng.randrange(9)}", 7, f"w{s}", f"g{s % 5}", hierarchy))
    return out


@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_top_similar_is_the_head_of_similar(spark, k):
    rng = random.Random(k)
    rows = made(rng, 120)
    entries = spark.createDataFrame(rows + rows[:5], ENTRY)
    probes = entries.where("unit_id < 25").withColumnRenamed("unit_id", "probe_id").unionByName(spark.createDataFrame([(90, "function", "p", 7, "none", "none", ["x", "y", "z", "z", "z"]), (91, "function", "p", 2, "w0", "g0", ["r", "h0", "i0", "j0", "k0"])], ENTRY).withColumnRenamed("unit_id", "probe_id")).dropDuplicates(["probe_id"])
    order = Window.partitionBy("probe_id").orderBy(dup.rank(F.col("match")), F.desc(F.coalesce("depth", F.lit(0))), "unit_id")
    want = dup.similar(probes, entries).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    cols = ["probe_id", "place", "unit_id", "match", "depth"]
    got = dup.top_similar(probes, entries, k).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want.select(*cols).collect()), key=str)
    assert {r.probe_id for r in got} == set(range(25))


def test_top_similar_by_other_columns_and_empty(spark):
    entries = spark.createDataFrame(made(random.Random(1), 60), ENTRY)
    probes = entries.where("unit_id < 3").withColumnRenamed("unit_id", "probe_id")
    firsts = {r.probe_id: (r.match, r.file_path) for r in dup.top_similar(probes, entries, 1, 5, ("file_path",)).join(entries.select("unit_id", "file_path"), "unit_id").collect()}
    least = dup.similar(probes, entries).join(entries.select("unit_id", "file_path"), "unit_id").where("match = 'exact'").groupBy("probe_id").agg(F.min("file_path").alias("f")).collect()
    assert firsts == {r.probe_id: ("exact", r.f) for r in least}
    assert dup.top_similar(probes, entries.where("false"), 4).count() == 0 and dup.top_similar(probes.where("false"), entries, 4).count() == 0


def test_rows_that_are_named_are_bounded_by_k(spark):
    """A structure of 20,000 entries and a probe for each of 50: the last join takes no more than k rows a structure."""
    entries = spark.range(20_000).select(F.col("id").alias("unit_id"), F.lit("function").alias("unit_type"), F.lit("p").alias("file_path"), F.lit(7).alias("node_count"), F.lit("w").alias("wl_hash"), F.lit("g").alias("fingerprint"), F.array(*map(F.lit, "abcde")).alias("hierarchy"))
    probes = entries.limit(50).withColumnRenamed("unit_id", "probe_id")
    top = dup.top_similar(probes, entries, 4)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()  # members are cut before they are shuffled
    assert top.count() == 200 and {r.unit_id for r in top.select("unit_id").distinct().collect()} == {0, 1, 2, 3}


def test_pattern_groups_are_verified_by_their_own_form(spark):
    code = "void f(int a) {\n  int x = a %s 2;\n  log(x);\n  return x;\n}"
    units = [(i, "function", "c", code % op) for i, op in enumerate("+-*")]
    e = trees.entries(spark.createDataFrame(units, "unit_id long, unit_type string, language string, code string"))
    assert e.select("canonical_hash").distinct().count() == 3 and e.select("pattern_form").distinct().count() == 1
    (group,) = dup.pattern(e).collect()
    assert (group["size"], group.n_wl, group.verified) == (3, 3, True)
    other = e.withColumn("pattern_form", F.when(F.col("unit_id") == 2, "another").otherwise(F.col("pattern_form")))
    assert not dup.pattern(other).first().verified and not dup.verified(other, dup.pattern(other), "pattern_hash").first().verified
    assert dup.pattern(e.withColumn("pattern_form", F.lit(None).cast("string"))).first().verified is None  # records of old
