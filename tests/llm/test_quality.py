import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality


def signals(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


TEXTS = [None, "", " \n\t", "a", "a b c a b c", "x x x x", "a b a b a", "l\nl\n \nl", "é🙂 #<>|\u000b\f\r b\x85c\xa0d", "a b c d a b c x b c d", "w " * 6000, "\n".join(["same line here"] * 50), "\nlead\ntrail\n"]


def test_signals_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t, None) for i, t in enumerate(TEXTS)] + [(None, "no id", "en")], "doc_id long, text string, lang string"))
    docs = docs.withColumn("n_words", F.lit(0)).withColumn("s", F.lit(""))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.signals(docs).collect()}
    assert got == {i: signals(t) for i, t in texts}


def test_binomial_tail(spark):
    cases = [(0, 10), (1, 100), (3, 700), (0, 1), (40, 5000), (2500, 150_000), (20, 1000), (19, 1000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        log = [math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.02) + (r.n - j) * math.log(0.98) for j in range(r.k + 1)]
        want = 1.0 if r.k >= 0.02 * r.n else sum(map(math.exp, log))
        assert r.p == pytest.approx(want, rel=1e-6)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, stratum string, symbols long, dup_lines long, repeats long, base_failed boolean")


def test_thresholds_hold_the_risk(spark):
    rows = [(i, "en", 0 if i < 990 else 120, 0, 0, False) for i in range(1000)]  # 1 % of the good lie above 100
    rows += [(5000 + i, "en", 300 if i % 2 else 80, 0, 0, False) for i in range(200)]
    rows += [(9000 + i, "xx", 0, 0, 0, False) for i in range(30)] + [(9500 + i, "xx", 300, 0, 0, False) for i in range(30)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 5000 or 9000 <= r[0] < 9500)) for r in rows] + [(1, 1), (77_777, 0), (5, None)], "doc_id long, quality int")
    got = [tuple(r) for r in quality.thresholds(frame(spark, rows), labels).collect()]
    # 10 of 1000 good above 100 is more than the bound allows at a level of 0.05 / 6; 30 labels prove nothing
    assert got == [("en", "symbols", 250, 1000, 0, 100)]


def test_rules_together_hold_the_risk(spark):
    """However the good documents' measures lie, the chosen cutoffs reject too many of a new sample's but rarely."""
    rng = random.Random(6)
    missed = 0
    for trial in range(12):
        shares = [rng.uniform(0.004, 0.012) for _ in range(3)]  # of the good lie above 300 in each rule
        value = lambda share: 400 if rng.random() < share else 0
        rows = [(i, "en", *(value(s) for s in shares), False) for i in range(1500)] + [(9000 + i, "en", 500, 500, 500, False) for i in range(300)]
        labels = spark.createDataFrame([(r[0], int(r[0] < 9000)) for r in rows], "doc_id long, quality int")
        cuts = {r.rule: r.cutoff for r in quality.thresholds(frame(spark, rows), labels).collect()}
        true = 1 - math.prod(1 - s for r, s in zip(quality.RULES, shares) if cuts.get(r, 999) < 400)
        missed += true > quality.ALPHA
    assert missed <= 2


def test_no_labels_empty_tables_and_ties(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.verdicts(docs, none)
    assert out.where("kept = base_failed").count() == 0 and out.count() == docs.count()
    assert quality.verdicts(docs.where("false"), none).count() == 0
    assert quality.verdicts(docs.union(docs), none).count() == 2 * docs.count()


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality.signals(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
