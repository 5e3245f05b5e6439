"""Quality rules with risk-controlled thresholds. DataFrame and SQL functions only.

Each rule is a share of a text in thousandths, and rejects the texts above its cutoff. Cutoffs are chosen for each
stratum from labelled documents held out for that (nothing else is fitted to them), so that with probability
1 - ``delta`` over all strata at once the rules together reject no more than ``alpha`` of a stratum's good documents: each
of the three may reject a third of alpha.

* Cutoffs are tested from the most lenient on, each by the exact binomial bound: with k of n good documents rejected it
  passes if P(Binomial(n, alpha / 3) <= k) is at most delta / (strata * rules). The first that fails ends the sequence, so
  testing many cutoffs costs nothing (fixed-sequence testing), and the division corrects for strata and rules.
* Of the cutoffs that passed, the one wins that rejects most bad documents, a good one counting against ``weight`` bad
  ones; ties go to the more lenient. Where none passes, as in strata with few labels, the rule rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, written

ALPHA, DELTA, WEIGHT = 0.02, 0.05, 5
RULES = ("symbols", "dup_lines", "repeats")
GRID = (10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 350, 400, 500, 600, 700, 800, 900)
#: Terms of a binomial tail that are summed; what lies beyond is bounded by a geometric series.
TERMS = 2000
MIN_WORDS, MAX_REPEATS = 50, 50


def signals(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of every document.

    Words are runs of anything but ASCII white space; a null text has none. A three-word window is found again by the
    hash of its words' hashes (64 bits each). No row meets another: all of it is array work within the row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    # each step reads its predecessor's columns more than once, which keeps the steps apart and each computed once
    rows = rows.select(
        "doc_id",
        "stratum",
        F.length(F.translate("text", " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        F.transform(F.filter(F.split("text", f"[{SPACE}]+"), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = F.when(F.size("h") < 3, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(0), F.size("h") - 3), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))))
    rows = rows.select(
        "doc_id", "stratum", "word_chars", "n_symbols",
        F.size("h").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("w"),
    )
    found = F.size(F.array_distinct("w")) < F.size("w")
    pairs = F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(found, pairs))
    again = lambda x, i: (x["h"] == F.get("s", i + 1)["h"]) | (x["h"] == F.get("s", i - 1)["h"])
    rows = rows.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words"))


def measures(found: DataFrame) -> DataFrame:
    """Adds the rules' measures, in thousandths: symbols of word characters, repeated of all lines, repeated of all words."""
    share = lambda a, b: F.coalesce(F.expr(f"(1000 * {a}) div nullif({b}, 0)"), F.lit(0))
    return found.withColumns({"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "base_failed": base_failed()})


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series at x + 8."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    down = F.ln(x)
    for i in range(1, 8):
        down = down + F.ln(x + i)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), or 1 where k >= n * p; never less than the true value but for rounding."""
    k, n = k.cast("double"), n.cast("double")
    log_top = ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    ratio = lambda j: j / (n - j + 1) * F.lit(odds)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * ratio(k - i.cast("double"))
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    def total(a: Column) -> Column:
        r = ratio(F.greatest(k - TERMS, F.lit(0.0)))
        return a["sum"] + F.when(k > TERMS, a["term"] * r / (1 - r)).otherwise(0.0)

    terms = F.when(k < 1, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(0), F.least(k, F.lit(float(TERMS))).cast("int") - 1))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * F.aggregate(terms, start, step, total)))


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, weight: int = WEIGHT, label: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, n_good, good_rejected, bad_rejected): the cutoffs that won. Documents that fail the base
    rules are left out, as are null labels; one labelled both ways counts as bad."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.min(label).alias("good"))
    held = measured.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("labelled")).select("stratum", "good", *RULES)
    cut = F.array(*(F.lit(g) for g in GRID))
    # how many cutoffs of the grid a measure lies above
    level = lambda r: F.size(F.filter(cut, lambda g: F.col(r) > g))
    long = held.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES))).alias("x")).select("stratum", "x.rule", "x.level", "good")
    counts = long.groupBy("stratum", "rule", "level").agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad"))
    # every level of every stratum: its rejections are those of all levels above it
    grid = counts.select("stratum").distinct().select("stratum", F.explode(F.array(*map(F.lit, RULES))).alias("rule")).select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(len(GRID)))).alias("level"))
    full = grid.join(counts, ["stratum", "rule", "level"], "left").na.fill(0, ["good", "bad"])
    own = Window.partitionBy("stratum", "rule")
    up = own.orderBy(F.desc("level"))
    full = full.select("stratum", "rule", "level", F.sum("good").over(own).alias("n_good"), F.sum("good").over(up).alias("good_rejected"), F.sum("bad").over(up).alias("bad_rejected"))
    full = written(full.where("level > 0"), "rejections")
    tests = full.agg(F.count_distinct("stratum", "rule")).first()[0] or 1
    tried = full.withColumn("failed", (binomial_tail(F.col("good_rejected"), F.col("n_good"), alpha / len(RULES)) > delta / tests) | (F.col("n_good") == 0))
    passed = tried.withColumn("failures", F.sum(F.col("failed").cast("int")).over(up)).where("failures = 0")
    gain = F.col("bad_rejected") - weight * F.col("good_rejected")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("level"))
    won = passed.withColumn("gain", gain).where("gain > 0").withColumn("place", F.row_number().over(best)).where("place = 1")
    return won.select("stratum", "rule", F.get(cut, F.col("level") - 1).alias("cutoff"), "n_good", "good_rejected", "bad_rejected")


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, weight: int = WEIGHT) -> DataFrame:
    """Every document's signals, base_failed, the cutoffs that hold for it (null: none), and kept.

    A null lang is a stratum of its own. An empty table gives an empty one; without labels only the base rules reject.
    Repeated ids keep their rows, each judged by its own text.
    """
    measured = written(measures(signals(docs)), "signals")
    cuts = thresholds(measured, labels, alpha, delta, weight)
    wide = written(cuts.groupBy(F.col("stratum").alias("of")).agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES)), "thresholds")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return measured.join(wide, measured.stratum == wide.of, "left").withColumn("kept", ~F.col("base_failed") & ~over).drop("of")
