"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' tokens are raked: scaled to the target share of each
source, then of each language, then of each topic, and again, until all three hold. A document is then drawn with a
probability in proportion to its cell's raked over its real tokens, calibrated so that the expected tokens are the
wanted share of all; where that would exceed 1 it is 1, and the rest is calibrated anew. The draw is a hash of the id:
the same documents fall out of it whatever the partitions or retries.

Targets are given as tables (key, share) for any of the three; else they are the real shares to a power, which lifts small
sources, languages and topics. Raking ends when every margin is met to TOLERANCE. Targets that no weights can meet at once
(a source that is all of one language, say, with other shares for both) end it after MOST_SWEEPS, with a warning; how far
each margin is off can be asked for (margin_errors).
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, written

MARGINS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
SHARE = 0.8
#: A margin is met if it is off by no more than this share of its target; sweeps after which raking ends all the same.
TOLERANCE, MOST_SWEEPS = 1e-9, 100
#: Cells that may be raked in the driver (a few dozen bytes each); more are raked as a table.
DRIVER_CELLS = 200_000


def form_topic(text: Column, tokens: Column) -> Column:
    """A stand-in for a topic where documents carry none: the text's form."""
    bars, signs = (F.length(text) - F.length(F.translate(text, s, "")) for s in ("|", "#*$%&<>"))
    return F.when(bars * 10 >= tokens, "tabular").when(signs * 4 >= tokens, "symbolic").when(tokens >= 1000, "long").when(tokens >= 200, "medium").otherwise("short")


def celled(docs: DataFrame) -> DataFrame:
    """docs with cell_source, cell_lang, cell_topic and cell_tokens (words) added; null keys are the empty key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")).cast("long")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.withColumns({"cell_source": key("source"), "cell_lang": key("lang"), "cell_tokens": tokens}).withColumn("cell_topic", form_topic(text, F.col("cell_tokens")))


def cell_sums(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, n): tokens of every cell that has any."""
    return rows.groupBy(*(F.col(f"cell_{m}").alias(m) for m in MARGINS)).agg(F.sum("cell_tokens").alias("n")).where("n > 0")


def margin_targets(cells: DataFrame, powers: dict[str, float], targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """(key, t) for each margin: the tokens that each of its keys shall have, the cells' total in all. Of given targets
    those of keys that no cell has are left out, and keys without one get none; the rest keep their proportions."""
    total = cells.agg(F.sum("n")).first()[0]
    out = {}
    for m in MARGINS:
        own = cells.groupBy(F.col(m).alias("key")).agg(F.sum("n").cast("double").alias("n"))
        if m in targets:
            given = targets[m].select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("share").cast("double").alias("t"))
            t = own.join(given.groupBy("key").agg(F.sum("t").alias("t")), "key", "left").select("key", F.coalesce("t", F.lit(0.0)).alias("t"))
        else:
            t = own.select("key", F.pow("n", F.lit(powers[m])).alias("t"))
        all_ = t.agg(F.sum("t")).first()[0]
        if not all_:
            raise ValueError(f"no {m} of the documents has a target")
        out[m] = written(t.select("key", (F.col("t") / all_ * total).alias("t")), "targets")
    return out


def raked_arrays(keys: list[np.ndarray], n: np.ndarray, targets: list[np.ndarray], tolerance: float, most: int) -> tuple[np.ndarray, float]:
    """The raked tokens of cells with keys (small integers for each margin) and tokens n, and the error of the last sweep's
    margins, as they were before it scaled them."""
    w, error = n.astype(float), 0.0
    for _ in range(most):
        error = 0.0
        for k, t in zip(keys, targets):
            now = np.bincount(k, w, len(t))
            error = max(error, float(np.abs(now / np.where(t > 0, t, 1) - (t > 0)).max(initial=0, where=(now > 0) | (t == 0))))
            w = w * np.where(now > 0, t / np.where(now > 0, now, 1), 0)[k]
        if error <= tolerance:
            break
    return w, error


def calibrated(n: np.ndarray, w: np.ndarray, share: float) -> np.ndarray:
    """The probability of each cell's documents."""
    r, left, p = w / n, share * n.sum(), np.zeros(len(n))
    open_ = w > 0
    while open_.any():
        p[open_] = r[open_] * left / w[open_].sum()
        full = open_ & (p >= 1)
        if not full.any():
            break
        p[full] = 1.0
        left -= n[full].sum()
        open_ &= ~full
    return np.clip(p, 0, 1)


def raked_table(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float, most: int) -> tuple[DataFrame, float]:
    """The same as tables: a grouped sum and a join for every margin, written after every sweep."""
    w, error = cells.withColumn("w", F.col("n").cast("double")), 0.0
    for _ in range(most):
        error = 0.0
        for m in MARGINS:
            now = w.groupBy(F.col(m).alias("key")).agg(F.sum("w").alias("s")).join(targets[m], "key")
            off = F.when(F.col("t") > 0, F.abs(F.col("s") / F.col("t") - 1)).otherwise(F.col("s"))
            scale = written(now.select(F.col("key").alias(m), F.coalesce(F.col("t") / F.nullif("s", F.lit(0.0)), F.lit(0.0)).alias("f"), F.when((F.col("s") > 0) | (F.col("t") == 0), off).otherwise(0.0).alias("off")), "scale")
            error = max(error, scale.agg(F.max("off")).first()[0] or 0.0)
            w = w.join(scale.drop("off"), m).withColumn("w", F.col("w") * F.col("f")).drop("f")
        w = written(w, "raked")
        if error <= tolerance:
            break
    return w, error


def margin_errors(weights: DataFrame, targets: dict[str, DataFrame] | None = None, powers: dict[str, float] | None = None) -> DataFrame:
    """(margin, key, target, raked, error) of cell_weights' cells: how far every margin is off, as a share of its target."""
    wanted = margin_targets(weights, POWERS | (powers or {}), targets or {})
    out = None
    for m in MARGINS:
        now = weights.groupBy(F.col(m).alias("key")).agg(F.sum("w").alias("raked")).join(wanted[m], "key")
        one = now.select(F.lit(m).alias("margin"), "key", F.col("t").alias("target"), "raked", F.abs(F.col("raked") / F.nullif("t", F.lit(0.0)) - 1).alias("error"))
        out = one if out is None else out.unionByName(one)
    return out


def calibrated_table(raked: DataFrame, share: float) -> DataFrame:
    total = raked.agg(F.sum("n")).first()[0]
    ratio, done = F.col("w") / F.col("n"), None
    limit = float("inf")
    while True:
        # cells of a ratio over the limit are whole
        x = raked.agg(F.sum(F.when(ratio >= limit, F.col("n")).otherwise(0)), F.sum(F.when(ratio < limit, F.col("w")).otherwise(0.0))).first()
        if not x[1]:
            break
        done = max(0.0, share * total - x[0]) / x[1]
        now = 1 / done if done else float("inf")
        if now >= limit or not raked.where((ratio >= now) & (ratio < limit)).limit(1).count():
            break
        limit = now
    p = F.when(ratio >= limit, F.lit(1.0)).otherwise(F.least(F.lit(1.0), ratio * F.lit(done or 0.0)))
    return raked.withColumn("p", p)


def cell_weights(rows: DataFrame, powers: dict[str, float] | None = None, share: float = SHARE, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE, most: int = MOST_SWEEPS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, n, w, p) of the cells of celled() rows, as a written table."""
    cells = written(cell_sums(rows), "cells")
    spark, size = cells.sparkSession, cells.count()
    kind = "source string, lang string, topic string, n long, w double, p double"
    if not size:
        return spark.createDataFrame([], kind)
    wanted = margin_targets(cells, POWERS | (powers or {}), targets or {})
    if size > driver_cells:
        raked, error = raked_table(cells, wanted, tolerance, most)
        out = calibrated_table(raked, share)
    else:
        got = sorted(map(tuple, cells.collect()))
        names, keys = zip(*(np.unique([r[m] for r in got], return_inverse=True) for m in range(3)))
        own = [{r.key: r.t for r in wanted[m].collect()} for m in MARGINS]
        n = np.array([r[3] for r in got], float)
        w, error = raked_arrays(list(keys), n, [np.array([t[k] for k in x.tolist()]) for t, x in zip(own, names)], tolerance, most)
        out = spark.createDataFrame([(*r, float(a), float(b)) for r, a, b in zip(got, w, calibrated(n, w, share))], kind)
    if error > max(tolerance, 1e-6):
        warnings.warn(f"the targets can't be met at once: a margin was off by {error:.2g} of its target in the last sweep", stacklevel=2)
    return written(out, "weights")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id's MD5; a null id draws as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


ADDED = ("cell_topic", "cell_tokens", "cell_weight", "cell_p", "sampled")


def mixed(docs: DataFrame, powers: dict[str, float] | None = None, share: float = SHARE, targets: dict[str, DataFrame] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with cell_topic, cell_tokens, cell_weight (raked over real tokens), cell_p and sampled added; of docs' own
    columns those in ``keep``, else all. Where the text isn't kept, it is read once.

    Documents without words belong to no cell's tokens; they get the probability of a document of their cell, or 0 if
    that cell has no tokens at all. Rows that share an id are all drawn or all left. An empty table gives an empty one.
    Columns of docs with a name that is added (or cell_source or cell_lang) are replaced.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c not in ADDED and c not in ("cell_source", "cell_lang")]
    rows = celled(docs).select(*own, *(f"cell_{m}" for m in MARGINS), "cell_tokens")
    if "text" not in own:
        rows = written(rows, "celled")
    cells = cell_weights(rows, powers, share, targets)
    ratio = cells.select(*(F.col(m).alias(f"raked_{m}") for m in MARGINS), (F.col("w") / F.col("n")).alias("raked_weight"), F.col("p").alias("raked_p"))
    out = rows.join(ratio, [rows[f"cell_{m}"] == ratio[f"raked_{m}"] for m in MARGINS], "left")
    return out.select(
        *(rows[c] for c in own), rows["cell_topic"], rows["cell_tokens"],
        F.coalesce(ratio["raked_weight"], F.lit(0.0)).alias("cell_weight"), F.coalesce(ratio["raked_p"], F.lit(0.0)).alias("cell_p"),
        (draw(rows["doc_id"]) < F.coalesce(ratio["raked_p"], F.lit(0.0))).alias("sampled"),
    )
