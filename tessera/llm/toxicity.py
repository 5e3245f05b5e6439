"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else that is learnt from is unlabelled text, toxic and clean
together. A linear classifier over the words, and beginnings of words, that a text holds is trained in numpy on the risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

in which the second term estimates what clean text alone would cost; where it turns negative, its gradient is ascended
instead, so that the classifier doesn't learn the unlabelled toxic texts by heart. The class prior is the share of toxic
documents among the labelled ones that may be learnt from.

Features enter if their odds in positives against clean text (what the unlabelled texts hold beyond the prior's share of
the positives) are over 2 by 3.3 standard errors; so a long text of rare words scores as a short one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import trim, written

#: Bounds of the sample that is learnt from, drawn by hash of the id, and of the features: defaults of train's parameters.
#: The sample's words' hashes are all that goes to the driver.
POSITIVES, UNLABELLED, FEATURES = 3000, 6000, 4096
PREFIXES = (4, 5, 6, 7)
SIGMAS, LEAST = 3.3, 0.005
THRESHOLD = 0.7
#: Words whose features a worker keeps.
CACHE = 150_000
TOKEN = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: the CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


def features_of(word: str) -> list[int]:
    """Ids of a word and of its beginnings, which inflected and compound forms share."""
    parts = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in parts]


#: What a feature's id is xored with if two, or three and more, different words of the text have it.
LEVELS = (0, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51)


def leveled(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ids of what a text has, given how many of its words have each."""
    return np.concatenate([ids[count > k] ^ np.int64(x) for k, x in enumerate(LEVELS)])


@dataclass
class Model:
    bias: float
    weights: dict[int, float]


def screened(ids: np.ndarray, p: np.ndarray, u: np.ndarray, n_pos: int, n_unl: int, prior: float, most: int = FEATURES) -> np.ndarray:
    """Of features found in p of the positives and u of the unlabelled texts, those that tell positives from clean text; of
    more than ``most`` the surest, ties to the smaller id."""
    clean = np.maximum(0.0, u - prior * n_unl * p / max(1, n_pos))
    n_clean = max(1.0, n_unl * (1 - prior))
    odds = np.log((p + 0.5) / (n_pos + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    low = odds - SIGMAS * np.sqrt(1 / (p + 0.5) + 1 / (clean + 0.5))
    good = np.nonzero((low > np.log(2)) & (p >= max(3, LEAST * n_pos)))[0]
    return np.sort(ids[good[np.lexsort((ids[good], -low[good]))[:most]]])


def fit(pos: list[np.ndarray], unl: list[np.ndarray], ids: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """The classifier of positives and unlabelled texts, each given by those of its features that are in ids (sorted).
    Weights stay at least 0: a feature was chosen as evidence for toxicity and never speaks against it. Without
    positives or features every text gets the prior."""
    base = Model(float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), {})
    if not pos or not unl or not len(ids):
        return base
    both = pos + unl
    r, c = np.repeat(np.arange(len(both)), [len(d) for d in both]), np.searchsorted(ids, np.concatenate(both))
    n, m = len(pos), len(unl)
    w, b = np.zeros(len(ids)), base.bias
    mean, square = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, steps + 1):
        z = b + np.bincount(r, w[c], n + m)
        zp, zu = z[:n], z[n:]
        negative = soft(zu).mean() - prior * soft(zp).mean()
        g_neg = np.concatenate([-prior * sigmoid(zp) / n, sigmoid(zu) / m])
        if negative >= 0:
            g = g_neg
            g[:n] -= prior * sigmoid(-zp) / n
        else:
            g = -g_neg
        grad = np.append(np.bincount(c, g[r], len(ids)) + decay * w, g.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        move = rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]
    return Model(float(b), dict(zip(ids.tolist(), w.tolist())))


def features(docs: DataFrame, keep: np.ndarray | None = None) -> DataFrame:
    """docs with features array<long> in place of text: the ids of a text's features, or those in keep (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                own = leveled(*np.unique(np.array([f for w in words_of(t.as_py()) for f in features_of(w)], np.int64), return_counts=True))
                out.append(own if keep is None else own[np.isin(own, keep)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["positive", "features"])

    return docs.select("positive", "text").mapInArrow(run, "positive int, features array<long>")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, most: int = FEATURES) -> Model:
    """The model of the documents and labels that are not held out. Null labels and ids count for nothing, equal texts of
    a sample once, under the smallest id; an id that is labelled both ways counts as toxic, rows that share an id each with
    their text. At most ``positives`` and ``unlabelled`` texts are learnt from, those whose ids' hashes are smallest, and at
    most ``most`` features. Other columns of docs are not read."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("labelled"), F.col(label).alias("mark"))
    known = written(known.where(~held_out(F.col("labelled"))).groupBy("labelled").agg(F.max("mark").alias("mark")), "toxic-labels")
    toxic, total = known.agg(F.sum((F.col("mark") == 1).cast("long")), F.count("*")).first()
    if not toxic:
        return Model(-6.0, {})
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where(~held_out(F.col("id")))
    order = F.xxhash64("id")

    def drawn(ids: DataFrame, most: int) -> DataFrame:
        # ids alone are drawn; a bounded number of them then fetches its texts
        few = written(ids.select("id", order.alias("o")).orderBy("o", "id").limit(most), "drawn")
        return rows.join(F.broadcast(few.select("id")), "id", "left_semi").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min_by("text", "id").alias("text"))

    pos = drawn(known.where("mark = 1").select(F.col("labelled").alias("id")), positives)
    unl = drawn(rows.select("id"), unlabelled)
    both = written(pos.select(F.lit(1).alias("positive"), "text").unionByName(unl.select(F.lit(0).alias("positive"), "text")), "sample")
    n_pos, n_unl = both.where("positive = 1").count(), both.where("positive = 0").count()
    prior = toxic / total
    found = features(both).select("positive", F.explode("features").alias("id")).groupBy("id").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u")).where("p >= 3").toArrow()
    ids, p, u = (found.column(x).to_numpy() for x in ("id", "p", "u"))
    ids = screened(ids, p.astype(float), u.astype(float), n_pos, n_unl, prior, most)
    rows = features(both, ids).toArrow()
    got: list[list] = [[], []]
    for mark, own in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        got[mark].append(np.asarray(own, np.int64))
    return fit(got[1], got[0], ids, prior)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold) added; columns of these names are replaced.

    The whole text is scored, whatever its length. Null and empty texts get the score of a text without telling words.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # as many weights as train allows at most

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bias, weights = sent.value
        known: dict[str, tuple] = {}
        for part in texts:
            out = []
            for t in part:
                own: dict[int, int] = {}
                for word in words_of(t):
                    f = known.get(word)
                    if f is None:
                        if len(known) > CACHE:
                            known.clear()
                        f = known[word] = tuple(x for x in features_of(word) if any(x ^ k in weights for k in LEVELS))
                    for x in f:
                        own[x] = own.get(x, 0) + 1
                out.append(bias + math.fsum(weights.get(x ^ k, 0.0) for x, n in own.items() for k in LEVELS[:n]))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500))))
        known.clear()
        trim()

    out = docs.withColumn("score", score(F.coalesce(F.col("text"), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
