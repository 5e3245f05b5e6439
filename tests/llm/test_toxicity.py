import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity


def planted(spark, n=1200):
    rng = np.random.default_rng(4)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocab, rng.integers(5, 60)))
        toxic = i % 5 == 0
        if toxic:
            words += ["vile", "Foulmouth", "foulness", "fouler"][: rng.integers(1, 5)]
        rows.append((i, " ".join(words), "en", "s", 0.5))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = planted(spark)
    return docs, labels, toxicity.train(docs, labels)


def test_held_out_is_the_crc(spark):
    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    rows = toxicity.scored(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100 and all(r.predicted == r.toxic for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert all(w >= 0 for w in model.weights.values())


def test_held_out_labels_change_nothing(fitted, spark):
    docs, labels, model = fitted
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs.withColumn("lang", F.lit("x")), turned)
    assert again.weights.keys() == model.weights.keys() and again.bias == pytest.approx(model.bias, abs=1e-6)


def test_odd_texts(fitted, spark):
    _, _, model = fitted
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "vile " * 50_000), (None, "vile vile"), (5, "Ünïcode 日本 \x85")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scored(odd, model).collect()}
    assert got[1].score == got[2].score == got[5].score < 0.5 and got[3].predicted == 1 and got[None].score == got[3].score


def test_no_labels_no_positives_and_no_documents(spark):
    docs, labels = planted(spark, 40)
    for some in (labels.where("false"), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        out = toxicity.scored(docs, toxicity.train(docs, some))
        assert out.where("predicted = 1").count() == 0 and out.count() == 40
    assert toxicity.scored(docs.where("false"), toxicity.train(docs.where("false"), labels)).count() == 0


def test_negative_risk_is_bounded():
    ids = np.array([3, 9], np.int64)
    pos = [np.array([3], np.int64)] * 20
    model = toxicity.fit(pos, [np.array([3], np.int64)] * 10 + [np.array([9], np.int64)] * 90, ids, 0.1)
    assert model.weights[3] > 2 and model.weights[9] < 0.1 and np.isfinite(model.bias)


def plain_score(text, model):
    """The score by counting over plain words, one text at a time."""
    import math
    import re

    words, count = set(re.findall(r"\w+", (text or "").lower())), {}
    for w in words:
        for f in toxicity.features_of(w):
            count[f] = count.get(f, 0) + 1
    z = model.bias
    for f, n in count.items():
        z += sum(model.weights.get(f ^ x, 0.0) for x in toxicity.LEVELS[:n])
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_plain_scorer(fitted):
    docs, _, model = fitted
    for r in toxicity.scored(docs, model).collect():
        assert r.score == pytest.approx(plain_score(r.text, model), rel=1e-9)


def risk(w, b, pos, unl, prior):
    """The non-negative risk, text by text."""
    z = lambda own: b + sum(w.get(int(x), 0.0) for x in own)
    soft = lambda v: float(np.logaddexp(0, v))
    positive = sum(soft(-z(x)) for x in pos) / len(pos)
    negative = sum(soft(z(x)) for x in unl) / len(unl) - prior * sum(soft(z(x)) for x in pos) / len(pos)
    return prior * positive + max(0.0, negative)


def test_fit_is_at_a_minimum_of_the_risk():
    rng = np.random.default_rng(8)
    ids = np.arange(1, 7)
    draw = lambda p: ids[rng.random(6) < p].astype(np.int64)
    toxic, clean = np.array([0.7, 0.5, 0.4, 0.1, 0.1, 0.3]), np.array([0.05, 0.1, 0.05, 0.1, 0.2, 0.3])
    pos = [draw(toxic) for _ in range(300)]
    unl = [draw(toxic if rng.random() < 0.2 else clean) for _ in range(900)]
    model = toxicity.fit(pos, unl, ids.astype(np.int64), 0.2, steps=4000, rate=0.02, decay=0.0)
    least = risk(model.weights, model.bias, pos, unl, 0.2)
    for k in model.weights:
        for d in (-0.15, 0.15):
            assert risk(model.weights | {k: max(0.0, model.weights[k] + d)}, model.bias, pos, unl, 0.2) >= least - 2e-4
    for d in (-0.15, 0.15):
        assert risk(model.weights, model.bias + d, pos, unl, 0.2) >= least - 2e-4


def test_partitions_repeats_and_clashes_change_no_model(fitted, spark):
    docs, labels, model = fitted
    again = toxicity.train(docs.union(docs).withColumns({"mark": F.lit(1), "o": F.lit(2), "id": F.lit(3)}).repartition(7), labels.union(labels))
    assert again.weights == model.weights and again.bias == model.bias


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.scored(docs, toxicity.train(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.6 * sum(r.toxic for r in rows) and hit >= 0.8 * sum(r.predicted for r in rows)
