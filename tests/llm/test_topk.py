import numpy as np
import pytest

from tessera.llm import topk


def brute(rows, k=10, every=100):
    import math

    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -m) for r, (m, i) in enumerate(s)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)


def test_random_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 32)
    monkeypatch.setattr(topk, "HELD", 100)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 19)]) for i in range(430)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]
    rows += [(50 + i, rows[i % 9][1]) for i in range(4)]  # repeated ids
    rows += [(2000, None), (2100, [1.0, None] * 9 + [1.0]), (2200, [float("nan")] * 19), (2300, [float("inf")] * 19), (None, rows[0][1]), (2400, [0.0] * 19), (2500, []), (2600, [1.0]), (-100, rows[3][1]), (2701, [0.5])]
    got = sorted(map(tuple, topk.top_k(frame(spark, rows), query_rows=4).collect()))
    assert got == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(100 * i, [float(np.float32(x)) for x in v]) for i, v in enumerate([[3e9, 1.0], [3e9, 2.0], [-3e9, 1.5], [1.0, 1.0]])]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows)).collect())) == brute(rows)


def test_given_table_and_empty(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert sorted(map(tuple, topk.top_k(e).collect())) == brute([(r.vec_id, r.embedding) for r in e.collect()])
    assert topk.top_k(e.where("false")).count() == 0


def test_bounds_prune():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(0, 100, (500, 64)) * np.exp(-np.arange(64) / 6))
    ids, cols = np.arange(500), np.ascontiguousarray(v.T)
    sums = np.add.reduceat(cols**2, np.arange(0, 64, 8), axis=0)
    norms = np.sqrt(np.concatenate([sums[::-1].cumsum(0)[::-1], np.zeros((1, 500))]))
    got, score = topk.best(ids, cols, norms, 0, v[0], 5)
    full = v @ v[0]
    full[0] = -np.inf
    assert got.tolist() == np.lexsort((ids, -full))[:5].tolist() and score.tolist() == full[got].tolist()
