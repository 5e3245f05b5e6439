import hashlib
import math

import numpy as np

from tessera.llm import centroids


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in ok)[:k]
    cent = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cent)) for _, v in ok]

    for _ in range(rounds):
        own = assign()
        for j in range(len(cent)):
            if mine := [v for (_, v), (_, c) in zip(ok, own) if c == j]:
                cent[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    cap = lambda x: min(x, 2**63 - 1)
    inertia = {j: sum(cap(d) for d, c in own if c == j) for j in range(len(cent))}
    return sorted((i, c, cap(d), cap(inertia[c]), cap(sum(inertia.values())), hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(ok, own))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string").repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()))


def floats(rng, n, dims, size=0.125):
    return [[float(np.float32(x)) for x in v] for v in rng.normal(0, size, (n, dims))]


def test_given_table_and_empty(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(centroids.clustered(e)) == brute([(r.vec_id, r.embedding) for r in e.collect()])
    assert got(centroids.clustered(e.where("false"))) == []


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    rows = list(enumerate(floats(rng, 300, 64)))
    rows += [(1000 + i, rows[i % 5][1]) for i in range(50)] + [(3, rows[7][1]), (3, rows[7][1])]
    rows += [(2000, None), (2001, rows[0][1][:63]), (2002, [None] * 64), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (None, rows[0][1]), (2005, []), (-1, [0.0] * 64)]
    assert got(centroids.clustered(frame(spark, rows))) == brute(rows)


def test_few_vectors_and_empty_clusters(spark):
    rows = [(i, [float(i // 4)] * 64) for i in range(12)]
    assert got(centroids.clustered(frame(spark, rows))) == brute(rows)


def test_large_components(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(floats(rng, 60, 64, 1e9))) + [(100 + i, v) for i, v in enumerate(floats(rng, 40, 64, 0.1))]
    assert got(centroids.clustered(frame(spark, rows))) == brute(rows)


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(9)
    for size in (3, 40, 10**4, 10**6, 10**8, 10**12):
        c = rng.integers(-size, size + 1, (16, 64))
        c[5] = c[3]
        c[6] = c[3] + (np.arange(64) == 1)
        x = np.concatenate([rng.integers(-size, size + 1, (200, 64)), (c[rng.integers(0, 16, 100)] + c[rng.integers(0, 16, 100)]) // 2, c])
        full = ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2)
        want = [min(range(16), key=lambda j, r=r: (r[j], j)) for r in full]
        assert centroids.nearest(x, c).tolist() == want
        _, may = centroids.shortlist(x, c)
        assert may[np.arange(len(x)), want].all() and (size < 10 or may.sum() < may.size / 2)
