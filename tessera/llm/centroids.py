"""Centroid clustering of integer vectors: float32 screening, exact decisions.

A batch's inner products with all centroids come from one float32 matrix product. Its rounding is bounded for certain: a sum
of m products of numbers that were rounded to float32 errs by at most g |x| |c|, g = (m + 2) u / (1 - (m + 2) u), u = 2^-24
(every product's relative error, summed by the Cauchy-Schwarz inequality, whatever the order of the sum). So each squared
distance lies in an interval around its float value. Where one centroid's interval ends below all others begin, it is
the nearest; where intervals overlap, those centroids alone are computed again with exact integers, and of equal
distances the centroid of the smallest number counts.

Sums are exact: each task adds up its vectors by cluster, and Spark adds the tasks' sums as decimals. What reaches the
driver is the centroids, k times the dimensions.

Vectors take part that have the given number of components, none null or non-finite, and an id. Components are
floor(scale * x), held within +-2^53 (beyond that no double tells neighbours apart). Distances are exact; one that no long
holds is given as the largest long, and inertia likewise. Repeated ids are rows of their own, and among equal ids the first
centroids go by components. With fewer vectors than centroids there are as many centroids as vectors; an empty table gives no
rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import starts, trim, written

#: Components up to this size have distances that fit in a long, over up to 128 dimensions.
SMALL = 1 << 27
LARGE = 1 << 53
LONG_MAX = 2**63 - 1
#: Vectors that are multiplied at a time.
ROWS = 8192


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, and their integer components."""
    whole = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False), bool)
    rows = np.nonzero(whole)[0]
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dims)
    good = np.isfinite(flat).all(1)
    with np.errstate(over="ignore"):
        return rows[good], np.clip(np.floor(flat[good] * scale), -LARGE, LARGE).astype(np.int64)


def exact_distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from rows of c; Python's integers where a long could overflow."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= SMALL and x.shape[1] <= 128:
        d = x - c
        return np.einsum("ij,ij->i", d, d)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(1)


def shortlist(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids by the middle of their intervals, and which centroids' intervals reach into that of another
    vector's best: those that may be nearest."""
    m = x.shape[1]
    g = (m + 2) * 2.0**-24 / (1 - (m + 2) * 2.0**-24)
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    xn = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    cn = np.sqrt((centroids.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    # |c|^2 - 2 x.c orders the distances; the small share covers the double arithmetic around the float32 product
    middle = cn**2 - 2 * product
    error = 2 * g * xn[:, None] * cn + 1e-8 * (cn**2 + np.abs(product)) + 1e-6
    may = middle - error <= (middle + error).min(1)[:, None]
    return middle.argmin(1), may


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each vector, the smallest of equally near ones."""
    best, may = shortlist(x, centroids)
    open_ = np.nonzero(may.sum(1) > 1)[0]
    if len(open_):
        row, c = np.nonzero(may[open_])
        d = exact_distance(x[open_[row]], centroids[c])
        order = np.lexsort((c, d, row)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda j: (row[j], d[j], c[j])))
        first = order[starts(row[order])]
        best[open_[row[first]]] = c[first]
    return best


def batches_of(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            rows, x = integers(part.column(1), dims, scale)
            if len(rows):
                yield part.column(0).to_numpy(zero_copy_only=False)[rows], x


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    """The k vectors whose hash of salt and id is smallest: k rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for ids, x in batches_of(batches, dims, scale):
            best += [(hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in zip(ids.tolist(), x.tolist())]
            best = sorted(best)[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int64()))], ["h", "v"])

    found = vectors.mapInArrow(run, "h string, v array<long>").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64).reshape(len(found), dims)


def moved(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """The centroids after one round: the floor of their vectors' means, component by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), dims), object)
        for _, x in batches_of(batches, dims, scale):
            own = nearest(x, centroids)
            for c in np.unique(own):
                count[c] += (own == c).sum()
                sums[c] += x[own == c].sum(0).astype(object)  # a batch's sum fits in a long, a task's may not
        c = np.repeat(np.nonzero(count)[0], dims)
        pos = np.tile(np.arange(dims), int((count > 0).sum()))
        total = [str(sums[i, j]) for i, j in zip(c, pos)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(pos, pa.int32()), pa.array(total, pa.string()), pa.array(count[c], pa.int64())], ["c", "pos", "total", "n"])

    parts = vectors.mapInArrow(run, "c int, pos int, total string, n long")
    out = centroids.copy()
    for r in parts.groupBy("c", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r.c, r.pos] = int(r.total) // r.n
    return out


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    centroids = first_centroids(rows, k, dims, scale, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids, dims, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in batches_of(batches, dims, scale):
            own = nearest(x, centroids)
            d = exact_distance(x, centroids[own])
            if d.dtype == object:
                d = np.array([min(LONG_MAX, int(v)) for v in d], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])
        trim()

    schema = "vec_id long, cluster int, distance long"
    assigned = written(rows.mapInArrow(run, schema) if len(centroids) else rows.sparkSession.createDataFrame([], schema), "clusters")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows at most
    every = min(LONG_MAX, sum(int(r.own) for r in total))
    facts = rows.sparkSession.createDataFrame([(r.cluster, min(LONG_MAX, int(r.own)), every, digest[r.cluster]) for r in total], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
