"""Exact top-k by integer inner product: columnar branch and bound.

Components become floor(1024 * x). Candidates lie in vertical layout, one row of a matrix for each dimension. A query
adds up its products dimension block by dimension block; what the remaining blocks can still add or take away is at
most the product of the remaining norms (Cauchy-Schwarz). A candidate whose sum plus that bound lies under the k-th
largest sum less bound can't be among the k best, and the survivors are compacted before the next block.

Queries are written in blocks of ``query_rows`` to files in the shared folder. One pass over the candidates takes up to
HELD of them at a time and reads the blocks one after another, so a task holds one block and its candidates, whatever
their number. It keeps the k best of each query, its own k-th best so far bounding the next batch; a grouped maximum over
all tasks' picks the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import new_path, partitions, written
from tessera.llm.files import NewFile, Ranges

SCALE = 1024
BLOCK_DIMS = 8
QUERY_ROWS = 1024
#: Candidates that are laid out and searched at a time, and that a task holds while it reads the blocks of queries.
CANDIDATES, HELD = 16_384, 65_536
#: Sums under this are exact in doubles.
EXACT = 2**52
LONG = 2**63 - 1


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double> of whole numbers) of the vectors that take part: those with an id and without null or
    non-finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # a double times 1024 is exact, and so is its floor; F.floor would give a long, which can overflow
    whole = lambda x: F.when(F.abs(x) < 2.0**42, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok).withColumn("v", F.transform("v", whole))


def best(ids: np.ndarray, columns: np.ndarray, norms: np.ndarray, query_id: int, query: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates with a score of ``least`` at least, ties to smaller ids.

    columns: dimensions x candidates; norms: row b holds the norms of what comes from block b on, zeros last.
    """
    rest = np.sqrt(np.concatenate([np.add.reduceat(query**2, np.arange(0, len(query), BLOCK_DIMS))[::-1].cumsum()[::-1], [0.0]])) if len(query) else np.zeros(1)
    live = np.nonzero(ids != query_id)[0]
    score = np.zeros(len(live))
    for b, d in enumerate(range(0, len(query), BLOCK_DIMS)):
        score += query[d : d + BLOCK_DIMS] @ (columns[d : d + BLOCK_DIMS] if len(live) == columns.shape[1] else columns[d : d + BLOCK_DIMS, live])
        if len(live) > k or least > -np.inf:
            bound = norms[b + 1, live] * rest[b + 1] * (1 + 1e-9)
            floor = max(least, np.partition(score - bound, len(live) - k)[len(live) - k] if len(live) > k else least)
            keep = score + bound >= floor
            if not keep.all():
                live, score = live[keep], score[keep]
    order = np.lexsort((ids[live], -score))[:k]
    return ids[live[order]], score[order]


def best_large(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[list, list]:
    """The same in whole numbers of any size; scores beyond a long count as the nearest long."""
    q = [int(x) for x in query]
    scores = [max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(q, v)))) for v in vectors]
    rows = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != query_id)[:k]
    return [i for _, i in rows], [-s for s, _ in rows]


def write_blocks(asked: DataFrame, folder: str, rows: int) -> list[tuple[str, int, int]]:
    """Writes queries (vec_id, v) in blocks of at most ``rows`` of one length; returns (file, length, queries) of each:
    the one list that the driver holds, a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        out = []

        def flush(size: int) -> None:
            own = held.pop(size)
            file = NewFile(folder, ".block")
            file.write(np.array([i for i, _ in own], "<i8").tobytes() + np.array([v for _, v in own], "<f8").tobytes())
            file.close()
            out.append((file.name, size, len(own)))

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = v.values.to_numpy()
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) == rows:
                    flush(len(x))
        for size in sorted(held):
            flush(size)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "length", "queries"])

    dealt = asked.repartitionByRange(partitions(asked.sparkSession), "vec_id").sortWithinPartitions("vec_id")
    return sorted(map(tuple, written(dealt.mapInArrow(run, "file string, length long, queries long"), "blocks").collect()))


def laid_out(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vertical columns and norms (see best) of candidates."""
    dims = v.shape[1]
    columns = np.ascontiguousarray(v.T)
    sums = np.add.reduceat(columns**2, np.arange(0, dims, BLOCK_DIMS), axis=0) if dims else np.zeros((0, len(ids)))
    return ids, columns, np.sqrt(np.concatenate([sums[::-1].cumsum(0)[::-1], np.zeros((1, len(ids)))]))


def search(candidates: DataFrame, folder: str, blocks: list[tuple[str, int, int]], k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each task's candidates for each query of the blocks."""

    def found(held: dict[int, tuple[list, list]]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder, 1)
        for dims in sorted(held):
            ids, v = np.concatenate(held[dims][0]), np.concatenate(held[dims][1])
            v = v.reshape(len(ids), dims)
            chunks = [laid_out(ids[i : i + CANDIDATES], v[i : i + CANDIDATES]) for i in range(0, len(ids), CANDIDATES)]
            del v
            largest = max(float(c[2][0].max()) for c in chunks)
            for file, length, n in blocks:
                if length != dims:
                    continue
                raw = files.read(file, 0, 8 * n * (1 + dims))
                qid, q = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<f8", offset=8 * n).reshape(n, dims)
                small = largest * np.sqrt((q**2).sum(1).max()) < EXACT
                rows: list[tuple] = []
                for i, x in zip(qid.tolist(), q):
                    top: list[tuple[int, int]] = []  # minus score, id
                    for own, columns, norms in chunks:
                        got = best(own, columns, norms, i, x, k, -top[-1][0] if len(top) == k else -np.inf) if small else best_large(own, columns.T, i, x, k)
                        top = sorted([*top, *((-int(s), int(c)) for c, s in zip(*got))])[:k]
                    rows += [(i, c, -s) for s, c in top]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            size = np.diff(b.column(1).offsets.to_numpy())
            for dims in np.unique(size).tolist():
                part = b.filter(pa.array(size == dims))
                own = held.setdefault(dims, ([], []))
                own[0].append(part.column(0).to_numpy())
                own[1].append(part.column(1).flatten().to_numpy())
            n += b.num_rows
            if n >= HELD:
                yield from found(held)
                held, n = {}, 0
        yield from found(held)

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every vector whose id is divisible by ``every``.

    Candidates are all vectors but those of the query's own id; vectors of another length than the query's are not
    compared with it. If an id occurs twice, its rows are two queries of that id with one result, that of the row with
    the smaller components, and two candidates. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    folder = new_path(spark, "queries")
    rows = written(scaled(vectors), "vectors")
    blocks = write_blocks(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), folder, query_rows)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return search(rows, folder, blocks, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
