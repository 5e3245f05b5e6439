"""What the operators share: tables in the shared folder, batch helpers, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textops import mix

#: Words are runs of characters that are none of these; bytes.split() takes the same set.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where that is unset and all runs in one
    process, as in tests, a temporary folder is set once for the session. On a cluster the setting is required."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.conf.get("tessera.scratch.dir", None)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.scratch.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where set, a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The tables made within each open ``scratch``.
_made: list[list[str]] = []


def deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables of ``written`` that are made within go at its end, but those to be kept."""
    own: list[str] = []
    _made.append(own)
    try:
        yield
    finally:
        _made.remove(own)
        for path in own:
            deleted(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: its lineage, and its shuffle files, end there. One to be
    kept outlives the ``scratch`` it is made in."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    for own in _made[-1:] if not keep else _made[-2:-1]:
        own.append(path)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    ours = shared_dir(spark).split(":", 1)[-1].lstrip("/") + "/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.split(":", 1)[-1].lstrip("/").startswith(ours):
            deleted(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_group(process: Callable[[pa.Table], pa.RecordBatch | None], keys: list[str], rows: int = 200_000) -> Callable:
    """For mapInArrow over partitions sorted by keys: calls process with tables of whole groups, about ``rows``
    rows or one larger group at a time, whatever batches the groups arrive in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            whole, start = pa.Table.from_batches(held), 0
            for at in group_starts(whole, keys)[1:].tolist():
                if at - start >= rows:
                    if (out := process(whole.slice(start, at - start))) is not None:
                        yield out
                    start = at
            if start:
                rest = whole.slice(start).combine_chunks()
                held = rest.to_batches()
                n = rest.num_rows
        if held and (out := process(pa.Table.from_batches(held))) is not None:
            yield out
        held.clear()
        trim()

    return run


def group_starts(whole: pa.Table, keys: list[str]) -> np.ndarray:
    return starts(*(whole.column(key).combine_chunks().to_numpy(zero_copy_only=False) for key in keys))


def starts(*columns: np.ndarray) -> np.ndarray:
    """Indices at which any of the columns changes, 0 first."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


def slots(keys: np.ndarray, bits: int, turn: int = 0) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(turn)) % np.uint64(bits)).astype(np.int64)


def key_map(keys: DataFrame, bits: int, hashes: int = 1) -> np.ndarray:
    """A map of the keys (key), of a fixed size, with so many bits a key: what it doesn't hold is none of them; where it is
    full, it spares none."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for b in batches:
            for turn in range(hashes):
                own[slots(b.column(0).to_numpy(), bits, turn)] = True
        packed = np.packbits(own, bitorder="little").view(np.int64)
        at = np.nonzero(packed)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed[at])], ["at", "bits"])

    found = keys.select("key").mapInArrow(marks, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    packed = np.zeros(bits // 64, np.int64)
    packed[found["at"].to_numpy()] = found["bits"].to_numpy()
    return packed


def in_map(map_: np.ndarray, keys: np.ndarray, hashes: int = 1) -> np.ndarray:
    slot = slots(keys, 64 * len(map_))
    out = (map_[slot >> 6] >> (slot & 63)) & 1 == 1
    for turn in range(1, hashes):
        at = np.nonzero(out)[0]
        slot = slots(keys[at], 64 * len(map_), turn)
        out[at] = (map_[slot >> 6] >> (slot & 63)) & 1 == 1
    return out


def trim() -> None:
    """Gives freed memory back to the system: workers live on after a task, and others want it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Groups:
    """Union-find over 0..n-1; the root of a group is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, idx: np.ndarray) -> np.ndarray:
        r = self.up[idx]
        while True:
            nxt = self.up[r]
            if np.array_equal(nxt, r):
                self.up[idx] = r
                return r
            r = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                return
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable.

    Alternates large-star and small-star rounds: minima are aggregated map-side first and joined back from a
    written table, so a node with very many neighbours is an ordinary skewed join. Every round is a table in the
    shared folder. Nothing but counts reaches the driver.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = written(small, "cc-small")
        stars = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
        e = small
        if stars and small.select("v").join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
