"""The index on disk: snapshots of Parquet tables in one folder, on any store that Spark reads.

A snapshot is a folder of its own that counts once its marker is written, after all of its tables; readers take the
newest that has one. A writer that dies leaves no half index, and nothing is ever overwritten: a snapshot's name holds the
time and a random part, so that two writers never share one, and its marker is made once or not at all.

Changes of some files are written as deltas, a snapshot each: entries that came, files whose entries went, suppressions
that came or went. A read merges all deltas with the last whole snapshot at once: the version that a row came in against
the last that its key went in, one join whatever number of deltas there are. Compacting writes the state anew, and names
the deltas that it covers: one that another writer finished meanwhile, whatever its name, still counts.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
PREFIX = f"schema{SCHEMA_VERSION}-"
DELTA = "-delta"
#: Deltas after which a writer compacts.
MOST_DELTAS = 64
COMPACTED = "compacted"
REPORT = "analysis_report_"
#: Bytes of a row group: what a read by key takes of a file.
ROW_GROUP = 16 << 20
TABLES = {"entries": "file_path", "metadata": "file_path", "suppressions": "hash"}


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Names of the whole snapshots, oldest first. Those of another schema version are left alone, not dropped."""
    fs, path = _fs(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory()]
    return sorted(n for n in names if n.startswith(PREFIX) and fs.exists(path(f"{root}/{n}/WHOLE")))


def _new(spark: SparkSession, root: str, kind: str = "") -> str:
    """A name after all others'."""
    old = [int(n.removeprefix(PREFIX).split("-")[0]) for n in snapshots(spark, root)]
    return f"{PREFIX}{max([*old, int(time.time() * 1000) - 1]) + 1:016d}-{uuid.uuid4().hex[:12]}{kind}"


def _put(df: DataFrame, path: str, table: str) -> None:
    """Writes a table for reads by key. Each task sorts its own rows by the table's key and gives row groups Bloom filters
    of key and id where they aren't dictionaries, so a read of one file or id takes the row groups that hold it; nothing
    is shuffled for it."""
    keys = [c for c in (TABLES[table], "unit_id") if c in df.columns]
    out = (df.sortWithinPartitions(keys[0]) if keys else df).write.option("parquet.block.size", ROW_GROUP).option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in keys:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def _write(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], covered: list[str] | None = None) -> str:
    """Writes tables and then their marker, which names the deltas that they cover."""
    for table, df in tables.items():
        if table in TABLES:
            _put(df, f"{root}/{name}/{table}", table)
        else:
            df.write.parquet(f"{root}/{name}/{table}")
    fs, path = _fs(spark, root)
    out = fs.create(path(f"{root}/{name}/WHOLE"), False)
    if covered is not None:
        out.write(bytearray("\n".join([COMPACTED, *covered]).encode()))
    out.close()
    return name


def _covered(spark: SparkSession, root: str, name: str) -> list[str] | None:
    """The deltas that a compaction covers; None for a snapshot that stands for all before it."""
    fs, path = _fs(spark, root)
    at = path(f"{root}/{name}/WHOLE")
    n = fs.getFileStatus(at).getLen()
    if not n:
        return None
    source = fs.open(at)
    try:
        return bytes(source.readNBytes(n)).decode().split("\n")[1:]
    finally:
        source.close()


def layers(spark: SparkSession, root: str, table: str, upto: str | None = None) -> tuple[str | None, list[str]]:
    """The last whole snapshot that has the table and the deltas to be laid over it, oldest first; upto: as of that one."""
    known = snapshots(spark, root)
    if upto is not None:
        known = known[: known.index(upto) + 1] if upto in known else []
    last = next((i for i in reversed(range(len(known))) if not known[i].endswith(DELTA) and _has(spark, root, known[i], table)), None)
    if last is None:
        deltas = [n for n in known if n.endswith(DELTA)]
        return None, deltas if any(_has(spark, root, n, table) for n in deltas) else []
    covered = _covered(spark, root, known[last])
    late = [n for n in known[:last] if n.endswith(DELTA) and n not in set(covered)] if covered is not None else []
    return known[last], late + [n for n in known[last + 1 :] if n.endswith(DELTA)]


def save(tables: dict[str, DataFrame], root: str) -> str:
    """Writes the tables as the next snapshot; returns its name."""
    spark = next(iter(tables.values())).sparkSession
    return _write(spark, root, _new(spark, root), tables)


def save_delta(spark: SparkSession, root: str, gone: DataFrame | None = None, **came: DataFrame) -> str:
    """Writes what changed: gone (table, key) names rows that went by their table and its key (a file's path, a
    suppression's hash), and rows that came replace those of their keys. Returns the delta's name."""
    out = gone.select("table", "key") if gone is not None else None
    if out is None and not came:
        raise ValueError("nothing changed")
    name = _new(spark, root, DELTA)
    for t, df in came.items():
        _put(df, f"{root}/{name}/{t}", t)
        keys = spark.read.schema(df.schema).parquet(f"{root}/{name}/{t}").select(F.lit(t).alias("table"), F.col(TABLES[t]).alias("key"))
        out = keys if out is None else out.unionByName(keys)
    return _write(spark, root, name, {"gone": out.distinct()})


def _has(spark: SparkSession, root: str, name: str, table: str) -> bool:
    fs, path = _fs(spark, root)
    return fs.exists(path(f"{root}/{name}/{table}"))


def load(spark: SparkSession, root: str, table: str, snapshot: str | None = None) -> DataFrame | None:
    """A table as of the newest (or the named) snapshot, deltas laid over; None if there is none. A row counts if its key
    went in no later version than the row came in; all deltas are one scan, and one join tells."""
    whole, deltas = layers(spark, root, table, snapshot)
    key, at = TABLES[table], F.regexp_extract("_metadata.file_path", f"/({PREFIX}[^/]+)/", 1)
    base = spark.read.parquet(f"{root}/{whole}/{table}") if whole else None
    if not deltas:
        return base
    parts = [f"{root}/{n}/{table}" for n in deltas if _has(spark, root, n, table)]
    came = spark.read.option("mergeSchema", "true").parquet(*parts).withColumn("_version", at) if parts else None
    rows = None if base is None else base.withColumn("_version", F.lit(""))
    if came is not None:
        rows = came if rows is None else rows.unionByName(came, allowMissingColumns=True)
    if rows is None:
        return None
    gone = spark.read.parquet(*(f"{root}/{n}/gone" for n in deltas)).where(F.col("table") == table)
    went = gone.groupBy(F.col("key").alias(key)).agg(F.max(at).alias("_went"))
    return rows.join(went, key, "left").where(F.col("_went").isNull() | (F.col("_went") <= F.col("_version"))).drop("_version", "_went")


def compact(spark: SparkSession, root: str) -> str | None:
    """Writes the newest state as a whole snapshot; its name, or None if there is nothing."""
    known = snapshots(spark, root)
    tables = {t: df for t in TABLES if known and (df := load(spark, root, t, known[-1])) is not None}
    return _write(spark, root, _new(spark, root), tables, [n for n in known if n.endswith(DELTA)]) if tables else None


def compact_many(spark: SparkSession, root: str, most: int = MOST_DELTAS) -> str | None:
    """compact(), where over ``most`` deltas are laid over at each read."""
    return compact(spark, root) if max(len(layers(spark, root, t)[1]) for t in TABLES) > most else None


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the newest whole snapshots, and the deltas before them that the newest stands for."""
    fs, path = _fs(spark, root)
    known = snapshots(spark, root)
    whole = [n for n in known if not n.endswith(DELTA)]
    if len(whole) > keep:
        used = {n for t in TABLES for n in layers(spark, root, t)[1]}
        for name in known[: known.index(whole[-keep])]:
            if name not in used:
                fs.delete(path(f"{root}/{name}"), True)


def erase(spark: SparkSession, root: str) -> bool:
    """Deletes all snapshots, of this schema version or another; whether there was anything."""
    fs, path = _fs(spark, root)
    return bool(fs.exists(path(root)) and fs.delete(path(root), True))


def quarantine(spark: SparkSession, root: str) -> list[str]:
    """Renames whole snapshots whose tables can't be read, so that the ones before count; the names they had."""
    fs, path = _fs(spark, root)
    bad = []
    for name in snapshots(spark, root):
        tables = [s.getPath().getName() for s in fs.listStatus(path(f"{root}/{name}")) if s.isDirectory()]
        try:
            for t in tables:
                spark.read.parquet(f"{root}/{name}/{t}").limit(1).collect()
        except Exception:  # damaged in whatever way
            fs.rename(path(f"{root}/{name}"), path(f"{root}/corrupt-{int(time.time())}-{name}"))
            bad.append(name)
    return bad


# ---- reports beside the snapshots


def reports(spark: SparkSession, root: str) -> list[str]:
    """Folders of the reports that are whole, oldest first."""
    fs, path = _fs(spark, root)
    found = fs.globStatus(path(f"{root}/{REPORT}*/_SUCCESS")) or []
    return sorted(s.getPath().getParent().toString() for s in found)


def new_report(root: str) -> str:
    """The folder of a report that is to be written, named by its time."""
    return f"{root}/{REPORT}{time.strftime('%Y%m%d_%H%M%S')}_{time.time_ns() % 10**9:09d}"


def clear_reports(spark: SparkSession, root: str) -> int:
    """Deletes all reports; how many there were."""
    fs, path = _fs(spark, root)
    found = reports(spark, root)
    for name in found:
        fs.delete(path(name), True)
    return len(found)


# ---- reads by key


def file_entries(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.col("file_path") == path)


def entry(entries: DataFrame, unit_id) -> DataFrame:
    return entries.where(F.col("unit_id") == unit_id)


def some_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("unit_id"), "unit_id", "left_semi")


def node_counts(entries: DataFrame) -> DataFrame:
    """(unit_id, node_count, depth, hierarchy): the columns that most queries need, and all that is read for them."""
    return entries.select("unit_id", "node_count", "depth", "hierarchy")


def file_metadata(metadata: DataFrame, path: str) -> DataFrame:
    return metadata.where(F.col("file_path") == path)


def indexed_files(metadata: DataFrame) -> DataFrame:
    return metadata.select("file_path").distinct()


def index_metadata(entries: DataFrame, at: float) -> DataFrame:
    """(key, value): counters and version of an index."""
    row = entries.agg(F.count("*").cast("string").alias("entry_count"), F.count_distinct("file_path").cast("string").alias("file_count"), F.lit(str(SCHEMA_VERSION)).alias("schema_version"), F.lit(str(at)).alias("saved_at"))
    return row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, row.columns)), F.array(*row.columns))).alias("key", "value"))


def size(spark: SparkSession, root: str) -> int:
    """Bytes of all snapshots."""
    fs, path = _fs(spark, root)
    return fs.getContentSummary(path(root)).getLength() if fs.exists(path(root)) else 0
