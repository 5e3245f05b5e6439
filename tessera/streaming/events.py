"""File events: debounce, storms and the streaming index."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import scan
from tessera.sources.paths import FOLDER
from tessera.sources.scratch import written


def file_events(events: DataFrame) -> DataFrame:
    """(event_id, ts, path, event_type) of the event table: users stand for paths."""
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("path"), "event_type")


def bursts(events: DataFrame, quiet: int, slice_seconds: int = 86_400) -> DataFrame:
    """(path, burst, first, last, n): runs of a path's events with at most ``quiet`` seconds between them; each is
    flushed once, at its end. Events without a path or a time are left out.

    The line of time is cut into slices: runs are found in each slice of a path for itself, and then those that meet at a
    boundary are joined, a row a run. So a path with very many events is many tasks' work.
    """
    gap = quiet * 1_000_000
    t = F.unix_micros("ts")
    rows = events.where(F.col("path").isNotNull() & F.col("ts").isNotNull()).select("path", "ts", t.alias("t"), F.floor(t / (slice_seconds * 1_000_000)).alias("slice"))
    order = Window.partitionBy("path", "slice").orderBy("t")
    rows = rows.withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(order) > gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("path", "slice", "run").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    by_path = Window.partitionBy("path").orderBy("first")
    apart = F.unix_micros("first") - F.unix_micros(F.lag("last").over(by_path))
    runs = runs.withColumn("new", F.coalesce(apart > gap, F.lit(True)).cast("int")).withColumn("burst", F.sum("new").over(by_path.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("path", "burst").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def storm_peaks(events: DataFrame, window: int, limit: int) -> DataFrame:
    """(over, most): events at which more than ``limit`` lie within the last ``window`` seconds, and the most that do; 0 and
    null without events. Events without a time don't count.

    Each time enters a line twice: as itself, and a window earlier as a probe. Along the line, the probes so far less the
    events so far are, at a probe, the events of its window. So one sorted pass is enough, and the line is cut anywhere: a
    part's sum is what the parts after it start from. Equal times are one row, and a part may lie within one window.
    """
    times = events.select(F.unix_micros("ts").alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("w"))
    steps = F.explode(F.array(F.struct(F.col("t").alias("at"), (-F.col("w")).alias("step")), F.struct((F.col("t") - window * 1_000_000).alias("at"), F.col("w").alias("step"))))
    line = times.select(steps.alias("x")).select("x.*").repartitionByRange("at").withColumn("part", F.spark_partition_id())
    line = written(line, "storm-line")  # the cuts stay where they are
    sums = sorted(tuple(r) for r in line.groupBy("part").agg(F.sum("step")).collect())  # a row for each partition
    before = [(p, sum(s for _, s in sums[:i])) for i, (p, _) in enumerate(sums)]
    base = events.sparkSession.createDataFrame(before, "part int, base long")
    # a probe stands before events of its place: those belong to its window
    along = Window.partitionBy("part").orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    counted = line.withColumn("n", F.sum("step").over(along)).where("step > 0").join(F.broadcast(base), "part").select("step", (F.col("n") + F.col("base")).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.when(F.col("n") > limit, F.col("step"))), F.lit(0)).alias("over"), F.max("n").alias("most"))


def sessions(events: DataFrame, quiet: int, late: str = "10 minutes") -> DataFrame:
    """bursts() for streams: session windows, emitted once the watermark has passed them."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy("path", F.session_window("ts", f"{quiet} seconds").alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("first"), F.col("w.end").alias("end"), "n")


def moves(events: DataFrame) -> DataFrame:
    """Move events (path, dest_path) as a deletion of the one and a creation of the other; others as they are."""
    parts = F.when(F.col("event_type") == "moved", F.array(F.struct(F.col("path"), F.lit("deleted").alias("event_type")), F.struct(F.col("dest_path").alias("path"), F.lit("created").alias("event_type")))).otherwise(F.array(F.struct("path", "event_type")))
    return events.withColumn("x", F.explode(parts)).select("ts", "x.path", "x.event_type")


def keep_current(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Feeds micro-batches to apply (an upsert of the index) until what is there is read; batch ids make retries safe."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- which events count


def supported(path: Column, rules: Iterable[str] = ()) -> Column:
    """Whether a path is a source that is watched: its suffix, its folders, the ignore rules, and not the engine's own."""
    own = F.array_contains(F.split(path, "/"), FOLDER) | F.element_at(F.split(path, "/"), -1).startswith("._tessera")
    parsed = scan.parse_rules(rules)
    out = scan.language(path).isNotNull() & ~scan.skipped(path) & ~own
    return out & ~scan.ignored(path, parsed) if parsed else out


def watched(events: DataFrame, rules: Iterable[str] = ()) -> DataFrame:
    """Events of sources, moves taken apart; is_directory, where there is such a column, must be false."""
    rows = moves(events) if "dest_path" in events.columns else events
    if "is_directory" in rows.columns:
        rows = rows.where(~F.coalesce("is_directory", F.lit(False)))
    return rows.where(F.coalesce(supported(F.col("path"), rules), F.lit(False)) & F.col("event_type").isin("modified", "created", "deleted"))


def routed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path) of files to read again, and of files to remove: a file's last event decides, and among events of one time a
    deletion comes first, so that what may still be there is looked for."""
    last = events.groupBy("path").agg(F.max_by("event_type", F.struct("ts", F.col("event_type") != "deleted")).alias("event_type"))
    return last.where("event_type <> 'deleted'").select("path"), last.where("event_type = 'deleted'").select("path")


def listing_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, event_type): what a listing (path, mtime, size) has against an earlier one."""
    b = before.select("path", F.struct("mtime", "size").alias("b"))
    n = now.select("path", F.struct("mtime", "size").alias("n"))
    kind = F.when(F.col("b").isNull(), "created").when(F.col("n").isNull(), "deleted").when(F.col("b") != F.col("n"), "modified")
    return b.join(n, "path", "full_outer").select("path", kind.alias("event_type")).where("event_type is not null")
