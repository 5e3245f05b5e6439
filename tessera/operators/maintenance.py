"""Suppressions and incremental maintenance of the index.

A suppression is a row (hash, reason, created_at, source_name, code_preview, entry_count, source_files, file_hashes): what
was suppressed, and the content of the files that it stood in. It ends when its hash has left the index, or when those
files changed and nothing in them has the structure any longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import extract, trees
from tessera.operators.duplicates import bucket

PREVIEW = 200
SUPPRESSION = "hash string, reason string, created_at double, source_name string, code_preview string, entry_count long, source_files array<string>, file_hashes map<string,string>"
METADATA = "file_path string, mtime double, content_hash string, indexed_at double, entry_count long"


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


# ---- suppressions


def suppress(entries: DataFrame, hashes: DataFrame, key: str = "wl_hash") -> DataFrame:
    """(hash, entry_count, n_files, first_name) of those hashes that entries have; others aren't suppressed."""
    rows = entries.join(hashes.select(F.col("hash").alias(key)), key, "left_semi")
    return rows.groupBy(F.col(key).alias("hash")).agg(F.count("*").alias("entry_count"), F.count_distinct("file_path").alias("n_files"), F.min("name").alias("first_name"))


def suppressions(entries: DataFrame, hashes: DataFrame, metadata: DataFrame, at: float, reason: str | None = None) -> DataFrame:
    """Rows of SUPPRESSION for those hashes (hash) that a bucket of the index has. Name and preview are those of the first
    entry by path and line; files without metadata have an empty content hash."""
    first = F.struct("file_path", "line_start", "line_end", "name")
    rows = bucket(entries, hashes).join(entries.select("unit_id", "file_path", "line_start", "line_end", "name", "code"), "unit_id")
    own = rows.groupBy("hash").agg(F.count("*").alias("entry_count"), F.min_by("name", first).alias("source_name"), F.min_by(F.substring("code", 1, PREVIEW), first).alias("code_preview"))
    files = rows.select("hash", "file_path").distinct().join(metadata.select("file_path", "content_hash"), "file_path", "left")
    files = files.groupBy("hash").agg(F.sort_array(F.collect_list("file_path")).alias("source_files"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("file_path", F.coalesce("content_hash", F.lit("")))))).alias("file_hashes"))
    out = own.join(files, "hash").withColumns({"reason": F.lit(reason).cast("string"), "created_at": F.lit(float(at))})
    return out.select(*(x.split()[0] for x in SUPPRESSION.split(", ")))


def add(known: DataFrame, new: DataFrame) -> DataFrame:
    """Suppressions with new ones, which replace those of their hashes."""
    return known.join(new.select("hash"), "hash", "left_anti").unionByName(new)


def unsuppress(suppressed: DataFrame, hashes: DataFrame) -> DataFrame:
    return suppressed.join(hashes.select("hash"), "hash", "left_anti")


def split_known(hashes: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashes that are known, and those that aren't found."""
    return hashes.join(known.select("hash"), "hash", "left_semi"), hashes.join(known.select("hash"), "hash", "left_anti")


def suppressed_hashes(known: DataFrame) -> DataFrame:
    return known.select("hash").distinct()


def suppression(known: DataFrame, hash_: str) -> DataFrame:
    return known.where(F.col("hash") == hash_)


def cleared(known: DataFrame) -> DataFrame:
    return known.where(F.lit(False))


def primary_file(known: DataFrame) -> DataFrame:
    return known.select("hash", F.try_element_at("source_files", F.lit(1)).alias("primary_file"))


def index_hashes(entries: DataFrame) -> DataFrame:
    """(hash): all that any bucket holds."""
    return entries.select(F.col("wl_hash").alias("hash")).union(entries.select("pattern_hash")).distinct()


def stale(suppressed: DataFrame, entries: DataFrame) -> DataFrame:
    """(hash, stale): whether neither a hash nor a pattern of the entries is the suppressed one any longer."""
    now = index_hashes(entries).withColumn("there", F.lit(True))
    return suppressed.select("hash").join(now, "hash", "left").select("hash", F.col("there").isNull().alias("stale"))


def staleness(known: DataFrame, entries: DataFrame) -> DataFrame:
    """(hash, reason) of suppressions whose code, or whose first file, the index no longer has."""
    rows = known.select("hash", F.try_element_at("source_files", F.lit(1)).alias("file_path")).join(index_hashes(entries).withColumn("there", F.lit(True)), "hash", "left")
    rows = rows.join(entries.select("file_path", F.lit(True).alias("indexed")).distinct(), "file_path", "left")
    reason = F.when(F.col("there").isNull(), "code no longer exists in index").when(F.col("file_path").isNotNull() & F.col("indexed").isNull(), F.concat(F.lit("source file "), "file_path", F.lit(" removed from index")))
    return rows.select("hash", reason.alias("reason")).where("reason is not null")


def file_changes(known: DataFrame, files: DataFrame) -> DataFrame:
    """(hash, file_path, change, now) of suppressions' files against files (file_path, text): deleted, changed or same."""
    rows = known.select("hash", F.explode("file_hashes").alias("file_path", "before")).join(files.select("file_path", content_hash(F.col("text")).alias("now")), "file_path", "left")
    change = F.when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("before"), "changed").otherwise("same")
    return rows.select("hash", "file_path", change.alias("change"), "now")


def invalidate(known: DataFrame, entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suppressions that go on, their files' hashes brought up to date, and (hash, reason) of those that end. Only files
    that a suppression with a change in them names are read again; a suppressed pattern lives on by its pattern."""
    changes = file_changes(known, files)
    touched = changes.groupBy("hash").agg(F.bool_or(F.col("change") != "same").alias("touched"))
    again = changes.join(touched.where("touched"), "hash", "left_semi").where("change <> 'deleted'")
    reread = files.join(again.select("file_path").distinct(), "file_path", "left_semi")
    now = trees.entries(extract.units(reread)).select("file_path", F.explode(F.array("wl_hash", "pattern_hash")).alias("hash")).distinct()
    lives = again.join(now, ["hash", "file_path"], "left_semi").select("hash", F.lit(True).alias("lives")).distinct()
    gone = stale(known, entries)
    verdict = known.select("hash").join(gone, "hash").join(touched, "hash", "left").join(lives, "hash", "left")
    reason = F.when(F.col("stale"), "hash no longer exists in index").when(F.coalesce("touched", F.lit(False)) & F.col("lives").isNull(), "suppressed code structure no longer exists")
    ended = verdict.select("hash", reason.alias("reason")).where("reason is not null")
    held = changes.where("change <> 'deleted'").groupBy("hash").agg(F.sort_array(F.collect_list("file_path")).alias("left_files"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("file_path", "now")))).alias("new_hashes"))
    go_on = known.join(ended.select("hash"), "hash", "left_anti").join(held, "hash", "left")
    go_on = go_on.withColumns({"source_files": F.coalesce("left_files", F.filter("source_files", lambda x: F.lit(False))), "file_hashes": F.coalesce("new_hashes", F.map_filter("file_hashes", lambda k, v: F.lit(False)))})
    return go_on.select(*known.columns), ended


# ---- incremental maintenance


def metadata_of(files: DataFrame, entries: DataFrame, at: float) -> DataFrame:
    """Rows of METADATA for files (file_path, text, mtime): also of those without entries."""
    counts = entries.groupBy("file_path").agg(F.count("*").alias("entry_count"))
    rows = files.select("file_path", F.col("mtime").cast("double").alias("mtime"), content_hash(F.col("text")).alias("content_hash"))
    return rows.join(counts, "file_path", "left").select("file_path", "mtime", "content_hash", F.lit(float(at)).alias("indexed_at"), F.coalesce("entry_count", F.lit(0)).cast("long").alias("entry_count"))


def status(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(file_path, status) of files (file_path, text) against what was indexed (file_path, content_hash): added, updated,
    unchanged or removed."""
    now = files.select("file_path", content_hash(F.col("text")).alias("now"))
    kind = F.when(F.col("now").isNull(), "removed").when(F.col("content_hash").isNull(), "added").when(F.col("now") == F.col("content_hash"), "unchanged").otherwise("updated")
    return now.join(indexed.select("file_path", "content_hash"), "file_path", "full_outer").select("file_path", kind.alias("status"))


def to_open(listing: DataFrame, metadata: DataFrame) -> DataFrame:
    """(file_path) of a listing (file_path, mtime) whose time is not that of the metadata: nothing else need be opened.
    A null time is never known."""
    return listing.join(metadata.select("file_path", "mtime"), ["file_path", "mtime"], "left_anti").select("file_path")


def gated_status(listing: DataFrame, opened: DataFrame, metadata: DataFrame) -> DataFrame:
    """(file_path, status, opened): status() by a listing and the texts of to_open()'s files alone. A file that was listed
    but couldn't be opened any more counts as removed."""
    now = opened.select("file_path", content_hash(F.col("text")).alias("now"), F.lit(True).alias("opened"))
    asked = to_open(listing, metadata).withColumn("asked", F.lit(True))
    rows = listing.select("file_path", F.lit(True).alias("listed")).join(asked, "file_path", "left").join(now, "file_path", "left").join(metadata.select("file_path", "content_hash"), "file_path", "full_outer")
    there = F.col("listed").isNotNull() & (F.col("asked").isNull() | F.col("opened").isNotNull())
    kind = F.when(~there, "removed").when(F.col("asked").isNull() | (F.col("now") == F.col("content_hash")), "unchanged").when(F.col("content_hash").isNull(), "added").otherwise("updated")
    return rows.select("file_path", kind.alias("status"), F.col("opened").isNotNull().alias("opened"))


def upsert(entries: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """entries without those of changed or removed files, and changed's entries."""
    gone = changed.select("file_path").union(removed.select("file_path")).distinct()
    return entries.join(gone, "file_path", "left_anti").unionByName(changed, allowMissingColumns=True)


def incremental(files: DataFrame, entries: DataFrame, metadata: DataFrame, at: float, max_depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of the index: its entries and metadata for files (file_path, language, text, mtime) of now, and (file_path,
    status) of all. Only added and updated files are read into units; a file without entries leaves its metadata too."""
    what = status(files, metadata)
    changed = files.join(what.where("status in ('added', 'updated')"), "file_path", "left_semi")
    new = with_ids(trees.entries(extract.units(changed, max_depth)))
    gone = what.where("status <> 'unchanged'")
    after = entries.join(gone, "file_path", "left_anti").unionByName(new, allowMissingColumns=True)
    meta = metadata.join(gone, "file_path", "left_anti").unionByName(metadata_of(changed, new, at))
    return after, meta, what


def with_ids(entries: DataFrame) -> DataFrame:
    """entries with unit_id: the first 32 hex digits of a hash of what and where a unit is, the same on every run; units
    that are alike in all of that, as repeated rows are, are counted up."""
    parts = ("file_path", "unit_type", "name", "line_start", "line_end", "code")
    where = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in parts))
    rows = entries.withColumn("unit_id", F.sha2(where, 256))
    again = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.lit(0)))  # units of one id are alike: any order
    rows = rows.withColumn("_again", again)
    later = F.sha2(F.concat_ws("\u0001", "unit_id", F.col("_again").cast("string")), 256)
    return rows.withColumn("unit_id", F.substring(F.when(F.col("_again") > 1, later).otherwise(F.col("unit_id")), 1, 32)).drop("_again")


def staleness_report(what: DataFrame, entries: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, item): modified, deleted and new files of a status (file_path, status), and suppressions that are stale; no
    row: all is up to date."""
    names = F.create_map(*map(F.lit, ("updated", "modified", "removed", "deleted", "added", "new")))
    changed = what.where("status <> 'unchanged'").select(F.element_at(names, F.col("status")).alias("kind"), F.col("file_path").alias("item"))
    return changed.unionByName(staleness(known, entries).select(F.lit("stale suppression").alias("kind"), F.concat_ws(": ", "hash", "reason").alias("item")))


def content_copies(files: DataFrame) -> DataFrame:
    """(content_hash, copies, first_file) of texts that several files hold."""
    return files.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("file_id").alias("first_file")).where("copies > 1")
