"""What is told to a user: findings of all kinds, their locations, the report and its summary, counters and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import duplicates as dup
from tessera.operators.recommend import is_test_location
from tessera.sources.scratch import written

MIN_NODES, MIN_BLOCK_NODES, MIN_BLOCK_LINES, MIN_NEAR_NODES = 5, 10, 3, 25
SHOWN, LISTED, FILES, HASHES = 5, 20, 10, 5
CODE = 500


def relative(path: Column, root: str) -> Column:
    """A path without its root."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def location(path: Column) -> Column:
    return F.format_string("%s:%s:L%d-%d", path, "name", "line_start", "line_end")


def location_record(code: bool = False) -> Column:
    """An entry's place as JSON; its code cut after CODE characters."""
    fields = [F.col("file_path").alias("file"), "name", F.col("unit_type").alias("type"), F.concat_ws("-", "line_start", "line_end").alias("lines"), F.nullif("parent_name", F.lit("")).alias("parent")]
    if code:
        fields.append(F.concat(F.substring("code", 1, CODE), F.when(F.length("code") > CODE, "...").otherwise("")).alias("code"))
    return F.to_json(F.struct(*fields))


UNIT_FIELDS = ("name", "code", "file_path", "line_start", "line_end", "unit_type", "parent_name", "language", "block_type", "parent_block", "nesting_depth")
ENTRY_FIELDS = ("unit_id", "wl_hash", "pattern_hash", "canonical_hash", "fingerprint", "hierarchy", "node_count", "depth", "pattern_form")
ENTRY_SCHEMA = (
    "unit_id string, wl_hash string, pattern_hash string, canonical_hash string, fingerprint string, hierarchy array<string>, node_count int, depth int, pattern_form string, "
    "unit struct<name:string,code:string,file_path:string,line_start:int,line_end:int,unit_type:string,parent_name:string,language:string,block_type:string,parent_block:string,nesting_depth:int>"
)


def to_record(rows: DataFrame, *names: str) -> Column:
    """The named columns, or all, as JSON; nulls are left out."""
    return F.to_json(F.struct(*(names or rows.columns)))


def entries_to_json(entries: DataFrame) -> DataFrame:
    """(unit_id, data): entries as JSON; what is null is left out."""
    own = [c for c in ENTRY_FIELDS if c in entries.columns]
    return entries.select("unit_id", F.to_json(F.struct(*own, F.struct(*(c for c in UNIT_FIELDS if c in entries.columns)).alias("unit"))).alias("data"))


def entries_from_json(rows: DataFrame) -> DataFrame:
    """Entries of (data): a missing pattern hash is the hash itself, a missing language Python."""
    x = rows.select(F.from_json("data", ENTRY_SCHEMA).alias("x")).select("x.*")
    out = x.select(*(c for c in ENTRY_FIELDS), "unit.*")
    return out.withColumns({"pattern_hash": F.coalesce("pattern_hash", "wl_hash"), "language": F.coalesce("language", F.lit("python"))})


# ---- findings


def findings(entries: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """(kind, group_hash, size, verified, line_count, block_type, is_test, keep, locations, parents): exact duplicates of
    MIN_NODES, blocks of MIN_BLOCK_NODES and MIN_BLOCK_LINES, patterns, and near duplicates of MIN_NEAR_NODES.

    Of a group's places the first SHOWN by path and line are kept, and size says how many there are; line count and block
    type are the first's. keep is the place with the fewest slashes, if no other has as few. Exact and block groups are
    verified by canonical form, of others that isn't said."""
    found = None
    near = entries.withColumn("near_hash", F.substring(F.sha2(dup.prefix(dup.NEAR_LEVELS), 256), 1, 16))
    kinds = (
        ("exact", dup.code_units(entries), "wl_hash", dup.exact(entries, MIN_NODES, suppressed), MIN_NODES),
        ("block", entries.where(F.col("unit_type") == dup.BLOCK), "wl_hash", dup.blocks(entries, MIN_BLOCK_NODES, None, suppressed), MIN_BLOCK_NODES),
        ("pattern", dup.code_units(entries), "pattern_hash", dup.pattern(entries, MIN_NODES, suppressed), MIN_NODES),
        ("near", dup.near_members(near, MIN_NEAR_NODES, suppressed=suppressed), "near_hash", dup.near(entries, MIN_NEAR_NODES, suppressed=suppressed), MIN_NEAR_NODES),
    )
    for kind, rows, key, groups, least in kinds:
        own = described(rows.where(F.col("node_count") >= least), groups, key).withColumn("kind", F.lit(kind))
        if kind in ("exact", "block"):
            own = own.join(groups.select("group_hash", "verified"), "group_hash")
        else:
            own = own.withColumn("verified", F.lit(None).cast("boolean"))
        if kind == "block":
            own = own.where(F.col("line_count") >= MIN_BLOCK_LINES)
        else:
            own = own.withColumns({"block_type": F.lit(None).cast("string"), "parents": F.lit(None).cast("array<string>")})
        own = own.withColumn("keep", F.when(F.lit(kind == "exact"), F.col("keep")))
        found = own if found is None else found.unionByName(own)
    return found


def described(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(group_hash, size, is_test, line_count, block_type, keep, locations, parents) of groups, by their members."""
    own = rows.join(groups.select(F.col("group_hash").alias(key)), key, "left_semi").withColumn("group_hash", F.col(key))
    first = F.struct("file_path", "line_start", "line_end", "name")
    slashes = F.length("file_path") - F.length(F.replace("file_path", F.lit("/"), F.lit("")))
    g = own.groupBy("group_hash").agg(
        F.count("*").alias("size"), F.every(is_test_location(F.col("file_path"))).alias("is_test"), F.min_by(F.col("line_end") - F.col("line_start") + 1, first).alias("line_count"),
        F.min_by("block_type", first).alias("block_type"), F.min_by(location(F.col("file_path")), F.struct(slashes.alias("s"), first)).alias("shallow"),
    )
    depths = own.groupBy("group_hash", slashes.alias("s")).agg(F.count("*").alias("n")).groupBy("group_hash").agg(F.min_by("n", "s").alias("at_least"))
    places = dup.top_members(own, groups, key, SHOWN).groupBy("group_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "location"))), lambda x: x["location"]).alias("locations"))
    parents = own.where("parent_name is not null").select("group_hash", "parent_name").distinct().groupBy("group_hash").agg(F.array_sort(F.collect_list("parent_name")).alias("parents"))
    out = g.join(depths, "group_hash").join(places, "group_hash").join(parents, "group_hash", "left")
    return out.select("group_hash", "size", "is_test", "line_count", "block_type", F.when((F.col("at_least") == 1) & (F.col("size") > 1), F.col("shallow")).alias("keep"), "locations", "parents")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with place (long, from 1) by order: a range shuffle sorts them, each task counts its own, and only the tasks'
    counts are added up. Rows of equal order are numbered in any order; no row is numbered twice."""
    at, part = F.col("_at"), F.shiftright("_at", 33)  # the task above, the row within it below
    own = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = own.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row a task
    return placed.withColumn("place", F.col("_start") + at.bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_start")


def finding_lines(found: DataFrame) -> DataFrame:
    """(place, is_test, text): the report's paragraphs, sources first, then tests; numbered by kind, size and hash."""
    kind = F.element_at(F.create_map(*map(F.lit, ("exact", 0, "block", 1, "pattern", 2, "near", 3))), F.col("kind"))
    more = F.when(F.col("size") > SHOWN, F.concat(F.lit(" ... +"), F.col("size") - SHOWN, F.lit(" more"))).otherwise("")
    mark = F.when(F.col("kind") == "block", F.concat(F.lit(" ["), F.coalesce("block_type", F.lit("block")), F.lit("]"))).when(F.col("kind") == "pattern", " [pattern]").when(F.col("kind") == "near", " [near-duplicate]").otherwise("")
    sure = F.when(F.col("verified"), " (verified)").otherwise("")
    rows = numbered(found.withColumn("_kind", kind), "is_test", "_kind", F.desc("size"), "group_hash")
    head = F.concat("place", F.lit("."), mark, sure, F.lit(" "), F.array_join("locations", ", "), more, F.lit(" ("), "line_count", F.lit(" lines)"))
    keep = F.when(F.col("keep").isNotNull(), F.concat(F.lit("\n   Keep: "), "keep", F.lit(" (shallowest path)"))).otherwise("")
    act = F.concat(F.lit('\n   Action: refactor to eliminate duplication, or suppress(wl_hash="'), "group_hash", F.lit('") if intentional.'))
    return rows.select("place", "is_test", F.concat(head, keep, act).alias("text"))


def paragraphs(found: DataFrame, suppressed: int = 0) -> DataFrame:
    """(place, text): the whole report, a row a paragraph; a heading stands with the first of sources and of tests where
    there are both, and the last row says how many groups there are."""
    lines = written(finding_lines(found), "finding-lines")
    title = F.when(F.col("is_test"), "=== Tests ===\n\n").otherwise("=== Source code ===\n\n")
    firsts = lines.groupBy("is_test").agg(F.min("place").alias("place"))
    both = firsts.select("place", title.alias("title"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n")).where("n = 2").drop("n")
    body = lines.join(F.broadcast(both), "place", "left").select("place", F.concat(F.coalesce("title", F.lit("")), "text", F.lit("\n")).alias("text"))
    note = f" {suppressed} suppressed." if suppressed else ""
    none = F.lit("**No significant duplicates.**" + note)
    total = F.concat(F.lit(f"+ {suppressed} suppressed\n" if suppressed else ""), F.col("n").cast("string"), F.lit(" duplicate groups."))
    end = lines.agg(F.count("*").alias("n")).select((F.col("n") + 1).alias("place"), F.when(F.col("n") == 0, none).otherwise(total).alias("text"))
    return body.unionByName(end)


def write_report(found: DataFrame, path: str, suppressed: int = 0) -> str:
    """Writes the report as text files of one folder, by the tasks; their names are in the report's order."""
    paragraphs(found, suppressed).repartitionByRange("place").sortWithinPartitions("place").select("text").write.text(path)
    return path


def read_report(spark: SparkSession, path: str) -> str:
    """The whole report of a folder, for one who asked to read it."""
    parts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value").orderBy("name").collect()
    return "".join(r.value for r in parts).removesuffix("\n")


def report_text(found: DataFrame, suppressed: int = 0) -> str:
    """The whole report as one text."""
    return "\n".join(r.text for r in paragraphs(found, suppressed).orderBy("place").collect())


def summary_table(found: DataFrame) -> DataFrame:
    """(kind, is_test, findings, locations, lines): lines are the first places' times the number of places."""
    return found.groupBy("kind", "is_test").agg(F.count("*").alias("findings"), F.sum("size").alias("locations"), F.sum(F.col("line_count") * F.col("size")).alias("lines"))


def summary_text(found: DataFrame, suppressed: int = 0, path: str | None = None) -> str:
    rows = summary_table(found).collect()
    if not rows:
        return "**No significant duplicates.**" + (f" {suppressed} suppressed." if suppressed else "")
    count = lambda test: sum(r.findings for r in rows if test(r))
    kinds = [f"{n} {k}" for k in ("exact", "block", "pattern", "near") if (n := count(lambda r, k=k: r.kind == k))]
    out = [f"**Found {count(lambda r: True)} duplicate groups** — {' · '.join(kinds)}"]
    if n := count(lambda r: not r.is_test):
        out.append(f"- Source: {n} groups (~{sum(r.lines for r in rows if not r.is_test)} duplicated lines)")
    if n := count(lambda r: r.is_test):
        out.append(f"- Tests: {n} groups")
    if suppressed:
        out.append(f"- + {suppressed} suppressed")
    if path:
        out.append(f"\n**Details:** `{path}`")
    return "\n".join(out)


# ---- counters and states


def stats(entries: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """One row of counters of an index: entries, functions and other units, blocks, hashes, patterns, block hashes, files,
    suppressions."""
    block = F.col("unit_type") == dup.BLOCK
    out = entries.agg(
        F.count("*").alias("total_entries"), F.count_if(~block).alias("function_entries"), F.count_if(block).alias("block_entries"),
        F.count_distinct(F.when(~block, F.col("wl_hash"))).alias("unique_hashes"), F.count_distinct(F.when(~block, F.col("pattern_hash"))).alias("unique_patterns"),
        F.count_distinct(F.when(block, F.col("wl_hash"))).alias("unique_block_hashes"), F.count_distinct("file_path").alias("indexed_files"),
    )
    if suppressed is None:
        return out.withColumn("suppressed_hashes", F.lit(0).cast("long"))
    return out.crossJoin(F.broadcast(suppressed.agg(F.count_distinct("hash").alias("suppressed_hashes"))))  # one row by one row


def stats_text(row, duplicates: bool, blocks: bool = True, changes: str = "") -> str:
    """What an index holds, and whether it has duplicates; row: of stats()."""
    parts = [f"Indexed {row.function_entries} code units from {row.indexed_files} files{changes}."]
    if blocks:
        parts.append(f"Extracted {row.block_entries} code blocks.")
    return "\n".join([*parts, "\nDuplicates found. Run analyze()."]) if duplicates else " ".join([*parts, "\nNo duplicates."])


def status_text(row=None, running: bool = False, degraded: str | None = None, watching: bool = False) -> str:
    """Idle, Indexing, or Ready, and how the watcher does; row: of stats(), None without an index."""
    if running:
        return f"**Indexing** — {row.total_entries if row else 0} entries so far"
    if row is None or not row.total_entries:
        return "**Idle** — no codebase indexed."
    lines = [f"**Ready** — {row.function_entries} code units across {row.indexed_files} files."]
    if degraded:
        lines.append(f"**Degraded** watcher — {degraded}. Index may be stale; a resync will run automatically.")
    elif watching:
        lines.append("Watcher: active")
    return "\n".join(lines)


def listing(title: str, items: list[str], most: int) -> list[str]:
    if not items:
        return []
    return [f"\n{title} ({len(items)}):", *(f"  - {x}" for x in items[:most]), *([f"  ... and {len(items) - most} more"] if len(items) > most else [])]


def staleness_text(rows: DataFrame) -> str:
    """The staleness report's text; of files the first FILES of a kind are named."""
    kinds: dict[str, list[str]] = {}
    for r in rows.orderBy("kind", "item").toLocalIterator():
        kinds.setdefault(r.kind, []).append(r.item)
    if not kinds:
        return "Index up to date."
    out = ["Index is STALE. Changes detected:"]
    for title, kind in (("Modified", "modified"), ("Deleted", "deleted"), ("New files", "new")):
        out += listing(title, kinds.get(kind, []), FILES)
    return "\n".join(out + listing("Stale suppressions", kinds.get("stale suppression", []), 10**9))


def suppressions_text(known: DataFrame) -> str:
    """The first LISTED suppressed hashes, and how many there are."""
    n, rows = known.count(), known.orderBy("hash").limit(LISTED).collect()
    if not n:
        return "**No suppressions** — all duplicates are active."
    return f"**{n} suppressed hashes:**\n```\n" + "\n".join(r.hash for r in rows) + "\n```" + (f"\n_+{n - LISTED} more_" if n > LISTED else "")


def invalidated_text(ended: DataFrame) -> str:
    """A notice of suppressions that ended, the first HASHES of them; empty without any."""
    n, rows = ended.count(), ended.orderBy("hash").limit(HASHES).collect()
    if not n:
        return ""
    return f"Suppressions invalidated: {', '.join(r.hash for r in rows)}" + (f" ... ({n} total)" if n > HASHES else "") + ". Run analyze().\n"
