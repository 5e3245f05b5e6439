"""Duplicate groups and similarity probes over the index's entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAR_LEVELS, PARTIAL_LEVELS = 4, 2
BLOCK = "block"


def unsuppressed(entries: DataFrame, key: str, suppressed: DataFrame | None) -> DataFrame:
    return entries if suppressed is None else entries.join(suppressed.select(F.col("hash").alias(key)), key, "left_anti")


def groups(entries: DataFrame, key: str, min_nodes: int = 5, suppressed: DataFrame | None = None) -> DataFrame:
    """(group_hash, size, n_wl, any_wl, verified): values of key that at least two entries of min_nodes share. Members
    are joined back where they are needed: a group of any size is one row here. Groups by pattern are verified by the
    canonical form of patterns, others by that of trees."""
    rows = unsuppressed(entries.where(F.col("node_count") >= min_nodes), key, suppressed)
    agg = rows.groupBy(F.col(key).alias("group_hash")).agg(F.count("*").alias("size"), F.count_distinct("wl_hash").alias("n_wl"), F.min("wl_hash").alias("any_wl"), one_form(key).alias("verified"))
    return agg.where("size >= 2")


def one_form(key: str) -> Column:
    """Whether all rows of a group by key have one canonical form."""
    form = "pattern_form" if key == "pattern_hash" else "canonical_hash"
    return F.min(form) == F.max(form)


def code_units(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("unit_type") != BLOCK)


def exact(entries: DataFrame, min_nodes: int = 5, suppressed: DataFrame | None = None) -> DataFrame:
    return groups(code_units(entries), "wl_hash", min_nodes, suppressed)


def blocks(entries: DataFrame, min_nodes: int = 5, types: list[str] | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    rows = entries.where(F.col("unit_type") == BLOCK)
    return groups(rows if types is None else rows.where(F.col("block_type").isin(types)), "wl_hash", min_nodes, suppressed)


def pattern(entries: DataFrame, min_nodes: int = 5, suppressed: DataFrame | None = None) -> DataFrame:
    """Groups by pattern, but those whose members all share one hash that is an exact duplicate."""
    own = code_units(entries)
    twice = own.groupBy("wl_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("wl_hash").alias("any_wl"), F.lit(True).alias("is_exact"))
    found = groups(own, "pattern_hash", min_nodes, suppressed).join(twice, "any_wl", "left")
    return found.where(~((F.col("n_wl") == 1) & F.coalesce("is_exact", F.lit(False)))).drop("is_exact")


def prefix(levels: int) -> Column:
    return F.array_join(F.slice("hierarchy", 1, levels), "|")


def near_members(entries: DataFrame, min_nodes: int = 5, suppressed: DataFrame | None = None) -> DataFrame:
    """Code units of min_nodes that no exact or pattern group covers, of whatever size that group's members are; groups
    that are suppressed cover nothing."""
    own = code_units(entries)
    rows = own.where(F.col("node_count") >= min_nodes)
    for key in ("wl_hash", "pattern_hash"):
        covered = unsuppressed(own.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), key, suppressed)
        rows = rows.join(covered.select(key), key, "left_anti")
    return rows


def near(entries: DataFrame, min_nodes: int = 5, levels: int = NEAR_LEVELS, suppressed: DataFrame | None = None) -> DataFrame:
    """Groups by the first levels of the hierarchy, of entries that no exact or pattern group covers, with two hashes."""
    rows = near_members(entries, min_nodes, suppressed)
    found = rows.groupBy(prefix(levels).alias("prefix")).agg(F.count("*").alias("size"), F.count_distinct("wl_hash").alias("n_wl")).where("size >= 2 and n_wl >= 2")
    found = found.select(F.substring(F.sha2("prefix", 256), 1, 16).alias("group_hash"), "prefix", "size", "n_wl")
    return found if suppressed is None else found.join(suppressed.select(F.col("hash").alias("group_hash")), "group_hash", "left_anti")


def has_duplicates(entries: DataFrame, min_nodes: int = 5) -> DataFrame:
    """(has_duplicates): one row."""
    found = exact(entries, min_nodes).select("size").unionByName(blocks(entries, min_nodes).select("size")).limit(1)
    return found.agg((F.count("*") > 0).alias("has_duplicates"))


def members(entries: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return entries.join(found.select(F.col("group_hash").alias(key)), key, "left_semi")


MATCH = ("exact", "high", "partial")


def rank(match: Column) -> Column:
    """1 for an exact, 2 for a high, 3 for a partial match."""
    return F.when(match == "exact", 1).when(match == "high", 2).when(match == "partial", 3).otherwise(99)


def structures(rows: DataFrame, *more: Column) -> DataFrame:
    """(wl_hash, fingerprint, levels, blocks, others, ...): the different structures of entries, and how many blocks and how
    many other units have each. There are far fewer of them than entries."""
    n_blocks = F.count_if(F.col("unit_type") == BLOCK) if "unit_type" in rows.columns else F.lit(0)
    return rows.groupBy("wl_hash", "fingerprint", F.array_join("hierarchy", "|").alias("levels")).agg(n_blocks.cast("long").alias("blocks"), F.count("*").alias("n"), *more).withColumn("others", F.col("n") - F.col("blocks")).drop("n")


def level(n: int) -> Column:
    return F.substring_index("levels", "|", n)


def matched_structures(probes: DataFrame, entries: DataFrame, min_nodes: int = 5) -> DataFrame:
    """(p_levels, p_wl_hash, p_fingerprint, wl_hash, fingerprint, levels, blocks, others, tier, depth): every structure of
    the entries that matches a structure of the probes, by its best tier for units that aren't blocks.

    Structures are matched, not entries: three equi-joins of two small tables, whatever number of entries share one. A
    tier 1 match holds for units other than blocks alone; blocks of it, which have its fingerprint too, are of tier 2.
    Partial matches share the first two levels; depth counts on from there.
    """
    p = probes.where(F.col("node_count") >= min_nodes).select(F.col("wl_hash").alias("p_wl_hash"), F.col("fingerprint").alias("p_fingerprint"), F.array_join("hierarchy", "|").alias("p_levels")).distinct()
    p = p.withColumn("start", F.substring_index("p_levels", "|", PARTIAL_LEVELS))
    e = structures(entries).withColumn("start", level(PARTIAL_LEVELS))
    none = F.lit(None).cast("int")
    one = p.join(e.drop("start"), F.col("p_wl_hash") == F.col("wl_hash")).withColumns({"tier": F.lit(1), "depth": none}).drop("start")
    two = p.join(e.drop("start"), F.col("p_fingerprint") == F.col("fingerprint")).withColumns({"tier": F.lit(2), "depth": none}).drop("start")
    same = F.zip_with(F.split("p_levels", "[|]"), F.split("levels", "[|]"), lambda a, b: a == b)
    depth = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
    three = p.join(e, "start").withColumns({"tier": F.lit(3), "depth": depth}).drop("start")
    return one.unionByName(two).unionByName(three)


def similar(probes: DataFrame, entries: DataFrame, min_nodes: int = 5) -> DataFrame:
    """(probe_id, unit_id, match, depth) of each entry's best match with each probe of min_nodes: exact (hash, code units
    only), high (fingerprint) or partial (at least two levels of the hierarchy in common). Structures are matched first;
    what matches is then named on both sides."""
    return expanded(probes, entries, matched_structures(probes, entries, min_nodes), min_nodes)


def expanded(probes: DataFrame, entries: DataFrame, matched: DataFrame, min_nodes: int) -> DataFrame:
    best = best_tiers(matched)
    rows = probe_structures(probes, min_nodes).join(best, PROBE_KEY).join(entry_structures(entries), ENTRY_KEY)
    return rows.select("probe_id", "unit_id", F.element_at(F.array(*map(F.lit, MATCH)), F.col("tier")).alias("match"), "depth")


PROBE_KEY, ENTRY_KEY = ["p_wl_hash", "p_fingerprint", "p_levels"], ["wl_hash", "fingerprint", "levels", "is_block"]


def probe_structures(probes: DataFrame, min_nodes: int) -> DataFrame:
    """(probe_id and PROBE_KEY) of probes of min_nodes."""
    return probes.where(F.col("node_count") >= min_nodes).select("probe_id", F.col("wl_hash").alias("p_wl_hash"), F.col("fingerprint").alias("p_fingerprint"), F.array_join("hierarchy", "|").alias("p_levels"))


def entry_structures(entries: DataFrame, *more: Column) -> DataFrame:
    """(unit_id, ENTRY_KEY, ...) of entries."""
    is_block = F.col("unit_type") == BLOCK if "unit_type" in entries.columns else F.lit(False)
    return entries.select("unit_id", "wl_hash", "fingerprint", F.array_join("hierarchy", "|").alias("levels"), is_block.alias("is_block"), *more)


def top_similar(probes: DataFrame, entries: DataFrame, k: int, min_nodes: int = 5, order: tuple[str, ...] = ()) -> DataFrame:
    """(probe_id, place, unit_id, match, depth): the first k of similar() for every probe, the strongest first; of equal
    strength those that come first by the columns of order, then by unit_id.

    Counts of structures decide what is named: a strength (tier and depth) of which k stronger entries exist names none. Of
    a strength that still has places, only the structures with the smallest first members can fill them, as many as there
    are places, each with as many members: k * k rows at most for a structure of the probes, whatever number of entries
    match, and k for a probe. A probe that nothing matches has no row; repeated rows count each for itself.
    """
    at = F.struct(*order, "unit_id").alias("at")
    nth = F.row_number().over(Window.partitionBy(*ENTRY_KEY).orderBy("at"))
    heads = entry_structures(entries, at).withColumn("nth", nth).where(F.col("nth") <= k)
    best = best_tiers(matched_structures(probes, entries, min_nodes)).withColumn("minus", -F.coalesce("depth", F.lit(0)))
    strength = [*PROBE_KEY, "tier", "minus"]
    before = F.sum("n").over(Window.partitionBy(*PROBE_KEY).orderBy("tier", "minus").rowsBetween(Window.unboundedPreceding, -1))
    places = best.groupBy(*strength).agg(F.sum("n").alias("n")).withColumn("places", k - F.coalesce(before, F.lit(0))).where("places > 0").drop("n")
    firsts = heads.where("nth = 1").select(*ENTRY_KEY, F.col("at").alias("first"))
    nearest = F.row_number().over(Window.partitionBy(*strength).orderBy("first"))
    asked = best.join(firsts, ENTRY_KEY).withColumn("s", nearest).where(F.col("s") <= k).join(places, strength).where("s <= places")
    place = F.row_number().over(Window.partitionBy(*PROBE_KEY).orderBy("tier", "minus", "at"))
    named = asked.join(heads, ENTRY_KEY).where("nth <= places").withColumn("place", place).where(F.col("place") <= k)
    return probe_structures(probes, min_nodes).join(named, PROBE_KEY).select("probe_id", "place", "unit_id", F.element_at(F.array(*map(F.lit, MATCH)), F.col("tier")).alias("match"), "depth")


def best_tiers(matched: DataFrame) -> DataFrame:
    """(p_..., wl_hash, fingerprint, levels, is_block, n, tier, depth): the best tier of every two structures, for blocks
    and for other units."""
    kinds = F.array(F.struct(F.lit(False).alias("is_block"), F.col("others").alias("n")), F.struct(F.lit(True).alias("is_block"), F.col("blocks").alias("n")))
    rows = matched.withColumn("k", F.explode(kinds)).select("*", "k.is_block", "k.n").where((F.col("n") > 0) & ~(F.col("is_block") & (F.col("tier") == 1)))
    keys = ["p_wl_hash", "p_fingerprint", "p_levels", "wl_hash", "fingerprint", "levels", "is_block"]
    return rows.groupBy(*keys).agg(F.first("n").alias("n"), F.min(F.struct("tier", (-F.coalesce("depth", F.lit(0))).alias("minus"), "depth")).alias("b")).select(*keys, "n", "b.tier", "b.depth")


def similar_counts(probes: DataFrame, entries: DataFrame, min_nodes: int = 5) -> DataFrame:
    """(probe_id, match, depth, entries): how many entries match each probe, without naming them."""
    best = best_tiers(matched_structures(probes, entries, min_nodes)).groupBy("p_wl_hash", "p_fingerprint", "p_levels", "tier", "depth").agg(F.sum("n").alias("entries"))
    return probe_structures(probes, min_nodes).join(best, PROBE_KEY).select("probe_id", F.element_at(F.array(*map(F.lit, MATCH)), F.col("tier")).alias("match"), "depth", "entries")


def best_matches(probes: DataFrame, entries: DataFrame, min_nodes: int = 5) -> DataFrame:
    """(probe_id, match): the best tier that any entry matches each probe in."""
    return similar_counts(probes, entries, min_nodes).groupBy("probe_id").agg(F.min_by("match", rank(F.col("match"))).alias("match"))


def ordered(found: DataFrame) -> DataFrame:
    """Results of similar(), the strongest first: by tier, then by depth."""
    return found.orderBy(rank(F.col("match")), F.desc(F.coalesce("depth", F.lit(0))), "unit_id")


def exact_matches(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """(probe_id, unit_id) of code units with a probe's hash, whatever its size; a probe without a tree has none."""
    p = probes.where(F.col("node_count") > 0).select("probe_id", "wl_hash")
    return p.join(code_units(entries).select("unit_id", "wl_hash"), "wl_hash").select("probe_id", "unit_id")


def stronger(found: DataFrame, *keys: str) -> DataFrame:
    """The strongest of several results (match, depth) for each combination of keys."""
    best = found.groupBy(*keys).agg(F.min(F.struct(rank(F.col("match")).alias("r"), (-F.coalesce("depth", F.lit(0))).alias("d"), "match", "depth")).alias("b"))
    return best.select(*keys, "b.match", "b.depth")


def content_matches(snippets: DataFrame, entries: DataFrame, min_nodes: int = 3) -> DataFrame:
    """(content_id, unit_id, match, depth) of the snippets (content_id, probe_id and the columns of entries) of contents:
    the strongest match of each entry with any snippet of a content. Exact matches count whatever the snippet's size."""
    found = similar(snippets, entries, min_nodes).unionByName(exact_matches(snippets, entries).select("probe_id", "unit_id", F.lit("exact").alias("match"), F.lit(None).cast("int").alias("depth")))
    return stronger(found.join(snippets.select("probe_id", "content_id"), "probe_id"), "content_id", "unit_id")


def by_language(found: DataFrame, entries: DataFrame, language: Column) -> tuple[DataFrame, DataFrame]:
    """Results with their entries, those in the language and those in others."""
    rows = found.join(entries.drop("depth"), "unit_id")  # depth says how far they match
    return rows.where(F.col("language") == language), rows.where(F.col("language") != language)


def bucket(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, bucket, unit_id) of the entries of hashes (hash): of the first of the exact, the pattern and the block
    bucket that has the hash."""
    own = code_units(entries)
    views = (own.select(F.col("wl_hash").alias("hash"), "unit_id"), own.select(F.col("pattern_hash").alias("hash"), "unit_id"), entries.where(F.col("unit_type") == BLOCK).select(F.col("wl_hash").alias("hash"), "unit_id"))
    rows = None
    for i, (name, v) in enumerate(zip(("exact", "pattern", "block"), views)):
        v = v.join(hashes.select("hash").distinct(), "hash", "left_semi").withColumns({"at": F.lit(i), "bucket": F.lit(name)})
        rows = v if rows is None else rows.unionByName(v)
    return rows.withColumn("first", F.min("at").over(Window.partitionBy("hash"))).where("at = first").select("hash", "bucket", "unit_id")


def verified(entries: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(group_hash, verified): whether all members of a group have one canonical form."""
    rows = members(entries, found, key)
    return rows.groupBy(F.col(key).alias("group_hash")).agg(one_form(key).alias("verified"))


def gate(best: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, match, decision) of the best matches (probe_id, match; several rows of a probe count by the strongest):
    STOP for an exact, CAUTION for a high, NOTE for a partial match, else CREATE."""
    own = best.groupBy("probe_id").agg(F.min_by("match", rank(F.col("match"))).alias("match"))
    decision = F.when(F.col("match") == "exact", "STOP").when(F.col("match") == "high", "CAUTION").when(F.col("match") == "partial", "NOTE").otherwise("CREATE")
    return probes.select("probe_id").join(own, "probe_id", "left").withColumn("decision", decision)


def compare(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, a and b structs of entries) → (pair_id, verdict): equivalent, similar or different."""
    a, b = F.col("a"), F.col("b")
    verdict = F.when(a["canonical_hash"] == b["canonical_hash"], "equivalent").when((a["wl_hash"] == b["wl_hash"]) | (a["fingerprint"] == b["fingerprint"]), "similar").otherwise("different")
    return pairs.select("pair_id", verdict.alias("verdict"))


def top_members(entries: DataFrame, found: DataFrame, key: str, shown: int = 5) -> DataFrame:
    """(group_hash, place, location): the first members of every group by path and line."""
    order = Window.partitionBy(key).orderBy("file_path", "line_start", "line_end", "name")
    rows = members(entries, found, key).withColumn("place", F.row_number().over(order)).where(F.col("place") <= shown)
    return rows.select(F.col(key).alias("group_hash"), "place", F.format_string("%s:%s:L%d-%d", "file_path", "name", "line_start", "line_end").alias("location"))
