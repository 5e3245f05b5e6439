"""Refactoring recommendations and report summaries over duplicate groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What in a path makes it a test.
TEST_MARKS = ("test_", "_test.", "/tests/", "/test/", "conftest", "spec.")


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a | b, (low.contains(m) for m in TEST_MARKS), low.startswith("tests/"))


def is_test_location(path: Column) -> Column:
    return path.contains("/tests/") | path.startswith("tests/") | path.contains("/test_")


def step(value: Column, marks: list[tuple[float, float]], other: float) -> Column:
    out = F.lit(None).cast("double")
    for least, score in reversed(marks):
        out = F.when(value >= least, score).otherwise(out)
    return F.coalesce(out, F.lit(other))


def recommend(entries: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """(group_hash, size, impact, confidence, level, action, keep, lines, total_lines, nodes, files, tests, verified) of every
    group, one aggregate over its members. keep is the one path that is shallower than all others; a file at the root
    stands in the folder ``.``; a base class is for methods that all have a class."""
    rows = entries.join(groups.select(F.col("group_hash").alias(key), "verified"), key)
    directory = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(".")
    prod = F.when(is_test(F.col("file_path")), 0.0).otherwise(1.0)
    parts = F.size(F.split("file_path", "/"))
    g = rows.groupBy(F.col(key).alias("group_hash")).agg(
        F.count("*").alias("size"), F.avg("node_count").alias("nodes"), F.avg(F.col("line_end") - F.col("line_start") + 1).alias("lines"), F.avg(prod).alias("prod"),
        F.count_distinct(directory).alias("dirs"), F.every((F.col("unit_type") == "method") & (F.coalesce("parent_name", F.lit("")) != "")).alias("methods"), F.count_distinct("parent_name").alias("parents"),
        F.first("verified").alias("verified"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("total_lines"), F.sum("node_count").alias("all_nodes"), F.count_distinct("file_path").alias("files"), F.count_if(is_test(F.col("file_path"))).alias("tests"), F.min_by("file_path", F.struct(parts.alias("p"), "file_path")).alias("shallow"),
    )
    # how many members stand at the least depth: counted by depth first, so no group is ever gathered
    depths = rows.groupBy(F.col(key).alias("group_hash"), parts.alias("depth")).agg(F.count("*").alias("n")).groupBy("group_hash").agg(F.min_by("n", "depth").alias("at_least"))
    g = g.join(depths, "group_hash")
    impact = F.least(F.lit(1.0), F.least(F.lit(0.3), 0.1 + (F.col("size") - 1) * 0.05) + step(F.col("nodes"), [(50, 0.3), (20, 0.25), (10, 0.15)], 0.05) + F.col("prod") * 0.25 + step(F.col("lines"), [(30, 0.15), (15, 0.1), (5, 0.05)], 0.0))
    sure = F.least(F.lit(1.0), 0.5 + F.when(F.col("verified"), 0.25).otherwise(0.1) + step(F.col("nodes"), [(15, 0.15), (8, 0.1)], 0.0) + F.when(F.col("prod") == 1, 0.1).when(F.col("prod") > 0, 0.05).otherwise(0.0))
    action = F.when(F.col("prod") == 0, "review").when(F.col("methods") & (F.col("parents") > 1), "extract_base_class").when(F.col("dirs") == 1, "consolidate").otherwise("extract_utility")
    g = g.withColumn("impact", impact).withColumn("confidence", sure).withColumn("action", action)
    level = F.when(F.col("impact") >= 0.7, "high").when(F.col("impact") >= 0.45, "medium").when(F.col("impact") >= 0.25, "low").otherwise("trivial")
    return g.select(
        "group_hash", "size", "impact", "confidence", level.alias("level"), "action", F.when(F.col("at_least") == 1, F.col("shallow")).alias("keep"),
        F.expr("total_lines div size").alias("lines"), "total_lines", F.expr("all_nodes div size").alias("nodes"), "files", "tests", "verified",
    )


# The texts of recommendations.
SUMMARY = {
    "extract_utility": ("Consider extracting %d duplicate implementations to a shared utility", "Found %d structurally identical code blocks (~%d lines each) across %d files. Extracting to a shared utility would reduce maintenance burden and ensure consistent behavior."),
    "consolidate": ("Consider consolidating %d duplicates within the same directory", "Found %d identical implementations in the same directory. Consolidating into a single local function would improve maintainability."),
    "extract_base_class": ("Consider extracting %d duplicate methods to a base class", "Found %d identical methods across different classes. A base class or mixin could eliminate this duplication while preserving the object-oriented design."),
    "review": ("Review %d similar test implementations", "Found %d structurally identical code blocks in test files. This may be intentional (test isolation) or could benefit from test fixtures/helpers. Review to determine if consolidation is appropriate."),
}


def described(found: DataFrame) -> DataFrame:
    """recommend()'s rows with summary, rationale, evidence (facts, in order), lines_saved and keep_reason."""
    by = lambda i: F.coalesce(*(F.when(F.col("action") == a, F.format_string(t[i], "size", *(["lines", "files"] if t[i].count("%d") == 3 else []))) for a, t in SUMMARY.items()))
    prod = F.col("size") - F.col("tests")
    facts = F.array(
        F.format_string("%d structurally identical code units detected", "size"), F.format_string("Each instance contains approximately %d lines", "lines"), F.format_string("AST complexity: %d nodes per instance", "nodes"),
        F.when(F.col("verified"), "Structural equivalence verified by canonical form").otherwise("Structural equivalence indicated by matching Weisfeiler-Leman hash"),
        F.when((F.col("tests") > 0) & (prod > 0), F.format_string("Duplication spans test and production code (%d prod, %d test)", prod, "tests")).when(F.col("tests") > 0, "All instances are in test files").otherwise("All instances are in production code"),
    )
    return found.withColumns({"summary": by(0), "rationale": by(1), "evidence": facts, "lines_saved": F.col("total_lines") - F.col("lines"), "keep_reason": F.when(F.col("keep").isNotNull(), "shallowest path")})


def name_tokens(name: Column) -> Column:
    """The parts of a name in snake or camel case, in lower case: every capital begins a part but at a part's start."""
    return F.transform(F.filter(F.split(F.regexp_replace(name, "(?<=[^_])(?=\\p{Lu})", "_"), "_"), lambda x: x != ""), lambda x: F.lower(x))


def suggested_names(entries: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """(group_hash, suggested_name): the up to three parts that most names of a group have, the most frequent first (then
    the one that comes first in the alphabet); without any, the shortest name."""
    rows = entries.join(groups.select(F.col("group_hash").alias(key), "size"), key).select(F.col(key).alias("group_hash"), "size", "name")
    short = rows.groupBy("group_hash").agg(F.min_by("name", F.struct(F.length("name").alias("n"), "name")).alias("short"))
    counts = rows.select("group_hash", "size", F.explode(name_tokens(F.col("name"))).alias("token")).groupBy("group_hash", "size", "token").agg(F.count("*").alias("n"))
    common = counts.where(F.expr("n >= size div 2 + 1")).groupBy("group_hash").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "token"))), 1, 3).alias("best"))
    out = short.join(common, "group_hash", "left")
    return out.select("group_hash", F.coalesce(F.array_join(F.transform("best", lambda x: x["token"]), "_"), "short").alias("suggested_name"))


def ranked(found: DataFrame) -> DataFrame:
    """Recommendations by falling impact."""
    return found.orderBy(F.desc("impact"), "group_hash")


def compact(found: DataFrame) -> DataFrame:
    """(group_hash, json): a recommendation as a compact record."""
    return found.select("group_hash", F.to_json(F.struct("action", "summary", "level", F.round("impact", 2).alias("impact"), F.round("confidence", 2).alias("confidence"), "size", "keep", "lines_saved")).alias("json"))


def report_lines(found: DataFrame, locations: DataFrame, shown: int = 100) -> list[str]:
    """The text of the ``shown`` recommendations of highest impact, numbered; locations: (group_hash, places)."""
    rows = ranked(found.join(locations, "group_hash")).limit(shown).collect()
    out = []
    for i, r in enumerate(rows, 1):
        out.append(f"{i}. {r.action}: {', '.join(r.places)}")
        if r.keep:
            out.append(f"   -> Keep {r.keep} (shallowest path)")
    return out or ["No refactoring opportunities identified."]


def summary(kinds: dict[str, tuple[DataFrame, str, DataFrame]]) -> DataFrame:
    """(kind, is_test, findings, locations): kinds names entries, key and groups. A finding is a test's if all of its
    members are."""
    out = []
    for kind, (entries, key, groups) in kinds.items():
        rows = entries.join(groups.select(F.col("group_hash").alias(key)), key, "left_semi")
        out.append(rows.groupBy(key).agg(F.count("*").alias("n"), F.every(is_test_location(F.col("file_path"))).alias("is_test")).select(F.lit(kind).alias("kind"), "n", "is_test"))
    return reduce(DataFrame.unionByName, out).groupBy("kind", "is_test").agg(F.count("*").alias("findings"), F.sum("n").alias("locations"))
