"""Queries over the driver's tables and the SQL each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import signals, tokens
from tessera.operators import duplicates as dup
from tessera.operators import extract, labels, maintenance, recommend, report, trees
from tessera.plans import corpus, texts
from tessera.plans.corpus import PART_ENTRIES_SQL, PARTS_SQL, PROBE_ENTRIES_SQL, table
from tessera.sources import scan, store
from tessera.sources.scratch import folder, written
from tessera.streaming import events as ev
from tessera.streaming import storms

ENTRY_COLUMNS = ("node_count", "depth", "wl_hash", "pattern_hash", "canonical_hash", "fingerprint")
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- graphs and hashes


@query(f"WITH {PARTS_SQL}, {corpus.nodes_sql('parts')} SELECT DISTINCT line, label FROM (SELECT l.line, n.label FROM lines_parts l JOIN nodes_parts n ON n.unit_id = l.unit_id AND n.id = l.i)")
def line_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of all lines, by column expressions alone."""
    lines = corpus.part_files(spark, sf).select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line")).where("line <> ''").distinct()
    return lines.select("line", labels.line_label_column(F.col("line")).alias("label"))


@query(f"WITH {PART_ENTRIES_SQL} SELECT unit_id, {', '.join(ENTRY_COLUMNS)}, array_to_string(hierarchy, '|') AS levels FROM entries_parts")
def index_entries(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.part_entries(spark, sf).select("unit_id", *ENTRY_COLUMNS, F.array_join("hierarchy", "|").alias("levels"))


@query(f"WITH {PART_ENTRIES_SQL} SELECT count(*) AS entries, count(DISTINCT wl_hash) AS unique_wl, count(DISTINCT pattern_hash) AS unique_patterns, count(DISTINCT file_path) AS files, sum(node_count) AS nodes FROM entries_parts")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.part_entries(spark, sf).agg(F.count("*").alias("entries"), F.count_distinct("wl_hash").alias("unique_wl"), F.count_distinct("pattern_hash").alias("unique_patterns"), F.count_distinct("file_path").alias("files"), F.sum("node_count").alias("nodes"))


# ---- duplicates

EXACT_SQL = f"WITH {PART_ENTRIES_SQL}, ex AS (SELECT wl_hash AS group_hash, count(*) AS size, count(DISTINCT canonical_hash) = 1 AS verified FROM entries_parts WHERE node_count >= 5 GROUP BY wl_hash HAVING count(*) >= 2)"


@query(f"{EXACT_SQL} SELECT * FROM ex")
def dup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dup.exact(corpus.part_index(spark, sf)).select("group_hash", "size", "verified")


@query(f"""WITH {PART_ENTRIES_SQL}, {corpus.form_sql('g_parts_', 'nodes_parts', 'plabel')}, twice AS (SELECT wl_hash FROM entries_parts GROUP BY 1 HAVING count(*) > 1)
    SELECT pattern_hash AS group_hash, count(*) AS size, count(DISTINCT wl_hash) AS n_wl, count(DISTINCT f) = 1 AS verified FROM entries_parts JOIN g_parts_0 USING (unit_id) WHERE node_count >= 5 GROUP BY 1
    HAVING count(*) >= 2 AND NOT (count(DISTINCT wl_hash) = 1 AND min(wl_hash) IN (SELECT wl_hash FROM twice))""")
def dup_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return dup.pattern(corpus.part_index(spark, sf)).select("group_hash", "size", "n_wl", "verified")


NATIONS_SQL = "nat AS (SELECT n_nationkey AS unit_id, concat('function g() {', chr(10), 'a(', chr(10), 'if (x) {', chr(10), 'while (y) {', chr(10), 'for (z) {', chr(10), 'try {', chr(10), repeat('go w' || chr(10), CAST(n_nationkey + 1 AS INT)), CASE WHEN n_nationkey % 2 = 0 THEN 'v = ' ELSE 'call()' END, chr(10), '}}}}}') AS code FROM nation)"


@query(f"""WITH {NATIONS_SQL}, {corpus.entries_sql('nat', 'u.unit_id')}, free AS (SELECT * FROM entries_nat WHERE node_count >= 5
      AND wl_hash NOT IN (SELECT wl_hash FROM entries_nat GROUP BY 1 HAVING count(*) > 1) AND pattern_hash NOT IN (SELECT pattern_hash FROM entries_nat GROUP BY 1 HAVING count(*) > 1))
    SELECT substr(sha256(array_to_string(hierarchy[1:4], '|')), 1, 16) AS group_hash, count(*) AS size, count(DISTINCT wl_hash) AS n_wl FROM free GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT wl_hash) >= 2""")
def dup_near(spark: SparkSession, sf: str) -> DataFrame:
    """Near groups among deep functions, one a nation."""
    code = F.expr(NATIONS_SQL[NATIONS_SQL.index("concat(") : NATIONS_SQL.index(" AS code")])
    units = table(spark, sf, "nation").select(F.col("n_nationkey").alias("unit_id"), F.lit("function").alias("unit_type"), F.lit("c").alias("language"), code.alias("code"))
    return dup.near(trees.entries(units)).select("group_hash", "size", "n_wl")


@query(f"{EXACT_SQL} SELECT count(*) > 0 AS has_duplicates FROM ex")
def has_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dup.has_duplicates(corpus.part_index(spark, sf))


@query("""SELECT kind AS block_type, CAST(count(*) AS BIGINT) AS blocks, count(DISTINCT key) AS structures FROM (
    SELECT unnest(CASE p_partkey % 5 WHEN 1 THEN ['for'] WHEN 2 THEN ['if'] WHEN 3 THEN ['while', 'if'] WHEN 4 THEN ['try'] ELSE [] END) AS kind,
           CASE WHEN p_partkey % 5 = 2 THEN 'two' ELSE CAST(p_partkey % 5 AS VARCHAR) || CAST(p_size % 4 AS VARCHAR) END AS key FROM part) GROUP BY kind""")
def brace_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that brace counting finds, and how many structures they have."""
    e = trees.entries(extract.units(corpus.part_files(spark, sf)))
    return e.where("unit_type = 'block'").groupBy("block_type").agg(F.count("*").alias("blocks"), F.count_distinct("wl_hash").alias("structures"))


@query("SELECT name, unit_type, line_start, line_end FROM (SELECT 'g' || s_suppkey AS name, 'function' AS unit_type, 1 AS line_start, CASE s_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 5 END AS line_end, s_suppkey FROM supplier) UNION ALL SELECT 'g' || s_suppkey || '.for_1', 'block', 2, 3 FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT 'g' || s_suppkey || unnest(['.if_1', '.if_1.while_1']), 'block', unnest([2, 3]), 4 FROM supplier WHERE s_suppkey % 3 = 2")
def python_units(spark: SparkSession, sf: str) -> DataFrame:
    return extract.units(python_files(spark, sf)).select("name", "unit_type", "line_start", "line_end")


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    body = "CASE " + " ".join(f"WHEN s_suppkey % 3 = {i} THEN '" + b.replace("\n", "~") + "'" for i, b in enumerate(corpus.PYTHON_BODIES)) + " END"
    op = "CASE " + " ".join(f"WHEN s_nationkey % 4 = {i} THEN '{o}'" for i, o in enumerate(corpus.OPS)) + " END"
    text = f"replace(concat('def g', cast(s_suppkey as string), '(a, b):~', replace({body}, 'OP', {op})), '~', chr(10))"
    return table(spark, sf, "supplier").select(F.concat(F.lit("lib/g"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), F.expr(text).alias("text"))


@query("SELECT count(*) AS size FROM (SELECT s_suppkey % 3 AS k, s_nationkey % 4 AS o FROM supplier) GROUP BY k, o HAVING count(*) >= 2")
def python_dups(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of exact groups of Python functions; the oracle knows them by how they were made."""
    return dup.exact(trees.entries(extract.units(python_files(spark, sf)))).select("size")


# ---- probes and gates

SIMILAR_SQL = f"""WITH {PART_ENTRIES_SQL}, {PROBE_ENTRIES_SQL},
    tiers AS (SELECT probe_id, unit_id, 1 AS r, NULL AS depth FROM entries_probes p JOIN entries_parts e USING (wl_hash) WHERE p.node_count >= 5
      UNION ALL SELECT probe_id, unit_id, 2, NULL FROM entries_probes p JOIN entries_parts e USING (fingerprint) WHERE p.node_count >= 5
      UNION ALL SELECT probe_id, unit_id, 3, CASE WHEN p.hierarchy[3] <> e.hierarchy[3] THEN 2 WHEN p.hierarchy[4] <> e.hierarchy[4] THEN 3 WHEN p.hierarchy[5] <> e.hierarchy[5] THEN 4 ELSE 5 END
        FROM entries_probes p JOIN entries_parts e ON p.hierarchy[1] = e.hierarchy[1] AND p.hierarchy[2] = e.hierarchy[2] WHERE p.node_count >= 5),
    best AS (SELECT probe_id, unit_id, min(r) AS r, max(depth) AS depth FROM tiers GROUP BY ALL)"""


@query(f"{SIMILAR_SQL} SELECT probe_id, ['exact', 'high', 'partial'][r] AS match, CAST(CASE WHEN r = 3 THEN depth END AS INT) AS depth, count(*) AS entries FROM best GROUP BY ALL")
def similar_probe(spark: SparkSession, sf: str) -> DataFrame:
    """How many entries match each probe, by tier and depth."""
    return dup.similar_counts(corpus.supplier_probes(spark, sf), corpus.part_index(spark, sf))


@query(f"""{SIMILAR_SQL}, placed AS (SELECT probe_id, unit_id, r, CASE WHEN r = 3 THEN depth END AS depth, row_number() OVER (PARTITION BY probe_id ORDER BY r, CASE WHEN r = 3 THEN depth ELSE 0 END DESC, unit_id) AS place FROM best)
    SELECT probe_id, CAST(place AS INT) AS place, unit_id, ['exact', 'high', 'partial'][r] AS match, CAST(depth AS INT) AS depth FROM placed WHERE place <= 10""")
def similar_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten entries that match each probe best: only those are named."""
    probes = written(corpus.supplier_probes(spark, sf), "probes")
    return dup.top_similar(probes, corpus.part_index(spark, sf), 10)


@query(f"{SIMILAR_SQL}, top AS (SELECT probe_id, min(r) AS r FROM best GROUP BY 1) SELECT probe_id, ['exact', 'high', 'partial'][r] AS match, coalesce(['STOP', 'CAUTION', 'NOTE'][r], 'CREATE') AS decision FROM entries_probes LEFT JOIN top USING (probe_id)")
def gate_decision(spark: SparkSession, sf: str) -> DataFrame:
    probes = written(corpus.supplier_probes(spark, sf), "probes")
    return dup.gate(dup.best_matches(probes, corpus.part_index(spark, sf)), probes)


@query(f"""WITH {PROBE_ENTRIES_SQL}, pairs AS (SELECT a.probe_id AS pair_id, a, b FROM entries_probes a JOIN entries_probes b ON b.probe_id = a.probe_id + 1)
    SELECT pair_id, CASE WHEN a.canonical_hash = b.canonical_hash THEN 'equivalent' WHEN a.wl_hash = b.wl_hash OR a.fingerprint = b.fingerprint THEN 'similar' ELSE 'different' END AS verdict FROM pairs""")
def compare_structural(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's snippet against the next one's."""
    p = corpus.supplier_probes(spark, sf)
    cols = [F.col(c) for c in ("canonical_hash", "wl_hash", "fingerprint")]
    a = p.select(F.col("probe_id").alias("pair_id"), F.struct(*cols).alias("a"))
    b = p.select((F.col("probe_id") - 1).alias("pair_id"), F.struct(*cols).alias("b"))
    return dup.compare(a.join(b, "pair_id"))


# ---- suppression and maintenance

FIRST_SQL = "sup AS (SELECT group_hash FROM ex ORDER BY size DESC, group_hash LIMIT 3)"


def suppressed_three(e: DataFrame) -> DataFrame:
    """The three largest exact groups: a suppression list."""
    return dup.exact(e).orderBy(F.desc("size"), "group_hash").limit(3).select(F.col("group_hash").alias("hash"))


@query(f"{EXACT_SQL}, {FIRST_SQL} SELECT * FROM ex WHERE group_hash NOT IN (SELECT group_hash FROM sup)")
def suppress_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = corpus.part_index(spark, sf)
    return dup.exact(e, suppressed=suppressed_three(e)).select("group_hash", "size", "verified")


@query(f"""{EXACT_SQL}, {FIRST_SQL}, a AS (SELECT group_hash, count(*) AS entry_count, count(DISTINCT file_path) AS n_files, min(name) AS first_name FROM sup JOIN entries_parts ON wl_hash = group_hash GROUP BY 1)
    SELECT group_hash AS hash, entry_count, n_files, first_name FROM a""")
def suppress_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    e = corpus.part_index(spark, sf)
    return maintenance.suppress(e, suppressed_three(e)).select("hash", "entry_count", "n_files", "first_name")


@query(f"""{EXACT_SQL}, {FIRST_SQL}, now AS (SELECT DISTINCT wl_hash FROM entries_parts WHERE starts_with(file_path, 'tests/'))
    SELECT group_hash AS hash, group_hash NOT IN (SELECT wl_hash FROM now) AS stale FROM sup""")
def suppress_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Which suppressions outlive an index of which only the tests are left."""
    e = corpus.part_index(spark, sf)
    return maintenance.stale(suppressed_three(e), e.where(F.col("file_path").startswith("tests/")))


@query(f"""WITH {PART_ENTRIES_SQL}, g AS (SELECT wl_hash, count(*) FILTER (WHERE unit_id % 11 <> 0) AS files, count(*) FILTER (WHERE unit_id % 11 <> 0 AND unit_id % 5 <> 1) AS living, bool_or(unit_id % 11 = 0 OR unit_id % 5 IN (1, 2)) AS touched
      FROM entries_parts WHERE node_count >= 5 GROUP BY 1 HAVING count(*) >= 2)
    SELECT wl_hash AS hash, CASE WHEN touched AND living = 0 THEN 'suppressed code structure no longer exists' ELSE 'kept' END AS state, CASE WHEN NOT (touched AND living = 0) THEN CAST(files AS INT) END AS files FROM g""")
def suppress_invalidate(spark: SparkSession, sf: str) -> DataFrame:
    """Suppressions of all exact groups against files that went (every eleventh), hold another structure (of each five the
    second), or only another text (the third): which end, and how many files are left to the others."""
    e, before = corpus.part_index(spark, sf), corpus.part_files(spark, sf)
    meta = maintenance.metadata_of(before.withColumn("mtime", F.lit(1.0)), e, 1.0)
    known = written(maintenance.suppressions(e, dup.exact(e).select(F.col("group_hash").alias("hash")), meta, 1.0), "suppressions")
    text = F.when(F.col("p_partkey") % 5 == 1, F.expr(corpus.code_expr("(p_partkey + 1)", "p_size"))).when(F.col("p_partkey") % 5 == 2, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    now = table(spark, sf, "part").select("p_partkey", "p_size").join(before, "p_partkey").where("p_partkey % 11 <> 0").withColumn("text", text)
    go_on, ended = maintenance.invalidate(known, e, now.select("file_path", "language", "text"))
    kept = go_on.select("hash", F.lit("kept").alias("state"), F.size("source_files").alias("files"))
    return kept.unionByName(ended.select("hash", F.col("reason").alias("state"), F.lit(None).cast("int").alias("files")))


@query(f"""WITH {PART_ENTRIES_SQL}, g AS (SELECT wl_hash AS group_hash, count(*) AS size, bool_and(starts_with(file_path, 'tests/')) AS is_test FROM entries_parts WHERE node_count >= 5 GROUP BY 1 HAVING count(*) >= 2)
    SELECT group_hash, row_number() OVER (ORDER BY is_test, size DESC, group_hash) AS place FROM g""")
def report_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers that a report gives its findings, by one count a task."""
    e = corpus.part_index(spark, sf).where("node_count >= 5")
    found = report.described(e, dup.exact(e), "wl_hash")
    return report.numbered(found, "is_test", F.desc("size"), "group_hash").select("group_hash", "place")


@query("""WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), b AS (SELECT item_id AS doc_id, sha256(text) AS h FROM benchmark)
    SELECT status, count(*) AS files FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'removed' WHEN b.doc_id IS NULL THEN 'added' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS status
    FROM a FULL JOIN b ON a.doc_id = b.doc_id) GROUP BY 1""")
def incremental_status(spark: SparkSession, sf: str) -> DataFrame:
    """documents as the tree of today, benchmark as what was indexed, by id."""
    now = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.coalesce("text", F.lit("")).alias("text"))
    before = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("file_path"), F.sha2("text", 256).alias("content_hash"))
    return maintenance.status(now, before).groupBy("status").agg(F.count("*").alias("files"))


@query("""WITH l AS (SELECT 'src/' || p_partkey || '.py' AS f, p_size AS mtime, sha256(p_name) AS h FROM part),
    m AS (SELECT 'src/' || p_partkey || '.py' AS f, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS mtime, sha256(CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE p_name END) AS h FROM part WHERE p_partkey % 7 <> 0
          UNION ALL SELECT 'old/' || p_partkey || '.py', p_size, sha256(p_name) FROM part WHERE p_partkey % 11 = 0)
    SELECT status, opened, count(*) AS files FROM (
        SELECT l.f IS NOT NULL AND coalesce(l.mtime <> m.mtime, true) AS opened,
               CASE WHEN l.f IS NULL THEN 'removed' WHEN m.f IS NULL THEN 'added' WHEN l.mtime = m.mtime OR l.h = m.h THEN 'unchanged' ELSE 'updated' END AS status FROM l FULL JOIN m ON l.f = m.f) GROUP BY ALL""")
def incremental_gate(spark: SparkSession, sf: str) -> DataFrame:
    """part as a tree whose files keep their time, were only touched, changed, came or went: what is opened, what it comes to."""
    part = table(spark, sf, "part").withColumn("file_path", F.expr("concat('src/', p_partkey, '.py')"))
    listed = part.select("file_path", F.col("p_size").cast("double").alias("mtime"))
    known = part.where("p_partkey % 7 <> 0").select("file_path", F.expr("cast(p_size + if(p_partkey % 3 = 0, 1, 0) as double)").alias("mtime"), F.expr("sha2(if(p_partkey % 6 = 0, p_brand, p_name), 256)").alias("content_hash"))
    gone = part.where("p_partkey % 11 = 0").select(F.expr("concat('old/', p_partkey, '.py')").alias("file_path"), F.col("p_size").cast("double").alias("mtime"), F.sha2("p_name", 256).alias("content_hash"))
    known = known.unionByName(gone)
    opened = maintenance.to_open(listed, known).join(part.select("file_path", F.col("p_name").alias("text")), "file_path")
    return maintenance.gated_status(listed, opened, known).groupBy("status", "opened").agg(F.count("*").alias("files"))


@query(f"""WITH {PART_ENTRIES_SQL}, ex AS (SELECT wl_hash, min(file_path) AS first FROM entries_parts WHERE node_count >= 5 GROUP BY 1 HAVING count(*) >= 2),
    now AS (SELECT wl_hash AS h FROM entries_parts WHERE starts_with(file_path, 'tests/') UNION SELECT pattern_hash FROM entries_parts WHERE starts_with(file_path, 'tests/')),
    changes AS (SELECT CASE WHEN unit_id % 13 <> 0 AND unit_id % 11 = 0 THEN 'deleted' WHEN unit_id % 13 = 0 AND unit_id % 11 <> 0 THEN 'new' WHEN unit_id % 13 <> 0 AND unit_id % 5 = 2 THEN 'modified' END AS kind, file_path FROM parts)
    SELECT kind, file_path AS item FROM changes WHERE kind IS NOT NULL
    UNION ALL SELECT 'stale suppression', wl_hash || ': ' || CASE WHEN wl_hash NOT IN (SELECT h FROM now) THEN 'code no longer exists in index' ELSE 'source file ' || first || ' removed from index' END
      FROM ex WHERE wl_hash NOT IN (SELECT h FROM now) OR NOT starts_with(first, 'tests/')""")
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    """What is stale: files that changed, went or came, and suppressions that an index of the tests alone no longer bears."""
    e, files = corpus.part_index(spark, sf), corpus.part_files(spark, sf)
    now = files.where("p_partkey % 11 <> 0").withColumn("text", F.when(F.col("p_partkey") % 5 == 2, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    before = files.where("p_partkey % 13 <> 0").select("file_path", maintenance.content_hash(F.col("text")).alias("content_hash"))
    known = maintenance.suppressions(e, dup.exact(e).select(F.col("group_hash").alias("hash")), before, 1.0)
    return maintenance.staleness_report(maintenance.status(now, before), e.where(F.col("file_path").startswith("tests/")), known)


# ---- the store


@query("""SELECT p_brand AS file_path, p_partkey AS unit_id, p_size AS node_count FROM part
    QUALIFY CASE WHEN p_brand LIKE '%1' THEN p_size <= 10 WHEN p_brand LIKE '%2' THEN p_size > 25 OR max(p_size) OVER (PARTITION BY p_brand) <= 25 ELSE true END""")
def store_merge(spark: SparkSession, sf: str) -> DataFrame:
    """An index in the store, a file a brand: files that end in 1 go and come back smaller, those that end in 2 are replaced."""
    root = f"{folder(spark)}/store-{uuid.uuid4().hex}"
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("file_path"), F.col("p_partkey").alias("unit_id"), F.col("p_size").alias("node_count"))
    one, two = (F.col("file_path").endswith(x) for x in "12")
    store.save({"entries": rows}, root)
    store.save_delta(spark, root, rows.where(one).select(F.lit("entries").alias("table"), F.col("file_path").alias("key")).distinct())
    store.save_delta(spark, root, entries=rows.where(two & (F.col("node_count") > 25)))
    store.save_delta(spark, root, entries=rows.where(one & (F.col("node_count") <= 10)))
    return store.load(spark, root, "entries")


@query(f"WITH {PART_ENTRIES_SQL} SELECT CAST(unit_id AS VARCHAR) AS unit_id, name, file_path, line_end, node_count, wl_hash, fingerprint, array_to_string(hierarchy, '|') AS levels FROM entries_parts")
def entry_records(spark: SparkSession, sf: str) -> DataFrame:
    """Entries as JSON records, and read back from them."""
    back = report.entries_from_json(report.entries_to_json(corpus.part_entries(spark, sf)))
    return back.select("unit_id", "name", "file_path", "line_end", "node_count", "wl_hash", "fingerprint", F.array_join("hierarchy", "|").alias("levels"))


# ---- reports


@query(f"""WITH {PART_ENTRIES_SQL}, m AS (SELECT wl_hash, count(*) OVER (PARTITION BY wl_hash) AS size, file_path || ':' || name || ':L' || line_start || '-' || line_end AS location,
      row_number() OVER (PARTITION BY wl_hash ORDER BY file_path, line_start, line_end, name) AS place FROM entries_parts WHERE node_count >= 5)
    SELECT wl_hash AS group_hash, CAST(place AS INT) AS place, location FROM m WHERE size >= 2 AND place <= 5""")
def report_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = corpus.part_index(spark, sf).where("node_count >= 5")
    return dup.top_members(e, dup.exact(e), "wl_hash")


@query(f"""WITH {PART_ENTRIES_SQL}, g AS (SELECT wl_hash AS h, 'exact' AS kind, count(*) AS n, bool_and(starts_with(file_path, 'tests/')) AS is_test FROM entries_parts WHERE node_count >= 5 GROUP BY 1 HAVING count(*) >= 2)
    SELECT kind, is_test, count(*) AS findings, CAST(sum(n) AS BIGINT) AS locations FROM g GROUP BY ALL""")
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = corpus.part_index(spark, sf)
    return recommend.summary({"exact": (e.where("node_count >= 5"), "wl_hash", dup.exact(e))})


@query(f"""WITH {PART_ENTRIES_SQL}, g AS (SELECT wl_hash AS group_hash, count(*) AS n, avg(node_count) AS nodes, avg(line_end - line_start + 1) AS lines, avg(CASE WHEN starts_with(file_path, 'tests/') THEN 0.0 ELSE 1.0 END) AS prod,
      count(DISTINCT CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END) AS dirs, count(DISTINCT canonical_hash) = 1 AS verified FROM entries_parts WHERE node_count >= 5 GROUP BY 1 HAVING count(*) >= 2),
    s AS (SELECT *, least(1.0, least(0.3, 0.1 + (n - 1) * 0.05) + CASE WHEN nodes >= 50 THEN 0.3 WHEN nodes >= 20 THEN 0.25 WHEN nodes >= 10 THEN 0.15 ELSE 0.05 END + prod * 0.25 + CASE WHEN lines >= 30 THEN 0.15 WHEN lines >= 15 THEN 0.1 WHEN lines >= 5 THEN 0.05 ELSE 0 END) AS impact,
      least(1.0, 0.5 + CASE WHEN verified THEN 0.25 ELSE 0.1 END + CASE WHEN nodes >= 15 THEN 0.15 WHEN nodes >= 8 THEN 0.1 ELSE 0 END + CASE WHEN prod = 1 THEN 0.1 WHEN prod > 0 THEN 0.05 ELSE 0 END) AS confidence FROM g)
    SELECT group_hash, round(CAST(impact AS DOUBLE), 4) AS impact, round(CAST(confidence AS DOUBLE), 4) AS confidence, CASE WHEN impact >= 0.7 THEN 'high' WHEN impact >= 0.45 THEN 'medium' WHEN impact >= 0.25 THEN 'low' ELSE 'trivial' END AS level,
      CASE WHEN prod = 0 THEN 'review' WHEN dirs = 1 THEN 'consolidate' ELSE 'extract_utility' END AS action FROM s""")
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    e = corpus.part_index(spark, sf)
    return recommend.recommend(e.where("node_count >= 5"), "wl_hash", dup.exact(e)).select("group_hash", F.round("impact", 4).alias("impact"), F.round("confidence", 4).alias("confidence"), "level", "action")


# ---- sources

#: Paths, a number in place of {n}: those with a folder that is never entered, and whether the rules ignore them.
SKIPPED = (("src/a{n}.py", False), ("venv311/x{n}.py", True), ("env/y{n}.py", True), ("environment/z{n}.py", False), (".git/h{n}.py", True), ("p{n}.egg-info/m.py", True), ("a/node_modules/b{n}.js", True), ("envoy/k{n}.py", False),
           ("vendor/v{n}.go", True), ("target/classes/t{n}.java", True), ("out/o{n}.c", True), ("a/.gradle/g{n}.java", True), (".next/n{n}.js", True), ("x/.nuxt/u{n}.ts", True), ("coverage/c{n}.js", True), (".eggs/e{n}.py", True), ("cmake-build-debug/d{n}.cpp", True), ("outer/w{n}.c", False), ("targets/s{n}.go", False))
IGNORED = (("docs/build{n}.min.js", True), ("vendor/lib/q{n}.go", True), ("logs/a/b{n}.log", True), ("logs/keep.log", False), ("keep/vendor{n}.txt", False), ("docs/r{n}.txt", True), ("x/docs/r{n}.txt", False), ("a/gen/b{n}/c.ts", True))
RULES = ("# comment", "", "*.min.js", "vendor/", "*.log", "!logs/keep.log", "/docs/*.txt", "a/**/c.ts")


def path_sql(made: tuple) -> str:
    """An SQL expression of the path made for a part, the same in both engines."""
    return "replace(CASE " + " ".join(f"WHEN p_partkey % {len(made)} = {i} THEN '{p}'" for i, (p, _) in enumerate(made)) + " END, '{n}', CAST(p_partkey AS VARCHAR(20)))"


def verdict_sql(made: tuple) -> str:
    return f"p_partkey % {len(made)} IN ({', '.join(str(i) for i, (_, yes) in enumerate(made) if yes)})"


@query(f"SELECT {path_sql(SKIPPED)} AS path, {verdict_sql(SKIPPED)} AS skipped FROM part")
def scan_skip_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.expr(path_sql(SKIPPED)).alias("path")).withColumn("skipped", scan.skipped(F.col("path")))


@query(f"SELECT {path_sql(IGNORED)} AS path, {verdict_sql(IGNORED)} AS ignored FROM part")
def ignore_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.expr(path_sql(IGNORED)).alias("path")).withColumn("ignored", scan.ignored(F.col("path"), scan.parse_rules(RULES)))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_copies(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.content_copies(table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")).withColumnRenamed("first_file", "first_doc")


# ---- tokens and signals


@query("""SELECT 's' || s_suppkey AS file_path, CAST(s_nationkey AS INT) AS line, unnest([2, 7]) AS start_char, unnest([3, 1]) AS length, unnest([['class', 'variable', 'unknown_2'][s_suppkey % 3 + 1], 'unknown_9']) AS token_type,
      unnest([concat_ws(',', CASE WHEN s_suppkey % 4 // 2 = 1 THEN 'abstract' END, CASE WHEN s_suppkey % 8 // 4 = 1 THEN 'readonly' END, CASE WHEN s_suppkey % 2 = 1 THEN 'static' END), '']) AS modifiers,
      unnest([CASE WHEN s_nationkey < 20 THEN 'cde' ELSE '' END, CASE WHEN s_nationkey < 20 THEN 'h' ELSE '' END]) AS text FROM supplier""")
def tokens_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Two tokens of a file for every supplier, on the line of its nation's number, of twenty lines."""
    data = F.array(*(x.cast("int") for x in (F.col("s_nationkey"), F.lit(2), F.lit(3), F.col("s_suppkey") % 3, F.col("s_suppkey") % 8, F.lit(0), F.lit(5), F.lit(1), F.lit(9), F.lit(0))))
    raw = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_path"), data.alias("data"), F.array(F.lit("class"), F.lit("variable")).alias("token_types"), F.array(*map(F.lit, ("static", "abstract", "readonly"))).alias("token_modifiers"), F.array_repeat(F.lit("abcdefghij"), 20).alias("lines"))
    return tokens.tokens(raw).withColumn("modifiers", F.array_join("modifiers", ","))


def signal_query(language: str) -> None:
    """A query of a language's signals over a text for every part; its SQL has the signals that each text must show."""
    made = texts.TEXTS[language]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(k)}, {quoted(v)}, CAST({p} AS DOUBLE))" for i, (_, found) in enumerate(made) for k, v, p in found)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        code = F.element_at(F.array(*(F.lit(t) for t, _ in made)), (F.col("p_partkey") % len(made) + 1).cast("int"))
        units = table(spark, sf, "part").select(F.col("p_partkey").alias("unit_id"), F.lit(language).alias("language"), F.replace(code, F.lit("{n}"), F.col("p_partkey").cast("string")).alias("code"))
        return signals.signals(units).groupBy("key", "value", "confidence").agg(F.count("*").alias("units"))

    run.__name__ = f"signals_{language}"
    query(f"SELECT key, replace(value, '{{n}}', CAST(p_partkey AS VARCHAR)) AS value, confidence, count(*) AS units FROM part JOIN (VALUES {rows}) AS t(i, key, value, confidence) ON p_partkey % {len(made)} = t.i GROUP BY ALL")(run)


for _language in texts.TEXTS:
    signal_query(_language)


# ---- units by language

#: A text for each language (its functions numbered), and its units: name, type, block type, first and last line.
UNITS = {
    "c": ("#define X(a) { a\nstatic int f{n}(int a)\n{\n  // open {\n  for (;;) {\n    if (a > '{') {\n      a++;\n    }\n  }\n  return a;\n}\nint add{n}(a, b)\n  int a;\n  char *b;\n{\n  return a;\n}\nenum e{n} { A };\n", [("f{n}", "function", None, 2, 11), ("f{n}.for_1", "block", "for", 5, 9), ("f{n}.for_1.if_1", "block", "if", 6, 8), ("add{n}", "function", None, 12, 17)]),
    "cpp": ("namespace n {\nclass K{n} {\n  int get() const {\n    while (x) {\n      y();\n    }\n  }\n};\n}\nvoid K{n}::run(int z) {\n}\ntemplate <class T, class U = K<T>>\nclass EXPORT V{n} final : public K<T> {\n  void f() {\n  }\n};\nenum class E{n} : int {\n  A\n};\n", [("K{n}", "class", None, 2, 8), ("get", "method", None, 3, 7), ("get.while_1", "block", "while", 4, 6), ("run", "method", None, 10, 11), ("V{n}", "class", None, 12, 16), ("f", "method", None, 14, 15)]),
    "java": ("package p;\npublic class K{n} {\n  @Override\n  public int m{n}(int a) throws E {\n    try {\n      go();\n    } catch (E e) {\n    }\n  }\n}\nenum Z{n} {\n  A {\n    int g() {\n      return 1;\n    }\n  }, B;\n  int h{n}() {\n    return 2;\n  }\n}\n", [("K{n}", "class", None, 2, 10), ("m{n}", "method", None, 3, 9), ("m{n}.try_1", "block", "try", 5, 7), ("g", "method", None, 13, 15), ("h{n}", "method", None, 17, 19)]),
    "go": ("package p\n\ntype T{n} struct {\n  a int\n}\n\nfunc (t *T{n}) M(a int) (int, error) {\n  for {\n    x()\n  }\n}\n", [("T{n}", "class", None, 3, 5), ("M", "method", None, 7, 11), ("M.for_1", "block", "for", 8, 10)]),
    "javascript": ("class K{n} {\n  m(a) {\n    if (a) {\n      b();\n    }\n  }\n}\nconst f{n} = (x) => {\n  return x;\n};\n", [("K{n}", "class", None, 1, 7), ("m", "method", None, 2, 6), ("m.if_1", "block", "if", 3, 5), ("f{n}", "function", None, 8, 10)]),
    "typescript": ("export function f{n}<T>(a: T[], b?: number): T {\n  for (const x of a as T[]) {\n    use(x!);\n  }\n  return a[0];\n}\n", [("f{n}", "function", None, 1, 6), ("f{n}.for_of_1", "block", "for_of", 2, 4)]),
}


def unit_query(language: str) -> None:
    text, found = UNITS[language]
    numbered = lambda x: "NULL" if x is None else f"replace('{x}', '{{n}}', CAST(p_partkey AS VARCHAR))"
    rows = " UNION ALL ".join(f"SELECT p_partkey, {numbered(n)} AS name, '{t}' AS unit_type, {'NULL' if b is None else repr(b)} AS block_type, {first} AS line_start, {last} AS line_end FROM part" for n, t, b, first, last in found)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        code = F.replace(F.lit(text), F.lit("{n}"), F.col("p_partkey").cast("string"))
        files = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file_path"), F.lit(language).alias("language"), code.alias("text"))
        return extract.units(files).select(F.col("file_path").cast("long").alias("p_partkey"), "name", "unit_type", "block_type", "line_start", "line_end")

    run.__name__ = f"units_{language}"
    query(rows)(run)


for _language in UNITS:
    unit_query(_language)


@query("SELECT count(*) AS size FROM (SELECT p_partkey % 5 AS k, p_size % 4 AS o, p_size % 3 AS s FROM part) GROUP BY k, o, s HAVING count(*) >= 2")
def javascript_dups(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of exact groups of the part corpus read as JavaScript; the oracle knows them by how they were made."""
    files = corpus.part_files(spark, sf, dealt=True).withColumn("language", F.lit("javascript"))
    # blocks are in no exact group: they need no trees
    return dup.exact(trees.entries(extract.units(files).where(F.col("unit_type") != dup.BLOCK))).select("size")


@query("""SELECT kind AS block_type, count(*) AS size FROM (SELECT unnest(CASE p_partkey % 5 WHEN 1 THEN ['for'] WHEN 2 THEN ['if'] WHEN 3 THEN ['while', 'if'] WHEN 4 THEN ['try'] ELSE [] END) AS kind,
      CASE WHEN p_partkey % 5 = 2 THEN 'two' ELSE CAST(p_partkey % 5 AS VARCHAR) || CAST(p_size % 4 AS VARCHAR) END AS key FROM part) WHERE kind IN ('for', 'while', 'try') GROUP BY kind, key HAVING count(*) >= 2""")
def dup_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of groups of duplicate blocks of three types."""
    e = written(trees.entries(extract.units(corpus.part_files(spark, sf))), "units")
    groups = dup.blocks(e, 3, ["for", "while", "try"])
    kinds = dup.members(e.where("unit_type = 'block'"), groups, "wl_hash").groupBy(F.col("wl_hash").alias("group_hash")).agg(F.min("block_type").alias("block_type"))
    return groups.join(kinds, "group_hash").select("block_type", "size")


@query(f"""{EXACT_SQL}, p AS (SELECT pattern_hash AS h, count(*) AS n, min(line_end) AS lines, bool_and(starts_with(file_path, 'tests/')) AS is_test, count(DISTINCT wl_hash) AS n_wl, min(wl_hash) AS w FROM entries_parts WHERE node_count >= 5 GROUP BY 1 HAVING count(*) >= 2),
    g AS (SELECT 'exact' AS kind, wl_hash AS h, count(*) AS n, min(line_end) AS lines, bool_and(starts_with(file_path, 'tests/')) AS is_test FROM entries_parts WHERE node_count >= 5 GROUP BY 2 HAVING count(*) >= 2
      UNION ALL SELECT 'pattern', h, n, lines, is_test FROM p WHERE NOT (n_wl = 1 AND w IN (SELECT wl_hash FROM entries_parts GROUP BY 1 HAVING count(*) > 1)))
    SELECT kind, is_test, count(*) AS findings, CAST(sum(n) AS BIGINT) AS locations, CAST(sum(lines * n) AS BIGINT) AS lines FROM g GROUP BY ALL""")
def report_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The analysis of the part corpus, summed up by kind."""
    return report.summary_table(report.findings(corpus.part_index(spark, sf)))


@query(f"""{EXACT_SQL}, {FIRST_SQL} SELECT group_hash AS hash, 'why' AS reason, count(*) AS entry_count, arg_min(name, file_path) AS source_name, arg_min(substr(code, 1, 200), file_path) AS code_preview, count(DISTINCT file_path) AS n_files,
      min(file_path) AS primary_file FROM sup JOIN entries_parts e ON wl_hash = group_hash JOIN parts USING (unit_id, file_path, name) GROUP BY 1""")
def suppress_records(spark: SparkSession, sf: str) -> DataFrame:
    """Suppressions with what they keep of the three largest groups."""
    e = corpus.part_index(spark, sf)
    meta = maintenance.metadata_of(corpus.part_files(spark, sf).withColumn("mtime", F.lit(0.0)), e, 0.0)
    rows = maintenance.suppressions(e, suppressed_three(e), meta, 0.0, "why")
    return rows.select("hash", "reason", "entry_count", "source_name", "code_preview", F.size("source_files").cast("long").alias("n_files"), F.try_element_at("source_files", F.lit(1)).alias("primary_file"))


@query("""WITH p AS (SELECT p_partkey, [1, 2, 2, 3, 2][p_partkey % 5 + 1] AS units, CASE WHEN p_partkey % 10 = 0 THEN 'added' WHEN p_partkey % 10 = 1 THEN 'removed' WHEN p_partkey % 10 = 2 THEN 'updated' ELSE 'unchanged' END AS status FROM part)
    SELECT status, count(*) AS files, CAST(sum(CASE status WHEN 'removed' THEN 0 WHEN 'updated' THEN 1 ELSE units END) AS BIGINT) AS entries FROM p GROUP BY 1""")
def incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index of nine files of ten, brought up to date: a tenth is new, one is gone and one has other text."""
    all_ = corpus.part_files(spark, sf).withColumn("mtime", F.lit(0.0))
    key = F.col("p_partkey") % 10
    before = all_.where(key != 0)
    e = written(maintenance.with_ids(trees.entries(extract.units(before))), "before")
    now = all_.where(key != 1).withColumn("text", F.when(key == 2, F.lit("int f(int a) {\n  return a;\n}\n")).otherwise(F.col("text")))
    after, _, what = maintenance.incremental(now, e, maintenance.metadata_of(before, e, 0.0), 1.0)
    counts = after.groupBy("file_path").agg(F.count("*").alias("n"))
    return what.join(counts, "file_path", "left").groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))


@query(f"{EXACT_SQL} SELECT group_hash, arg_min(name, (length(name), name)) AS suggested_name FROM ex JOIN entries_parts ON wl_hash = group_hash WHERE node_count >= 5 GROUP BY 1")
def recommend_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names for what duplicates may become; the part corpus' names have no part in common."""
    e = corpus.part_index(spark, sf).where("node_count >= 5")
    return recommend.suggested_names(e, "wl_hash", dup.exact(e))


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 AND s_suppkey % 3 < 2 THEN 'unknown' WHEN s_nationkey % 4 = 0 THEN 'numeric' END AS plus FROM supplier),
    n AS (SELECT a.s_suppkey, a.plus AS pa, b.plus AS pb FROM s a JOIN s b ON b.s_suppkey = a.s_suppkey + 1) SELECT s_suppkey AS pair_id, CASE WHEN pa <> pb THEN 'different' ELSE 'compatible' END AS verdict FROM n""")
def compare_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's Python function against the next one's, by signals."""
    units = python_files(spark, sf).select(F.regexp_extract("file_path", "([0-9]+)", 1).cast("long").alias("unit_id"), "language", F.col("text").alias("code"))
    pairs = units.select(F.col("unit_id").alias("pair_id"), F.col("unit_id").alias("a"), (F.col("unit_id") + 1).alias("b"))
    pairs = pairs.join(units.select(F.col("unit_id").alias("b")), "b", "left_semi")
    return signals.compare(pairs, signals.signals(units)).select("pair_id", "verdict")


# ---- events


@query("""WITH e AS (SELECT user_id, ts, event_type, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
    SELECT user_id, count(DISTINCT burst) AS flushes FROM s GROUP BY 1""")
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing-edge flushes for each path, with an hour's quiet."""
    e = ev.file_events(table(spark, sf, "events"))
    return ev.bursts(e, 3600).groupBy(F.col("path").alias("user_id")).agg(F.count("*").alias("flushes"))


@query("""SELECT count(*) FILTER (n > 512) AS over, max(n) AS most FROM (SELECT count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events)""")
def storm(spark: SparkSession, sf: str) -> DataFrame:
    """Events at which over 512 lie within the last day, and the most that do."""
    return ev.storm_peaks(ev.file_events(table(spark, sf, "events")), 86_400, 512)


@query()
def storm_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """How many events of each type a quarantine suppresses: more than two in a day are a storm, for two days."""
    e = ev.file_events(table(spark, sf, "events")).withColumn("root", F.col("event_type"))
    return storms.quarantines(e, 2, 86_400.0, 172_800.0).select("root", "suppressed")
