"""Source corpora made from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import trees
from tessera.sources.scratch import written

#: Bodies of the made functions; OP stands for an operator.
BODIES = (
    "  let x = a OP b;\n  log(x);\n  return x;",
    "  for (let i = 0; i < b; i++) {\n    a = a OP i;\n  }\n  return a;",
    "  if (a > 3) {\n    run(a);\n  } else {\n    let y = b OP 2;\n    return y;\n  }\n  return a;",
    '  while (a < b) {\n    if (a OP b) {\n      step("x");\n    }\n    a += 1;\n  }\n  return b;',
    "  try {\n    run(a OP b);\n  } catch (e) {\n    fail(e);\n  }\n  return 0;",
)
OPS = ("+", "-", "*", "/")
PYTHON_BODIES = (
    "    x = a OP b\n    return x",
    "    for i in range(b):\n        a = a OP i\n    return a",
    "    if a > 3:\n        while b:\n            b = 2 OP 1\n    return a",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_expr(key: str, size: str) -> str:
    """An SQL expression, the same in both engines, of the function made for a row."""
    quoted = ["'" + b.replace("'", "''").replace("\n", "~") + "'" for b in BODIES]
    body = "CASE " + " ".join(f"WHEN {key} % 5 = {i} THEN {q}" for i, q in enumerate(quoted)) + " END"
    op = "CASE " + " ".join(f"WHEN {size} % 4 = {i} THEN '{o}'" for i, o in enumerate(OPS)) + " END"
    return f"replace(concat('function f', CAST({key} AS VARCHAR(20)), '(a, b) {{~', replace({body}, 'OP', {op}), '~', repeat('  log(a);~', CAST({size} % 3 AS INT)), '}}'), '~', chr(10))"


PATH = "concat(CASE WHEN p_partkey % 7 = 0 THEN 'tests/' ELSE 'src/' END, replace(lower(p_brand), '#', '_'), '/f', CAST(p_partkey AS VARCHAR(20)), '.c')"


def part_files(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """A file a part; dealt to as many tasks as shuffles have, where their texts are read: the table's few bytes are few
    splits, however many rows they hold."""
    part = table(spark, sf_dir, "part")
    if dealt:
        part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return part.select("p_partkey", F.expr(PATH).alias("file_path"), F.lit("c").alias("language"), F.expr(code_expr("p_partkey", "p_size")).alias("text"))


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of the part corpus, one a part, as entries."""
    f = part_files(spark, sf_dir)
    units = f.select(F.col("p_partkey").alias("unit_id"), "file_path", "language", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.lit("function").alias("unit_type"), F.lit(None).cast("string").alias("block_type"), F.lit(None).cast("string").alias("parent_name"), F.lit(1).alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"), F.col("text").alias("code"))
    return trees.entries(units)


def part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_entries, written once: for queries that read them more than once."""
    return written(part_entries(spark, sf_dir), "part-index")


def supplier_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snippet for every supplier, as entries with probe_id."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("probe_id"), F.lit("c").alias("language"), F.expr(code_expr("s_suppkey", "(s_suppkey + s_nationkey)")).alias("code"))
    return trees.entries(s)


# ---- the same in SQL


def nodes_sql(source: str) -> str:
    """Common table expressions lines_X and nodes_X of a relation X (unit_id, code): the line tree by window sums."""
    x = source
    label = "CASE lower(regexp_extract(plain, '^([A-Za-z_][A-Za-z0-9_]*)', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _keywords().items())
    label += " ELSE CASE WHEN contains(plain, '=') AND NOT contains(plain, '==') THEN 'AssignStmt' WHEN contains(plain, '(') AND contains(plain, ')') THEN 'CallStmt' ELSE 'Stmt' END END"
    op = "CASE " + " ".join(f"WHEN contains(plain, '{o}') THEN '{o}'" for o in _operators()) + " END"
    return f"""
    raw_{x} AS (SELECT unit_id, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS n FROM {x}),
    lines_{x} AS (SELECT unit_id, trim(line) AS line, row_number() OVER (PARTITION BY unit_id ORDER BY n) AS i,
        regexp_replace(regexp_replace(trim(line), '"[^"]*"', 'STR', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', 'NUM', 'g') AS plain FROM raw_{x} WHERE trim(line) <> ''),
    lab_{x} AS (SELECT unit_id, i, line, {label} AS base, {op} AS op, CAST(starts_with(line, '}}') AS INT) AS c, CAST(ends_with(line, '{{') OR ends_with(line, ':') AS INT) AS o FROM lines_{x}),
    sum_{x} AS (SELECT *, CAST(sum(x) OVER (PARTITION BY unit_id ORDER BY i) AS INT) AS p FROM (SELECT *, lag(o, 1, 0) OVER (PARTITION BY unit_id ORDER BY i) - c AS x FROM lab_{x})),
    low_{x} AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY unit_id ORDER BY i)) AS e FROM sum_{x}),
    nodes_{x} AS MATERIALIZED (SELECT unit_id, 0 AS id, -1 AS parent, 0 AS level, 'Module' AS label, 'Module' AS plabel FROM {x} UNION ALL
        SELECT v.unit_id, CAST(v.i AS INT), CAST(CASE WHEN v.e = 0 THEN 0 ELSE (SELECT max(u.i) FROM low_{x} u WHERE u.unit_id = v.unit_id AND u.i < v.i AND u.o = 1 AND u.e = v.e - 1) END AS INT), CAST(v.e AS INT) + 1,
               base || coalesce(':Op(' || op || ')', ''), base || CASE WHEN op IS NULL THEN '' ELSE ':Op' END FROM low_{x} v)"""


def _keywords() -> dict:
    from tessera.operators.labels import KEYWORDS

    return KEYWORDS


def _operators() -> tuple:
    from tessera.operators.labels import OPERATORS

    return OPERATORS


def wl_sql(name: str, nodes: str, label: str, rounds: int, where: str = "true") -> str:
    """Common table expressions ending in {name} (unit_id, h): the refinement by joins."""
    out = [f"{name}0 AS (SELECT unit_id, id, parent, md5({label}) AS h FROM {nodes} WHERE {where})"]
    for r in range(rounds):
        a = f"{name}{r}"
        out.append(
            f"{name}{r + 1} AS (SELECT v.unit_id, v.id, v.parent, md5(v.h || '|' || coalesce(p.h, '') || '|' || coalesce(k.hs, '')) AS h FROM {a} v LEFT JOIN {a} p ON p.unit_id = v.unit_id AND p.id = v.parent"
            f" LEFT JOIN (SELECT unit_id, parent, string_agg(h, ',' ORDER BY h) AS hs FROM {a} GROUP BY ALL) k ON k.unit_id = v.unit_id AND k.parent = v.id)"
        )
    out.append(f"{name} AS (SELECT unit_id, md5(string_agg(h, ',' ORDER BY h)) AS h FROM {name}{rounds} GROUP BY unit_id)")
    return ", ".join(out)


def form_sql(name: str, nodes: str, label: str, deepest: int = 6) -> str:
    """Common table expressions ending in {name}0 (unit_id, id, parent, f): canonical forms, from the deepest level up."""
    out = [f"{name}{deepest + 1} AS (SELECT unit_id, id, parent, '' AS f FROM {nodes} WHERE false)"]
    for d in range(deepest, -1, -1):
        out.append(f"{name}{d} AS (SELECT v.unit_id, v.id, v.parent, sha256(v.{label} || '(' || coalesce(k.fs, '') || ')') AS f FROM (SELECT * FROM {nodes} WHERE level = {d}) v LEFT JOIN (SELECT unit_id, parent, string_agg(f, '' ORDER BY f) AS fs FROM {name}{d + 1} GROUP BY ALL) k ON k.unit_id = v.unit_id AND k.parent = v.id)")
    return ", ".join(out)


def entries_sql(x: str, columns: str) -> str:
    """Common table expressions ending in entries_X (columns of X, and the hashes)."""
    n = f"nodes_{x}"
    parts = [nodes_sql(x), wl_sql(f"wl_{x}_", n, "label", 3), wl_sql(f"pw_{x}_", n, "plabel", 3)]
    parts += [wl_sql(f"h{d}_{x}_", n, "label", 2, f"level < {d}") for d in range(1, 6)]
    parts.append(form_sql(f"f_{x}_", n, "label"))
    parts.append(f"shape_{x} AS (SELECT unit_id, CAST(count(*) AS INT) AS node_count, CAST(max(level) AS INT) AS depth FROM {n} GROUP BY unit_id)")
    parts.append(f"hist_{x} AS (SELECT unit_id, string_agg(label || '=' || c, ',' ORDER BY label) AS t FROM (SELECT unit_id, label, count(*) AS c FROM {n} GROUP BY ALL) GROUP BY unit_id)")
    parts.append(f"deg_{x} AS (SELECT unit_id, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS t FROM (SELECT v.unit_id, count(k.id) AS d FROM {n} v LEFT JOIN {n} k ON k.unit_id = v.unit_id AND k.parent = v.id GROUP BY v.unit_id, v.id) GROUP BY unit_id)")
    hier = ", ".join(f"h{d}.h" for d in range(1, 6))
    joins = " ".join(f"JOIN h{d}_{x}_ h{d} USING (unit_id)" for d in range(1, 6))
    parts.append(
        f"entries_{x} AS MATERIALIZED (SELECT {columns}, s.node_count, s.depth, w.h AS wl_hash, p.h AS pattern_hash, f.f AS canonical_hash, s.node_count || ';' || (s.node_count - 1) || ';' || hist.t || ';' || deg.t AS fingerprint, [{hier}] AS hierarchy"
        f" FROM {x} u JOIN shape_{x} s USING (unit_id) JOIN wl_{x}_ w USING (unit_id) JOIN pw_{x}_ p USING (unit_id) JOIN f_{x}_0 f USING (unit_id) JOIN hist_{x} hist USING (unit_id) JOIN deg_{x} deg USING (unit_id) {joins})"
    )
    return ", ".join(parts)


PARTS_SQL = f"parts AS (SELECT p_partkey AS unit_id, {PATH} AS file_path, 'f' || p_partkey AS name, 'function' AS unit_type, 1 AS line_start, {code_expr('p_partkey', 'p_size')} AS code FROM part)"
PROBES_SQL = f"probes AS (SELECT s_suppkey AS unit_id, {code_expr('s_suppkey', '(s_suppkey + s_nationkey)')} AS code FROM supplier)"
PART_ENTRIES_SQL = f"{PARTS_SQL}, {entries_sql('parts', 'u.unit_id, u.file_path, u.name, u.line_start, len(string_split(u.code, chr(10))) AS line_end')}"
PROBE_ENTRIES_SQL = f"{PROBES_SQL}, {entries_sql('probes', 'u.unit_id AS probe_id')}"
