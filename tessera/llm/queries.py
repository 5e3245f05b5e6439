"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import centroids, html, jaccard, mixing, phrases, pieces, quality, simhash, substring, tokenids, topk, toxicity, warc
from tessera.llm.common import table


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_html_blocks_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), width=4, radius=4)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op9_substring_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the passages it shares with earlier documents, and with those it repeats of its own text;
    documents without any have empty lists."""
    docs = table(spark, sf_dir, "documents")
    found = substring.repeated_passages(docs)
    lists = ("passages", "own_passages")
    count = [F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}") for c in lists]
    words = F.coalesce(F.expr("aggregate(passages, 0L, (n, p) -> n + p.end - p.start)"), F.lit(0)).alias("repeated_words")
    refs = F.array_sort(F.array_distinct(F.transform(F.filter("links", lambda x: x["ref"] != F.col("doc_id")), lambda x: x["ref"]))).alias("ref_doc_ids")
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("doc"), "left").select("doc_id", *count, words, *(F.coalesce(c, F.expr("array()")).alias(c) for c in lists), refs, "links")


def op5_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs, keep=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", F.col("cell_topic").alias("topic"), F.col("cell_tokens").alias("n_tokens"), F.round("cell_weight", 6).alias("weight"), F.round("cell_p", 6).alias("probability"), "sampled")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_topk_branch_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op11_centroid_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), min_count=30, share=80, top=2000)


def op13_shingle_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), width=5, percent=80)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the pipeline stands at the repository's top, above this subpackage
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"pipeline": pipeline, "op5_unigram_pieces": op5_unigram_pieces, "op7_raked_mixture": op7_raked_mixture, "op3_html_blocks_lstm": op3_html_blocks_lstm, "op2_toxicity_nnpu": op2_toxicity_nnpu, "op4_risk_controlled_rules": op4_risk_controlled_rules, "op10_topk_branch_bound": op10_topk_branch_bound, "op1_warc_index": op1_warc_index, "op8_token_ids": op8_token_ids, "op6_simhash_vptree": op6_simhash_vptree, "op9_substring_chaining": op9_substring_chaining, "op11_centroid_screening": op11_centroid_screening, "op12_phrase_collocations": op12_phrase_collocations, "op13_shingle_jaccard_join": op13_shingle_jaccard_join}

#: Sweeps that the SQL spells out: by then the raked cells have settled to far more digits than are compared.
SQL_SWEEPS = 25


def raking_sql() -> str:
    """The raked cells as one chain of common table expressions, a step for each margin of each sweep."""
    steps, last = [], "w0"
    for i in range(SQL_SWEEPS):
        for m in mixing.MARGINS:
            name = f"w{i}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, n, w * t / sum(w) OVER (PARTITION BY {m}) AS w FROM {last} JOIN t_{m} USING ({m}))")
            last = name
    targets = [f"t_{m} AS MATERIALIZED (SELECT {m}, t / sum(t) OVER () * (SELECT sum(n) FROM cells) AS t FROM (SELECT {m}, pow(sum(n), {mixing.POWERS[m]}) AS t FROM cells GROUP BY {m}))" for m in mixing.MARGINS]
    # cells are whole from the largest ratio down, as long as the rest's calibration says so
    caps = f"""
        r AS (SELECT *, w / n AS r, sum(n) OVER (ORDER BY w / n DESC, source, lang, topic) AS whole, sum(w) OVER (ORDER BY w / n, source DESC, lang DESC, topic DESC) AS rest FROM {last}),
        c AS (SELECT *, ({mixing.SHARE} * (SELECT sum(n) FROM cells) - whole + n) / rest AS f FROM r),
        p AS (SELECT source, lang, topic, n, w, r, least(1.0, r * (SELECT coalesce(max(f) FILTER (r * f < 1), 1e300) FROM c)) AS p FROM c)"""
    return f"""
        WITH d AS (SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l, coalesce(text, '') AS text,
                          CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
        e AS (SELECT *, CASE WHEN length(regexp_replace(text, '[^|]', '', 'g')) * 10 >= n_tokens THEN 'tabular'
                             WHEN length(regexp_replace(text, '[^#*$%&<>]', '', 'g')) * 4 >= n_tokens THEN 'symbolic'
                             WHEN n_tokens >= 1000 THEN 'long' WHEN n_tokens >= 200 THEN 'medium' ELSE 'short' END AS topic FROM d),
        cells AS MATERIALIZED (SELECT s AS source, l AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM e GROUP BY ALL HAVING sum(n_tokens) > 0),
        {", ".join(targets)},
        w0 AS (SELECT *, n AS w FROM cells), {", ".join(steps)}, {caps}
        SELECT doc_id, e.source, e.lang, e.topic, n_tokens, round(coalesce(r, 0), 6) AS weight, round(coalesce(p, 0), 6) AS probability,
               CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) < coalesce(p, 0) AS sampled
        FROM e LEFT JOIN p ON e.s = p.source AND e.l = p.lang AND e.topic = p.topic"""


def clustering_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """Every round as two common table expressions: who is nearest, and where the centroids go."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
                SELECT r, c, list_sum(list_transform(list_zip(x.v, k{i}.v), lambda z: CAST(z[1] - z[2] AS HUGEINT) * (z[1] - z[2]))) AS d FROM x, k{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT best.c AS c, unnest(v) AS x, unnest(range({dims})) AS pos FROM a{i} JOIN x USING (r)),
            m{i} AS (SELECT c, pos, CAST(sum(x) AS HUGEINT) AS t, CAST(count(*) AS HUGEINT) AS n FROM s{i} GROUP BY ALL),
            k{i + 1} AS MATERIALIZED (SELECT k{i}.c, coalesce(w.v, k{i}.v) AS v FROM k{i} LEFT JOIN (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM m{i} GROUP BY c) w ON w.c = k{i}.c)""")
    return f"""
        WITH x AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
        k0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT {k})),
        {", ".join(steps)}
        SELECT vec_id, best.c AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN x USING (r) JOIN k{rounds} ON k{rounds}.c = best.c"""


ORACLES: dict[str, str] = {
    "op11_centroid_screening": clustering_sql(),
    "op7_raked_mixture": raking_sql(),
    "op13_shingle_jaccard_join": """
        WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE doc_id IS NOT NULL),
        w AS (SELECT r, doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
        s AS MATERIALIZED (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        met AS (SELECT a.r AS x, b.r AS y, a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
        links AS MATERIALIZED (SELECT DISTINCT i, j FROM met JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c) AND i <> j),
        sides AS MATERIALIZED (SELECT i, j FROM links UNION SELECT j, i FROM links),
        reach AS (SELECT i, j FROM sides UNION SELECT reach.i, sides.j FROM reach JOIN sides ON reach.j = sides.i),
        c AS (SELECT i, min(j) AS low FROM reach GROUP BY i)
        SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(low, t.doc_id)) AS component_id FROM t LEFT JOIN n USING (r) LEFT JOIN c ON c.i = t.doc_id""",
    "op12_phrase_collocations": """
        WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
              FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
                SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS i FROM c),
        s AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, x.a AS l, y.a AS r, i, CAST(CAST(cuts.a AS HUGEINT) * 2000000 // (x.a + y.a) AS BIGINT) AS score FROM cuts
              JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[:i], ' ') AND x.k = i
              JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[i + 1:], ' ') AND y.k = cuts.k - i),
        best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, i) = 1),
        inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS cover FROM (
            SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best LEFT JOIN inside USING (lang, phrase) JOIN n USING (lang) WHERE cover IS NULL OR 100 * cover < 80 * a QUALIFY rank <= 2000""",
    "op1_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
        k AS (SELECT html, max(page_id) AS kept FROM p WHERE strlen(html) >= 1000 GROUP BY html)
        SELECT p.page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN k.kept <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               nullif(k.kept, p.page_id) AS refers_to
        FROM p LEFT JOIN k ON p.html = k.html""",
    "op4_risk_controlled_rules": """
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
        s AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
        tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
        rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
        cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS d(o) GROUP BY r),
        m AS (SELECT s.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
              FROM s LEFT JOIN cov ON s.r = cov.r),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                     coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbols, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_lines,
                     coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeats FROM m),
        l AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
        v AS (SELECT stratum, l.good, unnest(['symbols', 'dup_lines', 'repeats']) AS rule, unnest([symbols, dup_lines, repeats]) AS x FROM b JOIN l USING (doc_id) WHERE NOT base_failed),
        c AS (SELECT stratum, rule, cut, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND x > cut) AS k, count(*) FILTER (good <> 1 AND x > cut) AS bad
              FROM v, (SELECT unnest([10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 350, 400, 500, 600, 700, 800, 900]) AS cut) GROUP BY ALL),
        tail AS (SELECT stratum, rule, cut, sum(exp(lgamma(n + 1) - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END - CASE WHEN n = j THEN 0 ELSE lgamma(n - j + 1) END + j * ln(0.02 / 3) + (n - j) * ln(1 - 0.02 / 3))) AS p
                 FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM c WHERE n > 0) GROUP BY ALL),
        f AS (SELECT c.*, n = 0 OR k >= 0.02 / 3 * n OR p > 0.05 / (SELECT count(DISTINCT (stratum, rule)) FROM c) AS failed FROM c LEFT JOIN tail USING (stratum, rule, cut)),
        g AS (SELECT *, bool_or(failed) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS ended FROM f),
        won AS (SELECT stratum, rule, arg_max(cut, (bad - 5 * k) * 1000 + cut) AS cut FROM g WHERE NOT ended AND bad - 5 * k > 0 GROUP BY stratum, rule),
        x AS (SELECT stratum, max(cut) FILTER (rule = 'symbols') AS a, max(cut) FILTER (rule = 'dup_lines') AS d, max(cut) FILTER (rule = 'repeats') AS e FROM won GROUP BY stratum)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (coalesce(symbols > a, false) OR coalesce(dup_lines > d, false) OR coalesce(repeats > e, false)) AS kept
        FROM b LEFT JOIN x USING (stratum)""",
    "op10_topk_branch_bound": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10""",
}
