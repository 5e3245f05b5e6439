import hashlib
import random
import struct
import sys
import zlib
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import mixing, toxicity

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_toxicity import plain_score  # noqa: E402


def test_cut_passages():
    t = " a b  c\nd e\tf "
    assert cp.cut_passages(t, []) == t
    assert cp.cut_passages(t, [{"start": 2, "end": 4}]) == "a b e\tf "
    assert cp.cut_passages(t, [{"start": 0, "end": 3}]) == "d e\tf "
    assert cp.cut_passages(t, [{"start": 4, "end": 9}, {"start": 1, "end": 2}]) == "a  c\nd "
    assert cp.cut_passages(t, [{"start": 0, "end": 6}]) == "" and cp.cut_passages(None, [{"start": 0, "end": 2}]) == ""
    assert cp.cut_passages("é \x85ü", [{"start": 0, "end": 1}]) == "\x85ü"


def similarity(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_go_and_clean_texts_stay(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    docs = {i: [word() for _ in range(rng.randint(40, 400))] for i in range(120)}
    for i in range(120):
        copy = list(docs[i])
        for _ in range(max(1, len(copy) // 60)):
            copy[rng.randrange(len(copy))] = word()
        docs[200 + i] = copy
        docs[400 + i] = copy[: len(copy) // 2] + [word() for _ in copy]
    texts = {i: " ".join(w) for i, w in docs.items()} | {900: None, 901: "", 902: "a"}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.near_dedup_stage(spark, df.union(df.where("doc_id = 3")), "").collect()}
    assert {i for i in range(120)} <= kept and {400 + i for i in range(120)} <= kept and {900, 902} <= kept and 901 not in kept
    missed = [i for i in range(120) if 200 + i in kept and similarity(texts[i], texts[200 + i]) >= 0.8]
    assert len(missed) <= 2


def test_toxicity_stage_equals_a_plain_scorer(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id", "en", "s", 5), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "same", "en", "s", 4), (9003, "same", "en", "s", 4)], docs.schema)
    rows = docs.unionByName(odd).withColumn("mark", F.lit(1))
    model = toxicity.train(rows.where("doc_id is not null"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = sorted(r.doc_id for r in rows.collect() if r.doc_id is not None and plain_score(r.text, model) < 0.7)
    out = cp.toxicity_stage(spark, rows, sf)
    assert sorted(r.doc_id for r in out.collect()) == want and out.columns == list(cp.COLUMNS) and {9001, 9002, 9003} <= set(want)


def test_passages_stage_cuts_what_brute_force_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, " ", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(odd)
    texts = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    first: dict = {}
    shared = {i: set() for i in texts}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            if first.setdefault(tuple(texts[i][k : k + 50]), i) != i:
                shared[i].update(range(k, k + 50))
    out = {r.doc_id: r for r in cp.passages_stage(spark, docs.withColumn("passages", F.lit(1)).withColumn("doc", F.lit(2)), "").collect()}
    raw = {r.doc_id: r.text for r in docs.collect()}
    for i, own in shared.items():
        left = len((out[i].text or "").split()) if i in out else 0
        assert left <= len(texts[i]) - 0.98 * len(own), i
        assert i not in out or out[i].text == raw[i] or out[i].n_chars == len(out[i].text)
    clean = [i for i, own in shared.items() if not own]
    assert sum(i in out and out[i].text == raw[i] for i in clean) >= 0.95 * len(clean) and out[9001].text is None and out[9002].text == " "


def test_mixing_stage_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, "a b", None, "src0", 3), (9003, "a b", None, "src0", 3)], docs.schema)
    rows = docs.unionByName(odd)
    want = {(r.doc_id, r.cell_p) for r in mixing.mixed(rows).collect()}
    cells: dict = {}
    for r in rows.collect():
        words = (r.text or "").split()
        key = (r.source or "", r.lang or "", topic(r.text or "", len(words)))
        cells.setdefault(key, []).append((r.doc_id, len(words)))
    n = {k: float(sum(w for _, w in v)) for k, v in cells.items() if sum(w for _, w in v)}
    total, w = sum(n.values()), dict(n)
    powers = [mixing.POWERS[m] for m in mixing.MARGINS]
    for _ in range(200):
        for i, p in enumerate(powers):
            real, now = {}, {}
            for k in n:
                real[k[i]] = real.get(k[i], 0) + n[k]
                now[k[i]] = now.get(k[i], 0) + w[k]
            all_ = sum(v**p for v in real.values())
            w = {k: x * real[k[i]] ** p / all_ * total / now[k[i]] for k, x in w.items()}
    lo, hi = 0.0, 1e6  # the calibration's factor, by bisection
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n[k] * min(1.0, mid * w[k] / n[k]) for k in n) < mixing.SHARE * total else (lo, mid)
    p_of = {i: min(1.0, lo * w[k] / n[k]) if k in n else 0.0 for k, v in cells.items() for i, _ in v}
    assert {i for i, _ in want} == set(p_of) and all(abs(p - p_of[i]) < 1e-5 or i == 9003 for i, p in want)
    u = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) / 2**48
    kept = sorted(r.doc_id for r in cp.mixing_stage(spark, rows, "").collect())
    assert kept == sorted(r.doc_id for r in rows.collect() if u(r.doc_id) < p_of[r.doc_id])


def topic(text, n):
    if text.count("|") * 10 >= n:
        return "tabular"
    return "symbolic" if sum(text.count(c) for c in "#*$%&<>") * 4 >= n else "long" if n >= 1000 else "medium" if n >= 200 else "short"


def test_encoding_stage_gives_the_texts_back(spark):
    docs = spark.createDataFrame([(1, "a  b\nc ü 日本 🙂", "en", "s", 1), (2, None, "en", "s", 1), (2, "", "en", "s", 1), (3, "word " * 60_000, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("ids", F.lit(1))
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = cp.encoding_stage(spark, docs, "").collect()
    assert len(rows) == 4 and all(r.round_trip and len(r.ids) == r.n_tokens and zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) == r.ids_crc32 for r in rows)
    assert sorted(r.n_tokens for r in rows if r.doc_id == 2) == [0, 0]
    assert sp.decode(next(r for r in rows if r.doc_id == 1).ids).strip() == "a  b\nc ü 日本 🙂"


def test_whole_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    rows = docs
    for name, stage in cp.STAGES:
        out = stage(spark, rows, sf)
        if name != "encoding":
            assert out.dtypes == docs.dtypes
        path = cp.new_path(spark, name)
        out.write.parquet(path)
        rows = spark.read.parquet(path)
        sizes.append(rows.count())
        assert rows.select("doc_id").distinct().count() == sizes[-1]
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] == sizes[5] > 0.4 * sizes[0]
    assert rows.where("not round_trip").count() == 0


def test_empty_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        rows = stage(spark, rows, sf)
        assert rows.count() == 0


def shingled(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(texts, least):
    ids, root, sets = sorted(texts), {i: i for i in texts}, {i: shingled(t) for i, t in texts.items()}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in ids:
        for j in ids:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def made():
    """Families of texts whose neighbours have similarities about 0.8, on both sides, and a chain of templates under it."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    texts = {}
    for f in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        texts[f * 10] = " ".join(base)
        for m, tail in enumerate((0.08, 0.1, 0.12, 0.15, 0.2, 0.3)):
            cut = int(len(base) * (1 - tail))
            texts[f * 10 + 1 + m] = " ".join(base[:cut] + [word() for _ in base[cut:]])
    line = [word() for _ in range(150)]
    for c in range(12):
        texts[9000 + c] = " ".join(line)
        line = line[25:] + [word() for _ in range(25)]
    texts[9100] = " ".join(["again and again we say it"] * 30 + ["end"])
    texts[9101] = "again and again we say it again and again we say it end"
    return texts


def test_stage_equals_exact_similarity(spark):
    texts = made()
    want = brute(texts, 0.8)
    assert any(0.8 <= similarity(texts[f * 10], texts[f * 10 + m]) < 0.83 for f in range(40) for m in range(1, 7))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.near_dedup_stage(spark, df, "").collect()}
    assert kept == {i for i in want if want[i] == i}
    assert {9000 + c for c in range(12)} <= kept
