import os
import re
import tracemalloc
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa

from tessera.llm import phrases
from tessera.llm.common import dropped, written


def brute(rows, least=30, share=80, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    cover[p[i : i + m]] = max(cover[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * cover[p] < share * a:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, 1, "x", 0) for t, lang in rows], "text string, lang string, f int, phrase string, id int").repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_given_table_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.text, r.lang) for r in docs.collect()], 8)
    assert want and got(phrases.collocations(docs, 8)) == want
    assert got(phrases.collocations(docs.where("false"))) == []


def test_edges(spark):
    rng = np.random.default_rng(4)
    words = ["a", "B", "b", "É", "é", "x\x1cy", "c\x85d", "long" * 40, "　", "n b"]
    rows = [("".join(str(w) + str(s) for w, s in zip(rng.choice(words, n), rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ? ", "\r\n", "\x0b"], n, p=[0.5, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]))), lang) for n in (1, 3, 30, 300, 900) for lang in ("en", "und", None)]
    rows += [(None, "en"), ("", "xx"), (" \t\n", None), ("a a a a a a a a a a a", "en"), ("...", "zz")] + [("the same line of words, again", "en")] * 40
    assert got(phrases.collocations(frame(spark, rows), 3, chunk=50, most=64)) == brute(rows, 3)
    assert got(phrases.collocations(frame(spark, rows), 2, 60, 7, chunk=500)) == brute(rows, 2, 60, 7)


def test_a_full_bitmap_changes_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(" ".join(rng.choice(list("abcdefgh"), 60)), "en") for _ in range(30)]
    assert got(phrases.collocations(frame(spark, rows), 4, bits=64)) == brute(rows, 4)


def test_scores_beyond_a_long(spark):
    big = 2**62
    known = spark.createDataFrame([(1, "en", "a b", big, [big, big], [big, big], 1, 1, None, None, None, 2)], "id long, lang string, phrase string, f long, pre array<long>, suf array<long>, l long, r long, ll long, lr long, rr long, k int")
    totals = spark.createDataFrame([("en", big)], "lang string, n long")
    assert got(phrases.ranked(known, totals, 80, 10)) == [("en", 1, "a b", big, big, big, big, 1_000_000)]


def test_tables_go(spark):
    df = written(spark.range(3), "gone")
    path = urlparse(df.inputFiles()[0].rsplit("/", 1)[0]).path
    dropped(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    dropped(df)
    assert not os.path.exists(path) and os.path.exists("/root/testdata/sf0.001/region.parquet")


def test_a_chunk_at_a_time_and_little_memory_beside_it(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 40, 1, 2).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches if b.num_rows), "n long")
    with phrases.one_row_batches(spark):
        sizes = written(rows, "batches")
    assert spark.conf.get(name) == before and [r.n for r in sizes.collect()] == [1] * 40
    words = 300_000
    stream = (np.random.default_rng(2).zipf(1.15, words) % 30_000).astype(np.int32).tobytes()
    tracemalloc.start()
    phrases.Pairs(stream, np.arange(1, 30_001))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55 * words


def test_distinct_keys():
    for keys in (np.zeros(0, np.int64), np.array([5, 3, 5, 2**40, 3, 5])):
        got, want = phrases.distinct(keys), np.unique(keys, return_inverse=True, return_counts=True)
        assert all(x.tolist() == y.tolist() for x, y in zip(got, want))
        assert [x.tolist() for x in phrases.counted_keys(keys.copy())] == [want[0].tolist(), want[2].tolist()]
