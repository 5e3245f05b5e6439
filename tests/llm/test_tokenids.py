import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokenids
from tessera.llm.files import Ranges

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.lists(st.integers(0, 70_000), max_size=300))
@settings(max_examples=60, deadline=None)
def test_code_round_trip(a, b):
    for x in (a, b, [5] * len(a), list(range(len(b) * 300))):
        raw = np.array(x, "<u4")
        _, sizes, ids = tokenids.unpack(tokenids.pack([1, -2], [len(x) // 3, len(x) - len(x) // 3], raw))
        assert ids.tolist() == x and sizes.sum() == len(x)


def test_ranks_follow_frequency():
    by_rank, control, data = tokenids.encode(np.array([7, 9, 9, 9, 4, 7, 1000], "<u4"))
    assert by_rank.tolist() == [9, 7, 4, 1000] and len(data) == 7 and len(control) == 2
    with pytest.raises(ValueError):
        tokenids.unpack(tokenids.pack([1], [1], np.array([1], "<u4"))[:-1])


WORDS = ["a", "É", "é", "́x", "<|endoftext|>", "<|startoftext|>a", "don't", "x'S", "123", "ΑΣ", "\xa0", " ", "\x85", "\t", "\x1c", "日本", "🙂🙂", "##", "'re", "\r", "  ", "İ", "¨", "Étre,", "IT'S.", "st.***", "ŉ", "ſtop", "Dž", "ǅx", "<", "word>", "|", "-x", "Å", "ﬁ"]


def test_parts_encode_like_whole_texts():
    rng, enc = random.Random(2), tokenids.Encoder(PATH)
    for _ in range(400):
        t = "".join(rng.choice(WORDS + [" ", "\n", " \n "]) for _ in range(rng.randint(0, 25)))
        assert enc(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_plain_letter():
    enc = tokenids.Encoder(PATH)
    for c in map(chr, (*range(0x41, 0x7B), *range(0xC0, 0x250))):
        for t in (c, f"a{c}b,", f"{c}{c}."):
            assert enc(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_repeated_ids_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i % 977} and" for i in range(300_000))
    rows = [(1, "b c", "x", 1), (1, "a", "y", 2), (1, "a", "y", 2), (0, long, "z", 3), (2, None, "w", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, offset int").repartition(3)
    got = sorted(map(tuple, tokenids.bpe_round_trip(docs, PATH).collect()))
    tok = tokenids.Encoder(PATH).tokenizer
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert sorted((r[0], r[2]) for r in got) == sorted((r[0], count(r[1])) for r in rows)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE", 20)
    enc = tokenids.Encoder(PATH)
    for t in ("a b c d e f g h", " ".join(f"w{i}" for i in range(50)), "a b", ""):
        assert enc(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_whole_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-5, None), (-4, ""), (-3, " \n"), (10**12, "end <|endoftext|>"), (None, "no id")], "doc_id long, text string")
    docs = docs.unionByName(extra).repartition(5)
    tok, start, want = tokenids.Encoder(PATH).tokenizer, 0, []
    for r in sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = f"file://{tmp_path}/ids"
    segments = tokenids.write_ids(docs, folder, lambda: tokenids.Encoder(PATH), 2, segment=5000)
    assert segments.count() > 8
    assert sorted(map(tuple, tokenids.read_ids(segments, folder).collect())) == want
    assert tokenids.bpe_round_trip(docs.where("false"), PATH).count() == 0
