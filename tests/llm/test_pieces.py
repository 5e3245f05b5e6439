import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def message(parts):
    return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v) for k, v in parts)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_model(PATH))


@pytest.fixture(scope="module")
def library(codec):
    """The same pieces and scores as a unigram model of the library."""
    out, n = [], 0
    for k, v in pieces.fields(open(PATH, "rb").read()):
        if k == 1:
            f = list(pieces.fields(v))
            kind = dict(f).get(3, 1)
            v = message([(a, b) for a, b in f if a == 1]) + b"\x15" + np.float32(codec.vocabulary.scores[n]).tobytes() + message([(3, kind)])
            n += 1
        elif k == 2:
            v = b"".join(varint(a << 3 | (2 if isinstance(b, bytes) and len(b) != 4 else 5 if isinstance(b, bytes) else 0)) + (varint(len(b)) + b if isinstance(b, bytes) and len(b) != 4 else b if isinstance(b, bytes) else varint(b)) for a, b in pieces.fields(v) if a != 3) + message([(3, 1)])
        out.append((k, v))
    m = sentencepiece.SentencePieceProcessor()
    m.LoadFromSerializedProto(message(out))
    return m


def test_double_array_holds_its_keys():
    rng = random.Random(1)
    keys = {bytes(rng.choices(range(256), k=rng.randint(1, 5))) for _ in range(3000)} | {b"\xff", b"\x00", b"\xff\xff"}
    trie = pieces.Trie([(k, i) for i, k in enumerate(sorted(keys))])
    index = {k: i for i, k in enumerate(sorted(keys))}
    for _ in range(300):
        t = bytes(rng.choices(range(256), k=6)) if rng.random() < 0.5 else rng.choice(list(index)) + b"\x01"
        data = np.frombuffer(t, np.uint8)
        s, n, v = trie.matches(data, np.arange(len(t)), np.full(len(t), len(t)))
        want = {(i, j - i, index[t[i:j]]) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if t[i:j] in index}
        assert set(zip(s.tolist(), n.tolist(), v.tolist())) == want


WORDS = ["the", "Hello", "tokenization", "é", "日本語", "🙂", "x\x00y", "  ", "   ", "\t", "pneumonoultramicroscopicsilicovolcanoconiosis", "çà", "\n", "\n\n", "1234", "—", "ß", "don't", "​", "Ω"]


def test_equals_the_library(codec, library):
    rng = random.Random(5)
    for n in range(400):
        t = "".join(rng.choice(WORDS + [" ", " "]) for _ in range(rng.randint(0, 14)))
        assert codec.encode(t).tolist() == library.encode(t), repr(t)
        assert codec.decode(codec.encode(t)) == t
    assert codec.encode(None).tolist() == [] and codec.decode(np.zeros(0, np.uint32)) == ""


def test_permuted_ties_score_the_same(codec, library):
    """Runs of one letter have many best segmentations, which the library tells apart by rounding; the score is one."""
    for t in ("a" * 90, "x " + "ha" * 50, "=" * 70):
        a, b = codec.encode(t), library.encode(t)
        assert sum(codec.vocabulary.scores[a]) == pytest.approx(sum(codec.vocabulary.scores[b]), rel=1e-5) and codec.decode(a) == t


def test_equals_brute_force_and_the_library_on_documents(codec, library, spark):
    same = lines = 0
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect():
        for line in r.text.split("\n")[:5]:
            a, b = codec.encode(line[:400]), library.encode(line[:400])
            same, lines = same + (a.tolist() == b), lines + 1
            assert float(codec.vocabulary.scores[a].sum(dtype=np.float64)) == pytest.approx(float(codec.vocabulary.scores[b].sum(dtype=np.float64)), rel=1e-6)
    assert same >= 0.9 * lines
    ids = {p: i for i, p in enumerate(codec.vocabulary.pieces) if codec.vocabulary.kinds[i] == 1}
    for w in ("▁unbelievable", "▁erthinst", "xqzj"):
        best = {0: 0.0}
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if w[i:j] in ids:
                    best[j] = max(best.get(j, -1e9), best[i] + float(codec.vocabulary.scores[ids[w[i:j]]]))
        assert sum(float(codec.vocabulary.scores[i]) for i in codec.segment([w])[0]) == pytest.approx(best[len(w)], rel=1e-5)


def test_bytes_that_are_no_text(codec):
    odd = codec.byte_ids[0xC3]
    assert codec.decode(np.array([odd], np.uint32)) == "�"


def test_query_and_odd_rows(spark, codec, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("ids", F.lit(1))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " "), (-4, "w▁x"), (None, "long " * 30_000 + "y" * 5000)], "doc_id long, text string")
    rows = docs.unionByName(odd, allowMissingColumns=True)
    got = {r.doc_id: r for r in pieces.tokenized(rows, PATH).collect()}
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert got.keys() == texts.keys() and all(r.round_trip for r in got.values())
    monkeypatch.setattr(pieces, "CACHE", 50)
    fresh = pieces.Codec(codec.vocabulary)
    for i, t in list(texts.items())[:30] + [(-4, texts[-4])]:
        assert got[i].ids == fresh.encode(t).tolist() and got[i].n_tokens == len(got[i].ids)
    assert got[-1].n_tokens == got[-2].n_tokens == 0
    assert pieces.tokenized(docs.where("false"), PATH).count() == 0
