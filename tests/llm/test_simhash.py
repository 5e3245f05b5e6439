import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import Groups, components


def brute_fp(text, width=4):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


TEXTS = ["", None, "   \n", "one", "One two", "a b c d e", "A B C D E", "a\x85b c\xa0d e f", "x " * 5000, "ßÀÉ lower Only ASCII Àgain here"]


def test_fingerprint_equals_brute_force():
    for t in TEXTS:
        assert int.from_bytes(simhash.fingerprint(t, 4), "big") == brute_fp(t)
    assert len(simhash.fingerprint("a b c d e f", 5, 4)) == 32


def test_long_texts_in_blocks(monkeypatch):
    t = " ".join(str(i * 7919 % 1000) for i in range(700))
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert int.from_bytes(simhash.fingerprint(t, 4), "big") == brute_fp(t)


@pytest.mark.parametrize("n,flips", [(400, 3), (900, 6), (300, 1)])
def test_tree_equals_brute_force(n, flips):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fp = []
    for _ in range(n):
        x = int(centres[rng.integers(12)])
        for b in rng.integers(0, 64, rng.integers(flips + 1)):
            x ^= 1 << int(b)
        fp.append(x)
    arr = np.array(fp, np.uint64)[:, None]
    g = Groups(n)
    simhash.link_tree(arr, g, np.arange(n), 4)
    want = brute_components(dict(enumerate(fp)), 4)
    assert g.roots(np.arange(n)).tolist() == [want[i] for i in range(n)]
    side = rng.integers(0, 2, n)
    g = Groups(n)
    simhash.link_tree(arr, g, np.arange(n), 4, side)
    for i in range(0, n, 7):
        for j in range(n):
            if side[i] != side[j] and (fp[i] ^ fp[j]).bit_count() <= 4:
                assert g.roots(np.array([i]))[0] == g.roots(np.array([j]))[0]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (159, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {i: 100 for i in [*range(101, 160), 300]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10_000 + i, t, 1, 2) for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, fp int, view int")
    docs = docs.withColumn("fp", F.lit(1)).unionByName(extra, allowMissingColumns=True)
    want_fp = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    want = brute_components(want_fp, 4)
    got = {r.doc_id: (int.from_bytes(r.fp, "big"), r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (want_fp[i], want[i]) for i in want}


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_one_part_at_least_lies_within_the_ball(radius):
    masks, ball = simhash.parts_of(64, radius)
    assert len(masks) == radius // 2 + 1 and int(sum(int(m[0]) for m in masks)) == 2**64 - 1
    rng = np.random.default_rng(radius)
    for _ in range(300):
        x = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert min((x & int(m[0])).bit_count() for m in masks) <= ball


@pytest.mark.parametrize("n,centres,flips", [(3000, 3000, 0), (2500, 700, 5), (2000, 3, 9)])
def test_trees_equal_brute_force(n, centres, flips):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**64, centres, dtype=np.uint64, endpoint=False)
    fp = base[rng.integers(0, centres, n)] if flips else base
    for _ in range(flips):
        fp = fp ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    fp = np.unique(fp)[:, None]
    masks, ball = simhash.parts_of(64, 4)
    groups, grown = Groups(len(fp)), 0
    for mask in masks:
        top = simhash.Top(fp[::4], mask, ball, 40)
        row, shard = top.shards(fp)
        assert set(row) == set(range(len(fp))) and (centres < 9 or len(set(shard)) > 8)
        order = np.argsort(shard, kind="stable")
        row = row[order]
        local = Groups(len(row))
        grown += simhash.search(fp[row], shard[order], mask, local, 4, ball)
        groups.link(row, row[local.roots(np.arange(len(row)))])
    want = brute_components(dict(enumerate(fp[:, 0].tolist())), 4)
    assert groups.roots(np.arange(len(fp))).tolist() == [want[i] for i in range(len(fp))]
    assert centres < 9 or grown > len(fp) // 4  # trees go down to their leaves


def test_trees_are_grown_over_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = simhash.fingerprints(docs).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    rows = simhash.shard_rows(fps, 64, 4, shard_size=50)
    sizes = [r["count"] for r in rows.groupBy("part", "shard").count().collect()]
    assert len(sizes) > 40 and max(sizes) < fps.count() / 4
    assert rows.select("part").distinct().count() == 3


def test_hot_shard_in_tiles(spark):
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    fps = {}
    for i in range(2600):
        x = base
        for b in rng.integers(20, 64, 4):
            x ^= 1 << int(b)
        fps[i] = x
    df = spark.createDataFrame([(i, bytearray(x.to_bytes(8, "big"))) for i, x in fps.items()], "doc_id long, fp binary")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert got == brute_components(fps, 4)
