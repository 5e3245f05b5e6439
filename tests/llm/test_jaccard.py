import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import jaccard


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, percent=80, width=5):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].add(k)
    for k, (i, s) in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < k}:
            both = len(s & sets[j][1])
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = sorted((root(i), root(sets[j][0])))
                up[b] = a
    return sorted((i, len(s), root(i)) for i, s in sets)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], "doc_id long, text string, n long, rep string, group int").repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()))


def prose(rng, n, vocabulary=4000):
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


def changed(rng, words, k):
    out = list(words)
    for at in rng.choice(len(out), min(k, len(out)), replace=False):
        out[at] = f"c{rng.integers(10**6)}"
    return out


def test_given_table_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(jaccard.similar_components(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(jaccard.similar_components(docs.where("false"))) == []


def test_edges(spark):
    rng = np.random.default_rng(0)
    long = prose(rng, 30_000, 10**6)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "one two three four five"), (8, "One two three four five"), (None, "one"), (9, "é É"), (10, "é é"), (11, " ".join(long)), (12, " ".join(changed(rng, long, 500))), (13, " ".join(long[:25_000]))]
    rows += [(20, "a b c d e f g"), (20, "k l m n o p q"), (21, "K l m n o p q"), (22, "a b c d e f g"), (22, "a b c d e f g"), (19, None), (19, "a b c d e f g")]
    assert got(jaccard.similar_components(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("hot", [2, 5, 256])
def test_pairs_near_the_limit_and_templates(spark, hot):
    """Copies with so many changes that similarities lie around 0.8, chains of copies, and texts that share a template
    without being similar, so that lists grow long and weights are allocated anew."""
    rng = np.random.default_rng(hot)
    rows = []
    for size in (8, 12, 20, 35, 60, 90, 150, 400, 700):
        for _ in range(6):
            base = prose(rng, size)
            rows.append(base)
            for _ in range(4):
                base = changed(rng, base, int(rng.integers(0, max(2, size // 35) + 1)))
                rows.append(base[: len(base) - int(rng.integers(0, 2))])
        template = prose(rng, size)
        for _ in range(25):
            rows.append(template[: int(size * 0.6)] + prose(rng, size - int(size * 0.6)))
            rows.append(prose(rng, size // 10) + template[: int(size * 0.9)])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    assert got(jaccard.similar_components(frame(spark, rows), hot=hot, bits=64 if hot == 5 else jaccard.BITS)) == brute(rows)


def test_extra_pairs_are_only_tried(spark):
    rows = [(1, "a b c d e f g h"), (2, "k l m n o p q r"), (3, "a b c d e f g h i")]
    extra = spark.createDataFrame([(1, 2), (1, 3), (1, 99)], "a long, b long")
    assert got(jaccard.similar_components(frame(spark, rows), extra=extra)) == brute(rows)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_weights_find_every_pair(percent):
    """The pigeonhole itself: similar sets of any sizes share a key, with as many segments dropped as weights allow."""
    rng = np.random.default_rng(percent)
    bands = jaccard.Bands(percent)
    for _ in range(400):
        s = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, s).astype(np.uint64))
        small = int(rng.integers(-(-percent * len(a) // 100), len(a) + 1))
        most = bands.differences(len(a), small)
        added = (most - (len(a) - small)) // 2
        if small < 1 or added < 0 or small - added < 0:
            continue
        b = np.unique(np.concatenate([rng.choice(a, small - added, replace=False), rng.integers(0, 2**63, added).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) != small or 100 * both < percent * (len(a) + len(b) - both):
            continue
        band = bands.of(len(b))[-1] if bands.of(len(b)) else 0
        if band == 0:
            assert np.array_equal(a, b)
            continue
        assert band in bands.of(len(a))
        m = bands.segments(band)
        (wa, ga, la), (wb, gb, lb) = (jaccard.segment_keys(x, np.array([len(x)]), np.array([band]), np.array([m])) for x in (a, b))
        if bands.short(band):
            assert 2 * m >= bands.need(band, len(a)) and set(np.concatenate([wa, la])) & set(np.concatenate([wb, lb]))
            continue
        same = wa == wb
        near = same | np.array([bool(set(la[ga == i]) & {wb[i]} or set(lb[gb == i]) & {wa[i]}) for i in range(m)])
        assert same.sum() >= m - bands.need(band, len(a)) + 1
        # equal segments weigh nothing, others two, as far as needed
        missing = bands.need(band, len(a)) - int((~same).sum())
        assert missing <= 0 or near[rng.permutation(np.nonzero(~same)[0])[:missing]].any() or missing > (~same).sum()


def test_maps_never_overstate():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 600, int(rng.integers(1, 500))).astype(np.uint64)) for _ in range(2))
        maps = jaccard.maps_of(jaccard.parities(np.concatenate([a, b]), np.array([len(a), len(b)])))
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(np.setxor1d(a, b))


def test_sets_do_not_depend_on_the_texts_beside_them(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(prose(rng, int(n), 30)) for n in rng.integers(0, 40, 60)] + [None, "", "  ", "a", "A b\tc\x0bd", "é\x85x  y"]
    own, size = jaccard.shingle_sets(texts, 5)
    monkeypatch.setattr(jaccard, "TEXTS", 20)
    ends = np.cumsum(size)
    for t, e, n in zip(texts, ends, size):
        assert n == len(shingles(t)) and np.array_equal(own[e - n : e], jaccard.shingle_set(t, 5))


def test_weights_are_missing_and_allocated(spark, monkeypatch):
    """The templates above do lead to allocation, and what it compares finds pairs that nothing else would."""
    seen = []
    whole = jaccard.allocated
    monkeypatch.setattr(jaccard, "allocated", lambda *a: seen.append(whole(*a)) or seen[-1])
    rng = np.random.default_rng(1)
    template = prose(rng, 300)
    rows = [(i, " ".join(template[:150] + prose(rng, 150))) for i in range(30)]
    rows += [(100 + i, " ".join(changed(rng, rows[i][1].split(), 8))) for i in range(10)]
    assert got(jaccard.similar_components(frame(spark, rows), hot=3)) == brute(rows)
    neighbours, lists = seen[0]
    assert neighbours.where(f"kind = {jaccard.PROBER}").count() and lists.count() >= 0
