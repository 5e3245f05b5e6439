import inspect
from collections import Counter

import numpy as np

from tessera.llm import phrases


def test_quadruples_are_counted_without_naming_triples():
    rng = np.random.default_rng(5)
    stream = rng.integers(0, 6, 3000).astype(np.int32)
    ids = np.array([11, 12, 13, 14, 15], np.int64)
    name = np.concatenate([[0], ids])[stream]
    three = [tuple(name[i : i + 3]) for i in range(len(name) - 2)]
    often = {t for i, t in enumerate(sorted(set(three))) if i % 3}
    want = Counter(tuple(name[i : i + 4].tolist()) for i in range(len(name) - 3) if all(name[i : i + 4]) and three[i] in often and three[i + 1] in often)
    pairs, triples = np.ones(1 << 10, bool), np.zeros(1 << 20, bool)
    triples[phrases.slot([np.array(x) for x in zip(*often)], len(triples))] = True
    four, n = phrases.Pairs(stream.tobytes(), ids).quads(pairs, triples)
    got = dict(zip(zip(*(x.tolist() for x in four)), n.tolist()))
    assert got == dict(want) and len(got) > 100
    none, n = phrases.Pairs(stream[:2].tobytes(), ids).quads(pairs, triples)
    assert len(n) == 0 and all(len(x) == 0 for x in none)


def test_no_join_of_chunks_with_triples():
    source = inspect.getsource(phrases)
    assert "def renamed" not in source
