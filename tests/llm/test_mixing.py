import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def rows():
    rng = np.random.default_rng(2)
    out = []
    for i in range(3000):
        source = "hot" if i % 3 else f"s{i % 7}"
        out.append((i, "w " * int(rng.integers(1, 400)), ["en", "fr", None][int(rng.choice(3, p=[0.7, 0.2, 0.1]))], source, 1))
    return out + [(9001, None, "en", "hot", 1), (9002, "", "only", "empty", 1), (None, "a b", "en", None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n long").repartition(4)


def test_margins_hold(docs):
    cells = mixing.cell_weights(mixing.celled(docs)).collect()
    total = sum(r.n for r in cells)
    for m in mixing.MARGINS:
        real, raked = {}, {}
        for r in cells:
            real[r[m]] = real.get(r[m], 0) + r.n
            raked[r[m]] = raked.get(r[m], 0) + r.w
        power = {k: v ** mixing.POWERS[m] for k, v in real.items()}
        for k in real:
            assert raked[k] == pytest.approx(total * power[k] / sum(power.values()), rel=1e-3)
    assert sum(r.n * r.p for r in cells) == pytest.approx(mixing.SHARE * total)
    assert all(0 < r.p <= 1 for r in cells)


def test_table_path_equals_arrays(docs):
    celled = mixing.celled(docs)
    a = {tuple(r)[:3]: (r.w, r.p) for r in mixing.cell_weights(celled).collect()}
    b = {tuple(r[m] for m in mixing.MARGINS): (r.w, r.p) for r in mixing.cell_weights(celled, driver_cells=0).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)


def test_given_targets(spark, docs):
    shares = {"source": [("hot", 0.1), ("s1", 3.0), ("s2", 1.0), ("nowhere", 9.0)], "lang": [("en", 0.5), ("fr", 0.25), (None, 0.25)]}
    targets = {m: spark.createDataFrame(x, "key string, share double") for m, x in shares.items()}
    cells = mixing.cell_weights(mixing.celled(docs), targets=targets)
    rows = cells.collect()
    total = sum(r.n for r in rows)
    by = lambda i, k: sum(r.w for r in rows if r[i] == k)
    assert [by(0, k) / total for k in ("hot", "s1", "s2", "s3")] == pytest.approx([0.1 / 4.1, 3 / 4.1, 1 / 4.1, 0], rel=1e-6)
    assert [by(1, k) / total for k in ("en", "fr", "")] == pytest.approx([0.5, 0.25, 0.25], rel=1e-6)
    assert mixing.margin_errors(cells, targets).where("error > 1e-6").count() == 0
    out = mixing.mixed(docs, targets=targets).collect()
    assert not any(r.sampled for r in out if r.source == "s3")
    with pytest.raises(ValueError):
        mixing.cell_weights(mixing.celled(docs), targets={"lang": targets["lang"].where("false")})


def test_targets_that_can_not_be_met_are_reported(spark):
    rows = spark.createDataFrame([(1, "a a a", "en", "x"), (2, "b " * 50, "fr", "y")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="met at once"):
        cells = mixing.cell_weights(mixing.celled(rows))
    assert mixing.margin_errors(cells).where("error > 0.01").count() > 0


def test_clashing_columns_repeats_and_long_texts(spark):
    rows = [(1, "a " * 400_000, "en", "x", 5, 6, 7), (1, "b c", "en", "x", 5, 6, 7), (1, "b c", "en", "x", 5, 6, 7), (2, "d", "fr", "y", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cell_p int, raked_source int, sampled int")
    with pytest.warns(UserWarning):
        out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "raked_source", *mixing.ADDED]
    got = out.collect()
    assert sorted(r.cell_tokens for r in got) == [1, 2, 2, 400_000] and all(r.raked_source == 6 for r in got)
    assert len({r.sampled for r in got if r.doc_id == 1}) == 1 or len({r.cell_p for r in got if r.doc_id == 1}) > 1


def test_calibration_caps_at_one():
    n, w = np.array([10.0, 100.0, 1000.0]), np.array([500.0, 300.0, 310.0])
    p = mixing.calibrated(n, w, 0.5)
    assert p[0] == 1 and p[1] == 1 and (n * p).sum() == pytest.approx(555)
    assert mixing.calibrated(n, w, 1.0).tolist() == [1, 1, 1]


def test_sample(docs):
    out = mixing.mixed(docs).collect()
    assert len(out) == 3003
    for r in out:
        u = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:12], 16) / 2**48
        assert r.sampled == (u < r.cell_p)
    got, total = sum(r.cell_tokens for r in out if r.sampled), sum(r.cell_tokens for r in out)
    assert abs(got / total - mixing.SHARE) < 0.05
    assert next(r for r in out if r.doc_id == 9002).cell_p == 0


def test_empty(docs):
    assert mixing.mixed(docs.where("false")).count() == 0
