import corpus_pipeline as cp
from tessera.llm import jaccard


def test_every_step_of_near_dedup_decides(spark, monkeypatch):
    # likely pairs of another method are compared all the same, so they cannot change what goes: the stage takes none
    asked = []
    real = jaccard.similar_components
    monkeypatch.setattr(cp.jaccard, "similar_components", lambda *a, **k: asked.append(k) or real(*a, **k))
    docs = spark.createDataFrame([(i, f"a b c d e f g {i // 2}", "en", "s", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in cp.near_dedup_stage(spark, docs, "").collect())
    assert kept == [0, 2, 4] and asked and all(k.get("extra") is None for k in asked) and not hasattr(cp, "simhash")
