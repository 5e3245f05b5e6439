from pyspark.sql import functions as F

from tessera.llm import jaccard


def test_only_asked_entries_are_made(spark):
    """Of sets that lack nothing only the keys that others look for are entries."""
    bands = jaccard.Bands(80)
    words = [" ".join(f"w{j}" for j in range(i, i + 100)) for i in range(0, 4000, 100)]
    sets = spark.createDataFrame([(i, jaccard.shingle_set(t, 5).tobytes()) for i, t in enumerate(words)], "rep long, own binary")
    band = bands.of(96)[-1]
    hot = spark.createDataFrame([(band, i) for i in range(40)], "key long, rep long")
    lack = spark.createDataFrame([(0, band, 1)], "rep long, band int, missing int")
    per = bands.segments(band) + 96
    rows = jaccard.entries(sets, hot, lack, bands).groupBy("rep").agg(F.count("*").alias("n")).collect()
    n = {r.rep: r.n for r in rows}
    assert n[0] == per and sum(n.values()) < 2 * per
