import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


def test_keys():
    assert warc.url_key("HTTP://User@WWW.Example.com:80/a/B?q=1#frag") == "com,example,www)/a/B?q=1"
    assert warc.url_key("https://10.0.0.1:8443") == "10.0.0.1:8443)/"
    assert warc.url_key(None) == "" and warc.url_key("no host\tat all") == "no host%09at all"


def test_record_round_trip():
    payload = "é\r\n\r\nWARC/1.1".encode()
    d = hashlib.sha1(payload).hexdigest()
    c = warc.parse(warc.record(-7, "http://x/ü\n y", payload, d, None))
    assert (c.page_id, c.kind, c.payload_bytes, c.digest, c.refers_to, c.payload) == (-7, "response", len(payload), d, None, payload)
    c = warc.parse(warc.record(3, None, payload, d, 9))
    assert (c.kind, c.payload_bytes, c.digest, c.refers_to, c.payload) == ("revisit", len(payload), d, 9, b"")
    with pytest.raises(ValueError):
        warc.parse(warc.record(3, None, payload, d, None).replace("é".encode(), b"xx"))


def want(rows):
    best = {}
    for r in rows:
        b = (r.html or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, r.page_id), r.page_id)
    out = []
    for r in rows:
        b = (r.html or "").encode()
        k = best.get(b, r.page_id)
        out.append((r.page_id, len(b), hashlib.sha1(b).hexdigest(), "response" if k == r.page_id else "revisit", None if k == r.page_id else k))
    return sorted(out)


@pytest.fixture(scope="module")
def pages(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    big, edge = "é" * 600, "x" * 999
    more = [(10_000 + i, f"http://h{i % 3}.example/{i}", big) for i in range(9)] + [(20_000, "http://e/", edge), (20_001, "http://e/", edge), (20_002, "http://e/", edge + "y"), (20_003, "http://e/", edge + "y"), (30_000, None, None), (30_001, None, ""), (30_002, "", "tab\turl"), (-1, "http://e/\t", "neg")]
    return p.unionByName(spark.createDataFrame(more, "page_id long, url string, html string")).withColumn("kept", F.lit(1)).withColumn("digest", F.lit("x")).repartition(4)


def test_round_trip(spark, pages):
    assert sorted(map(tuple, warc.archive_round_trip(pages).collect())) == want(pages.collect())


def test_lookup_of_keys_over_blocks_and_files(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    captures = warc.write_archives(pages, folder)
    files = warc.write_index(captures, folder, block=4)
    wanted = spark.createDataFrame([("e)/", None), ("nothing", None), ("", None), ("example,h1)/1", 10_001), ("example,h1)/1", 5)], "key string, page_id long")
    got = sorted((r.key, r.page_id) for r in warc.lookup(wanted, files, folder).collect())
    assert got == [("", 30_000), ("", 30_001), ("", 30_002), *[("e)/", i) for i in (-1, 20_000, 20_001, 20_002, 20_003)], ("example,h1)/1", 10_001)]
    one = warc.lookup(wanted.where("page_id = 10001"), files, folder).first()
    raw = open(f"{tmp_path}/w/{one.file}", "rb").read()
    assert warc.parse(gzip.decompress(raw[one.offset : one.offset + one.length])).page_id == 10_001
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_empty_table(spark, pages):
    assert warc.archive_round_trip(pages.where("false")).count() == 0
