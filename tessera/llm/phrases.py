"""Phrase collocations by hierarchical pair naming.

Frequent words get ids; then, level by level, a frequent phrase of k words is the pair of the ids of its first and of its
last k - 1 words, and gets an id of its own. The pair is the phrase's parents: its first and last words, its cuts and the
phrases that lie in it are all found by following them, and no text is compared after the first level.

1. Each task turns its texts into chunks, a language each: a stream of word numbers with 0 between pieces, and the different
   words with their counts.
2. Counts of a level's pairs are added up over chunks (in a chunk each pair stands once, so a hot word or pair is one row a
   chunk), and those of at least min_count get ids by being written.
3. Chunks count the triples and quadruples of neighbouring words; only those frequent in all chunks together are named, by
   joining the ids of their two parents. So that not every rare one of every chunk is sent, bitmaps of the frequent pairs and
   triples go to the tasks: their size is fixed (BITS), a full one only sends more.
4. A phrase's row joins its parents' rows: text, counts of all its beginnings and ends (the cuts), and the ids of phrases
   within it (subsumption).

Rows with a null text or no words add nothing; a null lang is ``und``, as is that very string. Repeated rows, and rows that
share an id, count each for itself; ids are not read. Very long texts are read piece by piece into one chunk. Only the two
columns are read, so extra columns may have any name. Equal scores and counts go by phrase in the order of UTF-8 bytes.
"""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, partitions, trim, written
from tessera.llm.textops import mix

#: Words after which a task ends a chunk (at the end of a text).
CHUNK = 700_000
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 22
#: Bits of the map of frequent pairs.
BITS = 1 << 24
#: A first ranking deals each language to so many tasks, of which each passes on as many rows as are wanted in the end.
SALTS = 16
#: Keys whose slots are looked up at a time.
SOME = 1 << 16
BREAKS = b".,;:!?\n\x0b\x0c\r"
TO_POINT = bytes.maketrans(BREAKS, b"." * len(BREAKS))


class Chunk:
    """The words of texts of one language: a stream of numbers, and the words in the order of their numbers from 1."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(lambda: len(self.number))
        self.number[b"."] = 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, raw: bytes, most: int) -> None:
        at = 0
        while at < len(raw):
            end = min(len(raw), at + most)
            if end < len(raw):  # a slice ends before a word
                cuts = [c for c in (raw.rfind(b" ", at, end), raw.rfind(b".", at, end), raw.rfind(b"\t", at, end)) if c > at]
                end = max(cuts) if cuts else min([c for c in (raw.find(b" ", end), raw.find(b".", end), raw.find(b"\t", end)) if c >= 0], default=len(raw))
            words = raw[at:end].replace(b".", b" . ").split()
            self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
            at = end
        self.parts.append(np.zeros(1, np.int32))

    def row(self) -> tuple[bytes, list[bytes], list[int], int]:
        stream = np.concatenate(self.parts)
        count = np.bincount(stream, minlength=len(self.number))[1:]
        return stream.tobytes(), [w for w in self.number if w != b"."], count.tolist(), int(count.sum())


def chunked(docs: DataFrame, words: int = CHUNK, most: int = SLICE) -> DataFrame:
    """(chunk, lang, stream, words, counts, n_words): a row for about so many words of a task and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: dict[str, Chunk] = {}

        def end(langs: list[str]) -> pa.RecordBatch:
            rows = [(uuid.uuid4().hex, lang, *held.pop(lang).row()) for lang in langs]
            kinds = [pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()]
            columns = [list(c) for c in zip(*rows)]
            columns[3] = [[w.decode("utf-8", "surrogatepass") for w in words] for words in columns[3]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "lang", "stream", "words", "counts", "n_words"])

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().translate(TO_POINT)
                held.setdefault(lang, Chunk()).add(raw, most)
                if held[lang].size >= words:
                    yield end([lang])
            if sum(c.size for c in held.values()) >= 2 * words:  # many languages
                yield end(list(held))
        for lang in list(held):
            yield end([lang])
        trim()

    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInArrow(run, "chunk string, lang string, stream binary, words array<string>, counts array<long>, n_words long").where("n_words > 0")


def numbered(counts: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """(id, keys..., f) of the keys that are counted often enough. The ids are those of a written table: a task that runs
    again can't give others."""
    often = counts.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return written(often.withColumn("id", F.monotonically_increasing_id() + 1), name)


def slot(parts: list[np.ndarray], bits: int) -> np.ndarray:
    z = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            z = mix(z * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64))
    return (z % np.uint64(bits)).astype(np.int64)


def bitmap(names: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """A bit for the slots of the names, gathered as at most bits / 64 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for b in batches:
            own[slot([c.to_numpy() for c in b.columns], bits)] = True
        packed = np.packbits(own, bitorder="little").view(np.int64)
        at = np.nonzero(packed)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed[at])], ["at", "bits"])

    out = np.zeros(bits // 64, np.int64)
    found = names.select(*columns).mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


@contextlib.contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """What is written within goes to Python a row at a time: a chunk's row has megabytes, and a task reads many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, the number of each one's key among them, and their counts; np.unique takes twice the
    memory. keys are at most 2^31."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    own = keys[order]
    np.not_equal(own[1:], own[:-1], out=new[1:])
    own = own[new]
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del order
    return own, which, np.diff(np.append(np.nonzero(new)[0], len(keys)))


def counted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and their counts. keys are sorted in place."""
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return keys[new], np.diff(np.append(np.nonzero(new)[0], len(keys)))


class Pairs:
    """The different pairs of neighbours in a stream whose numbers stand for ids: where they begin, which one, its ids."""

    def __init__(self, stream: bytes, ids: np.ndarray):
        s = np.frombuffer(stream, np.int32)
        name = np.concatenate([[0], ids])
        self.at = np.nonzero((s[:-1] > 0) & (s[1:] > 0))[0].astype(np.int32)
        both = s[self.at].astype(np.int64)
        both *= len(name)
        both += s[self.at + 1]
        keys, self.which, self.n = distinct(both)
        self.left, self.right = name[keys // len(name)], name[keys % len(name)]

    def triples(self, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where triples begin of which the map knows both pairs, and their keys: the numbers of both pairs in one."""
        good = often[slot([self.left, self.right], len(often))][self.which]
        i = np.nonzero((np.diff(self.at) == 1) & good[:-1] & good[1:])[0]
        keys = self.which[i].astype(np.int64)
        keys *= len(self.n)
        keys += self.which[i + 1]
        return self.at[i], keys

    def ids(self, keys: np.ndarray) -> list[np.ndarray]:
        """The three ids of triples."""
        first, second = keys // max(1, len(self.n)), keys % max(1, len(self.n))
        return [self.left[first], self.right[first], self.right[second]]

    def quads(self, often: np.ndarray, triples: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The four ids of the different quadruples of which the maps know all pairs and both triples, and their counts."""
        at, keys = self.triples(often)
        keys, which, _ = distinct(keys)
        known = np.empty(len(keys), bool)
        for k in range(0, len(keys), SOME):
            known[k : k + SOME] = triples[slot(self.ids(keys[k : k + SOME]), len(triples))]
        good = known[which]
        i = np.nonzero((np.diff(at) == 1) & good[:-1] & good[1:])[0]
        own = which[i].astype(np.int64)
        own *= len(keys)
        own += which[i + 1]
        del at, good, which, i
        own, n = counted_keys(own)
        first, second = keys[own // max(1, len(keys))], keys[own % max(1, len(keys))]
        return [*self.ids(first), self.ids(second)[2]], n


def pair_counts(level: DataFrame) -> DataFrame:
    """(l, r, n): each different pair of a chunk and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, ids in zip(b.column(0), b.column(1)):
                p = Pairs(stream.as_py(), ids.values.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(p.left), pa.array(p.right), pa.array(p.n.astype(np.int64))], ["l", "r", "n"])
        trim()

    return level.select("stream", "ids").mapInArrow(run, "l long, r long, n long")


def triple_counts(level: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(a, b, c, n): each different triple of a chunk whose pairs may both be frequent. pairs: their bitmap, as a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, ids in zip(b.column(0), b.column(1)):
                p = Pairs(stream.as_py(), ids.values.to_numpy())
                keys, n = counted_keys(p.triples(pairs.value)[1])
                yield pa.RecordBatch.from_arrays([*map(pa.array, p.ids(keys)), pa.array(n.astype(np.int64))], ["a", "b", "c", "n"])
        trim()

    return level.select("stream", "ids").mapInArrow(run, "a long, b long, c long, n long")


def quad_counts(level: DataFrame, pairs: np.ndarray, triples: np.ndarray) -> DataFrame:
    """(a, b, c, d, n): each different quadruple of a chunk whose pairs and triples may all be frequent. pairs, triples: their
    bitmaps, as broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, ids in zip(b.column(0), b.column(1)):
                p = Pairs(stream.as_py(), ids.values.to_numpy())
                four, n = p.quads(pairs.value, triples.value)
                yield pa.RecordBatch.from_arrays([*map(pa.array, four), pa.array(n.astype(np.int64))], ["a", "b", "c", "d", "n"])
        trim()

    return level.select("stream", "ids").mapInArrow(run, "a long, b long, c long, d long, n long")


def first_level(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """The chunks' streams with the ids of frequent words."""
    held = chunks.select("chunk", "lang", F.posexplode("words").alias("pos", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    known = held.groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, stream, known in zip(*b.columns):
                pos, new = known.values.field("pos").to_numpy(), known.values.field("id").to_numpy()
                s = np.frombuffer(stream.as_py(), np.int32)
                number = np.zeros(int(s.max()) + 1, np.int32)
                number[pos + 1] = np.arange(1, len(pos) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([number[s].tobytes()], pa.binary()), pa.array([new], pa.list_(pa.int64()))], ["chunk", "stream", "ids"])
        trim()

    return chunks.select("chunk", "stream").join(known.hint("merge"), "chunk").select("chunk", "stream", "known").mapInArrow(run, "chunk string, stream binary, ids array<long>")


def grown(names: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """The rows of k-word phrases: text, last word, counts of beginnings (pre) and ends (suf) by their lengths, parents."""
    left = parents.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("lp"), "pre", F.col("l").alias("ll"), F.col("r").alias("lr"))
    right = parents.select(F.col("id").alias("r"), "last", "suf", F.col("r").alias("rr"))
    return names.join(left, "l").join(right, "r").select(
        "id", "lang", F.concat_ws(" ", "lp", "last").alias("phrase"), "last", "f", F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"), "l", "r", "ll", "lr", "rr", F.lit(k).alias("k")
    )


def exact(c: Column) -> Column:
    """For products beyond a long."""
    return c.cast("decimal(20,0)")


def ranked(phrases: DataFrame, totals: DataFrame, share: int, top: int) -> DataFrame:
    """The first phrases of each language: scored by their lowest cut, without those a longer one nearly always holds."""
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct((exact(F.col("f")) * F.lit(2_000_000).cast("decimal(7,0)")).alias("p"), i.alias("i"), F.element_at("pre", i).alias("x"), F.element_at("suf", F.col("k") - i).alias("y")))
    # div of decimals is the floor here: both are positive
    scored = F.expr("transform(cuts, c -> struct(c.p div (cast(c.x as decimal(20,0)) + cast(c.y as decimal(20,0))) as score, c.i as i, c.x as x, c.y as y))")
    rows = phrases.withColumn("cuts", cuts).withColumn("cut", F.array_min(scored))
    inner = F.when(F.col("k") == 3, F.array(F.struct(F.lit(2).alias("k"), F.col("l").alias("id")), F.struct(F.lit(2).alias("k"), F.col("r").alias("id")))).when(
        F.col("k") == 4, F.array(*(F.struct(F.lit(n).alias("k"), F.col(c).alias("id")) for n, c in ((3, "l"), (3, "r"), (2, "ll"), (2, "lr"), (2, "rr"))))
    )
    covers = phrases.where("k > 2").select("f", F.explode(inner).alias("i")).groupBy(F.col("i.k").alias("k"), F.col("i.id").alias("id")).agg(F.max("f").alias("cover"))
    left = rows.join(covers, ["k", "id"], "left").where(F.coalesce(exact(F.col("cover")) * F.lit(100) < exact(F.col("f")) * F.lit(share), F.lit(True)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = left.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.x").alias("l"), F.col("cut.y").alias("r"), F.col("cut.score").alias("score"))
    # two rankings: the first within a share of a language, so that no task ever gets more than SALTS x top rows
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    out = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(some)).where(F.col("place") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, min_count: int = 30, share: int = 80, top: int = 2000, chunk: int = CHUNK, most: int = SLICE, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases of 2 to 4 words, of docs (text, lang)."""
    spark = docs.sparkSession
    chunks = written(chunked(docs, chunk, most), "phrase-chunks")
    n = max(partitions(spark), -(-chunks.count() // 4))  # a few chunks a task, however many there are
    totals = written(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    counts = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = numbered(counts, ["lang", "word"], min_count, "phrase-words")
    known = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("pre"), F.array("f").alias("suf"), F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("r"))
    with one_row_batches(spark):
        level = written(first_level(chunks.repartition(n, "chunk"), words), "phrase-level")
    dropped(chunks)
    with one_row_batches(spark):
        pairs = numbered(pair_counts(level), ["l", "r"], min_count, "phrase-pairs")
    two = written(grown(pairs, known, 2), "phrases")
    some_pairs = spark.sparkContext.broadcast(bitmap(pairs, ["l", "r"], bits))
    counted = triple_counts(level, some_pairs).groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    first, second = (pairs.select(F.col("l").alias(x), F.col("r").alias(y), F.col("id").alias(p)) for x, y, p in (("a", "b", "l"), ("b", "c", "r")))
    with one_row_batches(spark):
        triples = numbered(counted.join(first, ["a", "b"]).join(second, ["b", "c"]), ["a", "b", "c", "l", "r"], min_count, "phrase-triples")
    three = written(grown(triples, two, 3), "phrases")
    some_triples = spark.sparkContext.broadcast(bitmap(triples, ["a", "b", "c"], bits))
    counted = quad_counts(level, some_pairs, some_triples).groupBy("a", "b", "c", "d").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    first, second = (triples.select(*(F.col(c).alias(x) for c, x in zip("abc", own)), F.col("id").alias(p)) for own, p in (("abc", "l"), ("bcd", "r")))
    with one_row_batches(spark):
        fours = numbered(counted.join(first, ["a", "b", "c"]).join(second, ["b", "c", "d"]), ["l", "r"], min_count, "phrase-fours")
    four = written(grown(fours, three, 4), "phrases")
    dropped(level)
    whole = two.unionByName(three).unionByName(four)
    return ranked(whole, totals, share, top)
