"""Token ids in frequency-ranked, byte-aligned variable-length code.

A file is a row of segments, each decodable by itself:

    magic "FRVL", then little-endian: documents u32, ids u64, distinct ids u32, control bytes u64, data bytes u64
    ids by rank u32[distinct]          the most frequent id of the segment has rank 0, ties go to the smaller id
    doc_id i64[documents], ids of each document i64[documents]
    control bytes                      two bits an id, four ids a byte, lowest bits first: bytes of its rank, less one
    data bytes                         the ranks, little-endian, in 1 to 4 bytes each

Documents lie in ascending order of doc_id over the files; ids of one segment number about ``SEGMENT``, so neither
writer nor reader ever holds more than that and one document.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import new_path, partitions, written
from tessera.llm.files import NewFile, Ranges

HEAD = struct.Struct("<4sIQIQQ")
MAGIC = b"FRVL"
SEGMENT = 1 << 20
#: Documents whose parts are numbered together.
DOCS = 4000
#: Distinct words, signs and other parts whose ids a worker keeps; words that are encoded in one call.
CACHE, GROUP = 400_000, 64
#: Letters of plain words, and signs that may follow them.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
SIGNS = "!#$%&()*+,-./:;=?@[]^_{|}~"
#: Ids under this are counted in a table of its size.
TABLE = 1 << 22
#: Row c: the lengths of the four ids whose control byte is c.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """Ids by rank, control bytes and data bytes."""
    if len(ids) and int(ids.max()) < TABLE:
        count = np.bincount(ids)
        known = np.nonzero(count)[0]
        inverse, place = ids, np.empty(len(count), np.uint32)
        count = count[known]
        order = np.lexsort((known, -count))
        place[known[order]] = np.arange(len(known), dtype=np.uint32)
    else:
        known, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((known, -count))
        place = np.empty(len(known), np.uint32)
        place[order] = np.arange(len(known), dtype=np.uint32)
    r = place[inverse]
    more = (r > 0xFF).astype(np.uint8)
    if len(known) > 1 << 16:
        more += (r > 0xFFFF).astype(np.uint8) + (r > 0xFFFFFF)
    quads = np.zeros((-(-len(r) // 4), 4), np.uint8)
    quads.reshape(-1)[: len(r)] = more
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    # the ranks' bytes, of which those that count are kept
    raw = r.astype("<u4").view(np.uint8).reshape(-1, 4)
    most = int(more.max()) + 1 if len(r) else 1
    data = raw[:, :most][np.arange(most, dtype=np.uint8) <= more[:, None]]
    return known[order].astype("<u4"), control.tobytes(), data.tobytes()


def decode(by_rank: np.ndarray, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids again: lengths from a table by control byte, then one gather for each byte of a rank."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    r = raw[at].astype(np.uint32)
    for b in range(1, 4):
        has = np.nonzero(size > b)[0]
        r[has] |= raw[at[has] + b].astype(np.uint32) << np.uint32(8 * b)
    return by_rank[r]


def pack(doc_ids: list[int] | np.ndarray, sizes: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents that have so many ids each."""
    by_rank, control, data = encode(ids)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(by_rank), len(control), len(data))
    return b"".join([head, by_rank.tobytes(), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(sizes, "<i8").tobytes(), control, data])


def unpack(segment: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids) of a segment."""
    magic, docs, n, distinct, c, d = HEAD.unpack_from(segment)
    if magic != MAGIC or len(segment) != HEAD.size + 4 * distinct + 16 * docs + c + d:
        raise ValueError("not a whole segment")
    at = HEAD.size
    by_rank = np.frombuffer(segment, "<u4", distinct, at)
    at += 4 * distinct
    doc_ids, sizes = np.frombuffer(segment, "<i8", docs, at), np.frombuffer(segment, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    return doc_ids, sizes, decode(by_rank, segment[at : at + c], segment[at + c :], n) if n else np.zeros(0, "<u4")


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library that lower-cases, drops white space and splits letters
    from other signs, each part ending in a piece marked as a word's end.

    Blanks and line feeds are mere separators then. Arrow numbers the parts between them, and splits the different ones
    that are plain (a word of letters below U+0250, which are in normal form and lower-cased one by one, and signs that
    follow it) into word and signs. Each different word, signs or other part is looked up once for many texts, and ids are
    gathered by numpy from a pool of all that was met. What is new is encoded by the library: words many to a call, told
    apart by the marked pieces, all else by itself. For words, which are a part each and in normal form already, a copy of
    the tokenizer without its normalizer and its splitting serves. The pool is bounded: when full, it starts anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marked[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Empties the pool but for the empty string; number n has the ids from bounds[n] to bounds[n + 1]."""
        self.numbers: dict[str, int] = {"": 0}
        self.ids, self.bounds, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.numbers), len(strings)
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[self.size : self.size + len(ids)] = ids
        self.bounds[n + 1 : n + m + 1] = self.size + np.cumsum(sizes)
        self.size += len(ids)
        self.numbers.update(zip(strings, range(n, n + m)))

    def learn(self, strings: list[str]) -> None:
        """Adds strings that are encoded one by one."""
        own = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        self.add(strings, np.concatenate(own) if own else np.zeros(0, np.uint32), np.array([len(x) for x in own], np.int64))

    def learn_words(self, words: list[str]) -> None:
        groups, other = [words[i : i + GROUP] for i in range(0, len(words), GROUP)], []
        for group, e in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            at = np.nonzero(self.marked[ids])[0] + 1
            if len(at) == len(group) and at[-1] == len(ids):
                self.add(group, ids, np.diff(at, prepend=0))
            else:
                other += group
        self.learn(other)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many(pa.array([text], pa.string()))[0]

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many are of each text. A null text has none."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        flat = split.flatten().dictionary_encode()
        parts = flat.dictionary
        word = pc.utf8_rtrim(parts, characters=SIGNS)
        plain = pc.match_substring_regex(word, f"^{LETTERS}$")
        words = pc.utf8_lower(word.filter(plain)).dictionary_encode()
        signs = pc.replace_substring_regex(parts.filter(plain), f"^{LETTERS}", "").dictionary_encode()
        lists = [words.dictionary.to_pylist(), signs.dictionary.to_pylist(), parts.filter(pc.invert(plain)).to_pylist()]
        if len(self.numbers) + sum(map(len, lists)) > CACHE:
            self.clear()
        for learn, strings in zip((self.learn_words, self.learn, self.learn), lists):
            learn([x for x in strings if x not in self.numbers])
        number = [np.fromiter(map(self.numbers.__getitem__, x), np.int32, len(x)) for x in lists]
        pair, is_plain = np.zeros((len(parts), 2), np.int32), plain.to_numpy(zero_copy_only=False)
        pair[is_plain, 0], pair[is_plain, 1] = number[0][words.indices.to_numpy()], number[1][signs.indices.to_numpy()]
        pair[~is_plain, 0] = number[2]
        both = pair[flat.indices.to_numpy()].reshape(-1)
        start = self.bounds[both]
        size = self.bounds[both + 1] - start
        ends = np.cumsum(size)
        ids = self.ids[np.repeat((start - ends + size).astype(np.int32), size) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        at = np.concatenate(([0], ends[1::2]))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(at)


@functools.lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker, which outlives its tasks."""
    return Encoder(path)


def write_ids(docs: DataFrame, folder: str, encoder: Callable[[], Encoder], end_id: int | None, segment: int = SEGMENT) -> DataFrame:
    """Writes the ids of every document, the end id appended, to files in the folder, in ascending order of doc_id.

    Returns the segments (file, offset, length, first_doc, ids) as a written table. A null text is empty; rows with a
    null id are left out; rows that share an id follow one another in order of their texts' hashes. Each partition of
    the order writes one file under a name of its own attempt; only files of attempts that succeeded are listed.
    """
    spark = docs.sparkSession
    end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = None, []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # doc_ids, ids of each, all ids
        size = 0

        def flush() -> None:
            nonlocal out, held, size
            if held:
                out = out or NewFile(folder, ".ids")
                doc_ids, sizes, ids = (np.concatenate(x) for x in zip(*held))
                raw = pack(doc_ids, sizes, ids)
                rows.append((out.name, out.write(raw), len(raw), int(doc_ids[0]), len(ids)))
                held, size = [], 0

        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                doc_ids = part.column(0).to_numpy()
                ids, sizes = encoder().many(part.column(1))
                ends = np.cumsum(sizes)
                if len(end):
                    ids = np.insert(ids, ends, end[0])
                    sizes = sizes + 1
                    ends = np.cumsum(sizes)
                lo = 0
                while lo < len(doc_ids):  # documents up to the one that fills the segment
                    before = int(ends[lo - 1]) if lo else 0
                    hi = min(int(np.searchsorted(ends, before + segment - size)) + 1, len(doc_ids))
                    held.append((doc_ids[lo:hi], sizes[lo:hi], ids[before : ends[hi - 1]]))
                    size += int(ends[hi - 1]) - before
                    lo = hi
                    if size >= segment:
                        flush()
        flush()
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "offset", "length", "first_doc", "ids"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(dealt.mapInArrow(run, "file string, offset long, length long, first_doc long, ids long"), "segments")


def read_ids(segments: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; start counts the ids of all
    documents before it: of the files before, summed over a row a file, and of the file's segments before."""
    spark = segments.sparkSession
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = segments.groupBy(F.col("file").alias("of")).agg(F.min("first_doc").alias("at"), F.sum("ids").alias("own"))
    files = files.select("of", F.coalesce(F.sum("own").over(before.orderBy("at", "of")), F.lit(0)).alias("base"))
    own = segments.join(files, segments.file == files.of)
    own = own.select("file", "offset", "length", (F.col("base") + F.coalesce(F.sum("ids").over(before.partitionBy("file").orderBy("offset")), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder)
        for b in batches:
            for file, offset, length, base in zip(*(c.to_pylist() for c in b.columns)):
                doc_ids, sizes, ids = unpack(files.read(file, offset, length))
                ends = np.cumsum(sizes)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(base + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return written(own, "bases").repartition(partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def bpe_round_trip(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes, writes and reads back; see write_ids and read_ids. An empty table gives an empty one."""
    spark: SparkSession = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    return read_ids(write_ids(docs, folder, lambda: encoder_of(path), end_id), folder)
