"""Exact Jaccard join of sets of word shingles, by universe partition and the pigeonhole principle.

Two sets of sizes s >= l whose similarity is at least p % differ in at most H = (100 - p) (s + l) / (100 + p) shingles, and
l >= p % of s. Sizes fall into bands. For a band, hashing deals the universe of shingles into m segments, so that a set is m
small sets, and a set is indexed in its own band and in those of the smaller sets it may be similar to. Give segment i a
weight v: 0, it is not looked at; 1, its parts must be equal; 2, they may differ by one shingle. If the weights add up to
H + 1, two similar sets meet in a segment at least: else each segment would hold v differences or more, H + 1 in all.

1. Equal sets fold to one node, the smallest doc_id of them. Only nodes go on.
2. Every node gives a key for each segment. Nodes of one key are a list. In short bands all weights are 2: nodes give keys of
   their segments with each shingle left out too. In the others all weights are 1, with an eighth more segments than needed.
3. Each node is held against the first of its lists, which joins groups of near copies. Lists whose nodes all hang together
   by then are closed.
4. Open lists of up to HOT nodes, and all of short bands, are compared. Longer ones, as of segments that a template fills or
   that are empty, weigh 0, where the weights of the rest suffice. Where they don't, the missing weight is allocated by
   cost: a segment gets 2, at the price of the neighbours that a node's deletions meet, or a long list is compared after
   all, at the price of its length; the cheapest first. Neighbours need only be sought among nodes of long lists: of a pair
   that shares no other list, both are such nodes.
5. To compare is to count differing bits of the nodes' parity maps (about a bit a shingle): they never are more than the
   shingles in which two sets differ, so what is too far is ruled out for certain. What remains is decided by the whole sets.

Comparisons run in tiles of bounded bytes, whatever the length of a list; all lists and candidates are shuffled tables.

Null and empty texts, and texts of blanks, have the empty set and link with nothing. Rows with a null id are left out. Rows
that share an id are one node of the graph: each row keeps its own n_shingles, all get one component. Ties need no order:
components are the same however they are found. Only the two columns are read, so extra columns may have any name. Sets hold
64-bit hashes of shingles.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import by_group, components, dropped, in_map, key_map, partitions, starts, trim, written
from tessera.llm.textops import MULT, mix, word_hashes, words_of

SPACES = re.compile(rb"[\x20\x09-\x0D]")

#: Open lists of up to so many nodes are compared as they are.
HOT = 256
#: Bands up to this size have keys of deletions for all.
SHORT = 48
#: Bytes of parity maps in a part of a list; two parts meet in a tile.
PART = 1 << 20
#: Bytes that are compared at a time.
BLOCK = 1 << 23
#: Bits of the maps of keys that are looked for.
BITS = 1 << 25
#: Rounds in which keys are listed: a round shuffles its share of them.
ROUNDS = 2


class Bands:
    """How sizes fall into bands, and how many segments a band has."""

    def __init__(self, percent: int):
        self.percent = percent
        top = 0
        while self.differences(top + 1, (top + 1) * 100 // percent) == 0:
            top += 1
        self.tops = [top]  # of the first band only equal sets are similar
        while self.tops[-1] < 1 << 40 and len(self.tops) < 255:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 5 // 4))

    def differences(self, a: int, b: int) -> int:
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size gives keys."""
        least = -(-self.percent * size // 100)
        return list(range(max(1, bisect.bisect_left(self.tops, least)), bisect.bisect_left(self.tops, size) + 1))

    def need(self, band: int, size: int) -> int:
        """The weights that a set of this size needs in the band."""
        return self.differences(size, min(size, self.tops[band])) + 1

    def short(self, band: int) -> bool:
        return self.tops[band] <= SHORT

    def segments(self, band: int) -> int:
        most = self.need(band, self.tops[band] * 100 // self.percent)
        return -(-most // 2) if self.short(band) else most + most // 8 + 1


#: Bytes of texts that are read together, and of a text that are read at a time.
TEXTS = 4 << 20


def words_at(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes begin, and their hashes; long texts are read in steps that end between words."""
    found, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + TEXTS)
        if end < len(raw):
            space = SPACES.search(raw, end)
            end = space.start() if space else len(raw)
        data = np.frombuffer(raw, np.uint8, end - at, at)
        start, stop = words_of(data)
        found.append((start + at, word_hashes(data, start, stop)))
        at = end
    return (np.concatenate([x for x, _ in found]), np.concatenate([h for _, h in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the texts' shingles, in order, text after text; and how many each text has."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    start, words = words_at(b" ".join(raws))
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    place = np.searchsorted(start, first)
    count = np.diff(place)
    owner = np.repeat(np.arange(len(raws)), count)
    left = place[1:][owner] - np.arange(len(owner))  # words from here to the text's end
    # a text of fewer words is one shingle
    length = np.where(left >= width, width, np.where((count < width)[owner] & (left == count[owner]), left, 0))
    at = np.nonzero(length)[0]
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            more = length[at] > j
            h[more] = mix(h[more] * np.uint64(MULT) + words[at[more] + j] + np.uint64(j + 1))
    owner = owner[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = starts(owner, h)
    return h[new], np.bincount(owner[new], minlength=len(raws))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


def together(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts to be read together."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(size, size[at] + TEXTS, "right")) - 1)
        yield at, end
        at = end


def named(sums: np.ndarray, segment: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Keys of bands' segments by the sums of their shingles; the last byte is the band."""
    band = np.asarray(band).astype(np.uint64)
    with np.errstate(over="ignore"):
        z = mix(sums + (segment.astype(np.uint64) + (band << np.uint64(32)) + np.uint64(1)) * np.uint64(MULT))
    return ((z & ~np.uint64(255)) | band).view(np.int64)


def segment_keys(own: np.ndarray, size: np.ndarray, band: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets that follow each other (size shingles each, with a band and its number of segments): the key of each segment;
    of each shingle its segment, and the key that this has without the shingle."""
    base = np.concatenate([[0], np.cumsum(m)])
    of = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        z = mix(own + (np.uint64(0x632BE59BD9B4E019) * (band[of].astype(np.uint64) + np.uint64(1))))
        segment = ((z >> np.uint64(20)) % m[of].astype(np.uint64)).astype(np.int64)
        value = mix(z ^ np.uint64(0xD6E8FEB86659FD93))
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, base[of] + segment, value)
        number = np.arange(base[-1]) - np.repeat(base[:-1], m)
        return named(sums, number, np.repeat(band, m)), segment, named(sums[base[of] + segment] - value, segment, band[of])


def parities(own: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    """For each set a map of at least a bit a shingle, a power of two of longs: the parity of the shingles that fall on a
    bit. None for empty sets."""
    longs = np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(1, -(-size // 64)))).astype(np.int64), 0)
    base = np.concatenate([[0], np.cumsum(64 * longs)])
    of = np.repeat(np.arange(len(size)), size)
    slot = (mix(own ^ np.uint64(0xA0761D6478BD642F)) % (64 * longs[of]).astype(np.uint64)).astype(np.int64) if len(own) else np.zeros(0, np.int64)
    packed = np.packbits((np.bincount(base[of] + slot, minlength=base[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[s // 8 : e // 8] if e > s else None for s, e in zip(base[:-1].tolist(), base[1:].tolist())]


def digests(own: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    ends = np.cumsum(size)
    return [hashlib.md5(own[e - n : e].tobytes()).digest() if n else None for e, n in zip(ends.tolist(), size.tolist())]


def names(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, n) of every text; an empty set has no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in together(b.column(1)):
                own, size = shingle_sets(b.column(1)[at:end].to_pylist(), width)
                yield pa.RecordBatch.from_arrays([b.column(0)[at:end], pa.array(digests(own, size), pa.binary()), pa.array(size, pa.int64())], ["doc_id", "digest", "n"])
        trim()

    return docs.mapInArrow(run, "doc_id long, digest binary, n long")


def all_keys(own: np.ndarray, size: np.ndarray, bands: Bands) -> pa.Array:
    """The keys of each set in all its bands."""
    which = [bands.of(n) if n else [] for n in size.tolist()]
    ends = np.concatenate([[0], np.cumsum(size)])
    of, key = [], []
    for r in range(max(map(len, which), default=0)):
        sets = np.array([i for i, w in enumerate(which) if len(w) > r], np.int64)
        band = np.array([which[i][r] for i in sets], np.int64)
        m = np.array([bands.segments(x) for x in band.tolist()], np.int64)
        part = own if len(sets) == len(size) else np.concatenate([own[ends[i] : ends[i + 1]] for i in sets])
        whole, _, less = segment_keys(part, size[sets], band, m)
        short = np.array([bands.short(x) for x in band.tolist()])
        of += [np.repeat(sets, m), np.repeat(sets, size[sets])[np.repeat(short, size[sets])]]
        key += [whole, less[np.repeat(short, size[sets])]]
    of_, key_ = (np.concatenate(of), np.concatenate(key)) if of else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(of_, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of_, minlength=len(size)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key_[order]))


def sketches(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(doc_id, digest, n, bits, keys) of every text with a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in together(b.column(1)):
                own, size = shingle_sets(b.column(1)[at:end].to_pylist(), width)
                out = [b.column(0)[at:end], pa.array(digests(own, size), pa.binary()), pa.array(size, pa.int64()), pa.array(parities(own, size), pa.binary()), all_keys(own, size, bands)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "digest", "n", "bits", "keys"]).filter(pa.array(size > 0))
        trim()

    return docs.mapInArrow(run, "doc_id long, digest binary, n long, bits binary, keys array<long>")


def listed(classes: DataFrame, turn: int = 0, rounds: int = 1) -> DataFrame:
    """(key, size, low): the keys of a round that several nodes give, and the smallest of these. Tasks read sorted keys in a
    stream, so a key may have any number of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int] | None = None  # key, size, low of the last key so far
        for b in batches:
            if not b.num_rows:
                continue
            key, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            first = starts(key)
            size, low, key = np.diff(np.append(first, len(key))), rep[first].copy(), key[first]
            if held is not None:
                if key[0] == held[0]:
                    size[0], low[0] = size[0] + held[1], held[2]
                else:
                    key, size, low = (np.append(x, y) for x, y in zip(held, (key, size, low)))
            held = (int(key[-1]), int(size[-1]), int(low[-1]))
            many = np.nonzero(size[:-1] > 1)[0]
            yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(size[many].astype(np.int64)), pa.array(low[many])], ["key", "size", "low"])
        if held is not None and held[1] > 1:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], ["key", "size", "low"])

    keyed = classes.select(F.explode("keys").alias("key"), "rep").where(F.pmod(F.shiftright("key", 8), F.lit(rounds)) == turn)
    keyed = keyed.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key", "rep")
    return keyed.mapInArrow(run, "key long, size long, low long")


def held_by(classes: DataFrame, lists: DataFrame, bits: int) -> DataFrame:
    """(key, size, low, rep) of the nodes of lists. A map of the lists' keys spares most other keys the way."""
    map_ = classes.sparkSession.sparkContext.broadcast(key_map(lists, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            key = b.column(1).flatten().to_numpy()
            may = in_map(map_.value, key)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), count)[may]), pa.array(key[may])], ["rep", "key"])
        trim()

    return classes.select("rep", "keys").mapInArrow(run, "rep long, key long").join(lists, "key")


def maps_of(bits: list[bytes]) -> np.ndarray:
    """Parity maps as rows of longs, folded to the smallest of them: the parity of two bits is the parity of their sum."""
    width = min(map(len, bits))
    out = np.zeros((len(bits), width // 8), np.uint64)
    for i, b in enumerate(bits):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0)
    return out


def may_be_similar(maps: np.ndarray, n: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a and b (of a alone, each once, where b is None) that hang not together yet and that sizes and maps allow."""
    left, right = [], []
    other = a if b is None else b
    step = max(1, BLOCK // max(1, maps.shape[1] * 8 * len(other)))
    for at in range(0, len(a), step):
        i = a[at : at + step]
        j = other if b is not None else other[at:]
        x, y = n[i][:, None], n[j][None]
        open_ = (group[i][:, None] != group[j][None]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        if b is None:
            open_ &= i[:, None] < j[None]
        p, q = np.nonzero(open_)
        for cut in range(0, len(p), max(1, BLOCK // (maps.shape[1] * 8))):
            u, v = i[p[cut : cut + max(1, BLOCK // (maps.shape[1] * 8))]], j[q[cut : cut + max(1, BLOCK // (maps.shape[1] * 8))]]
            far = np.bitwise_count(maps[u] ^ maps[v]).sum(1, dtype=np.int64)
            hit = far * (100 + percent) <= (100 - percent) * (n[u] + n[v])
            left.append(u[hit])
            right.append(v[hit])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


MEMBER, PROBER, BOTH = 0, 1, 2


def tiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deals the rows (keys, rep, n, group, bits, kind) of each key into tiles of bounded bytes: each member and prober of a
    key meet in one, as do each two rows that are both."""
    size = F.sum(F.length("bits") + 64)
    sizes = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.length("bits") + 64)), F.lit(0)).alias(f"size{k}") for k in (MEMBER, PROBER, BOTH)), size.alias("size"))
    parts = {k: F.greatest(F.lit(1), F.ceil(F.col(f"size{k}") / PART)).cast("int") for k in (MEMBER, PROBER, BOTH)}
    sizes = sizes.select(*keys, *(parts[k].alias(f"parts{k}") for k in parts))
    dealt = rows.join(sizes, keys)
    own = F.when(F.col("kind") == MEMBER, F.col("parts0")).when(F.col("kind") == PROBER, F.col("parts1")).otherwise(F.col("parts2"))
    others = F.when(F.col("kind") == MEMBER, F.col("parts1")).when(F.col("kind") == PROBER, F.col("parts0")).otherwise(F.col("parts2"))
    dealt = dealt.withColumn("place", F.pmod(F.xxhash64("rep"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    both = F.col("kind") == BOTH
    lo = F.when(both, F.least("place", "other")).when(F.col("kind") == MEMBER, F.col("place")).otherwise(F.col("other"))
    hi = F.when(both, F.greatest("place", "other")).when(F.col("kind") == MEMBER, F.col("other")).otherwise(F.col("place"))
    # of two parts of rows that are both, those of the higher part probe
    kind = F.when(both & (F.col("place") < F.col("other")), MEMBER).when(both & (F.col("place") > F.col("other")), PROBER).otherwise(F.col("kind"))
    return dealt.select(*keys, lo.alias("lo"), hi.alias("hi"), kind.cast("int").alias("kind"), "rep", "n", "group", "bits")


def candidates(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b), a < b: pairs of reps that share a key, hang not together yet, and may be similar by sizes and maps."""
    by = [*keys, "lo", "hi"]

    def process(whole: pa.Table) -> pa.RecordBatch | None:
        cols = [whole.column(k).to_numpy() for k in by]
        rep, n, group, kind = (whole.column(c).to_numpy() for c in ("rep", "n", "group", "kind"))
        bits = whole.column("bits").to_pylist()
        first = starts(*cols)
        found = []
        for s, e in zip(first.tolist(), np.append(first[1:], len(rep)).tolist()):
            if e - s < 2:
                continue
            maps, k = maps_of(bits[s:e]), kind[s:e]
            member, prober, both = (np.nonzero(k == x)[0] for x in (MEMBER, PROBER, BOTH))
            for a, b in ((prober, member), (both, None)):
                u, v = may_be_similar(maps, n[s:e], group[s:e], a, b, percent) if len(a) and (b is None or len(b)) else ([], [])
                if len(u):
                    x, y = rep[s + u], rep[s + v]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y])
        if not found:
            return None
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    n = partitions(rows.sparkSession)
    dealt = tiles(rows, keys).repartition(n, *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(by_group(process, by, 20_000), "a long, b long").distinct()


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (rep, own) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for x, y in zip(b.column(2), b.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short, long_ = (u, v) if len(u) < len(v) else (v, u)
                place = np.minimum(np.searchsorted(long_, short), len(long_) - 1)
                both = int((long_[place] == short).sum())
                hit.append(100 * both >= percent * (len(u) + len(v) - both))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])
        trim()

    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("own").alias("x")).hint("merge"), "a")
    with_b = with_a.join(sets.select(F.col("rep").alias("b"), F.col("own").alias("y")).hint("merge"), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def wanting(long_: DataFrame, maps: DataFrame, bands: Bands) -> DataFrame:
    """(rep, band, missing): nodes whose other lists do not weigh enough, and the weight that they miss."""
    rows = long_.withColumn("band", F.col("key").bitwiseAND(F.lit(255)).cast("int")).groupBy("rep", "band").agg(F.countDistinct("key").alias("dropped")).join(maps.select("rep", "n").hint("merge"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, band, dropped_, n = (c.to_pylist() for c in b.columns)
            missing = [bands.need(x, k) - (bands.segments(x) - d) for x, d, k in zip(band, dropped_, n)]
            out = pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(band, pa.int32()), pa.array(missing, pa.int32())], ["rep", "band", "missing"])
            yield out.filter(pc.greater(out.column(2), 0))

    return rows.select("rep", "band", "dropped", "n").mapInArrow(run, "rep long, band int, missing int").groupBy("rep", "band").agg(F.max("missing").alias("missing"))


def entries(sets: DataFrame, hot: DataFrame, lack: DataFrame, bands: Bands, bits: int = BITS) -> DataFrame:
    """(band, segment, rep, cls, key, role, missing, hot) of the sets in long lists that wanting nodes hold: role 0 are keys
    of whole segments, role 1 of segments without a shingle; hot marks a set's long lists. Wanting nodes give all of theirs in
    their bands, the others what those look for: a map of it spares the rest the way."""
    needs = lack.groupBy("rep").agg(F.collect_list("band").alias("bands"), F.collect_list("missing").alias("misses"))
    rows = sets.join(hot.groupBy("rep").agg(F.collect_list("key").alias("keys")).hint("merge"), "rep").join(needs.hint("merge"), "rep", "left")
    none = F.array().cast("array<int>")
    rows = rows.select("rep", "own", "keys", F.coalesce("bands", none).alias("bands"), F.coalesce("misses", none).alias("misses"))
    kind = "band int, segment int, rep long, cls long, key long, role int, missing int, hot boolean"
    asked = written(rows.where(F.size("bands") > 0).mapInArrow(entries_of(bands, None), kind), "asked-entries")
    map_ = sets.sparkSession.sparkContext.broadcast(key_map(asked.where("not hot"), bits))
    return asked.unionByName(rows.mapInArrow(entries_of(bands, map_), kind))


def entries_of(bands: Bands, map_) -> Callable:
    """Without a map, the entries of wanting nodes in their bands; else those of all others that the map, a broadcast, knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, raw, long_keys, own_bands, misses in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                own, long_keys = np.frombuffer(raw.as_buffer(), np.uint64), long_keys.values.to_numpy()
                cls = int.from_bytes(hashlib.md5(own.tobytes()).digest()[:8], "little", signed=True)
                lacks = dict(zip(own_bands, misses))
                for band in set((long_keys & 255).tolist()) & set(bands.of(len(own))):
                    if (map_ is None) != (band in lacks):
                        continue
                    m = bands.segments(band)
                    whole, segment, less = segment_keys(own, np.array([len(own)]), np.array([band]), np.array([m]))
                    hot_ = np.isin(whole, long_keys)
                    n = m + len(own)
                    seg = np.concatenate([np.arange(m), segment])
                    cols = [np.full(n, band), seg, np.full(n, rep), np.full(n, cls), np.concatenate([whole, less]), np.concatenate([np.zeros(m, int), np.ones(len(own), int)]), np.full(n, lacks.get(band, 0))]
                    cols.append(hot_[seg])
                    if map_ is not None:
                        may = in_map(map_.value, cols[4])
                        cols = [c[may] for c in cols]
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["band", "segment", "rep", "cls", "key", "role", "missing", "hot"])
        trim()

    return run


def allocated(found: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest ways to the missing weights: (key, role, rep, kind) of segments that now weigh 2, and the keys of long
    lists that are compared after all."""
    counts = written(found.groupBy("key", "role").agg(F.count("*").alias("cost")), "entry-counts")
    asked = found.where("missing > 0")
    # a whole segment looks for deletions, and the other way round
    met = asked.where("not hot").join(counts.select("key", (1 - F.col("role")).alias("role"), "cost"), ["key", "role"])
    prices = met.groupBy("rep", "cls", "band", "segment").agg(F.sum("cost").alias("cost"))
    cold = asked.where("not hot and role = 0").select("rep", "cls", "band", "segment", "missing", F.lit(None).cast("long").alias("list"))
    cold = cold.join(prices, ["rep", "cls", "band", "segment"], "left").withColumn("cost", F.coalesce("cost", F.lit(0)))
    sizes = hot.select("key", "size").distinct()
    lists = asked.where("hot and role = 0").join(sizes, "key").select("rep", "cls", "band", "segment", "missing", F.col("key").alias("list"), F.col("size").alias("cost"))
    by_cost = Window.partitionBy("rep", "cls", "band").orderBy("cost", "segment")
    chosen = written(cold.unionByName(lists).withColumn("place", F.row_number().over(by_cost)).where("place <= missing"), "allocated")
    ours = chosen.where("list is null").select("rep", "cls", "band", "segment")
    probes = asked.join(ours, ["rep", "cls", "band", "segment"]).select("key", (1 - F.col("role")).alias("role"), "rep", F.lit(PROBER).alias("kind"))
    met = found.select("key", "role", "rep", F.lit(MEMBER).alias("kind")).join(probes.select("key", "role").distinct(), ["key", "role"], "left_semi")
    return written(probes.unionByName(met), "neighbours"), chosen.where("list is not null").select(F.col("list").alias("key")).distinct()


def similar_components(docs: DataFrame, width: int = 5, percent: int = 80, hot: int = HOT, extra: DataFrame | None = None, blanks: bool = False, bits: int = BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text) with an id: the smallest doc_id reachable over
    links. ``extra`` (a, b) may name pairs of doc_ids to be tried first, where others know of likely copies; with ``blanks`` texts without words
    are equal to each other."""
    bands = Bands(percent)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = written(names(rows, width), "set-names")
    folded = sketches(rows, width, bands).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"), F.any_value("keys").alias("keys"))
    classes = written(folded, "set-classes")
    maps = written(classes.select("rep", "n", "bits"), "set-maps")
    lists = None
    for turn in range(ROUNDS):
        some = written(listed(classes, turn, ROUNDS), "set-lists")
        lists = some if lists is None else lists.unionByName(some)
    members = written(held_by(classes, lists, bits), "set-members")
    dropped(classes)
    dropped(lists)

    # each node against the first of its lists
    stars = members.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    if extra is not None:
        named_ = own.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
        of = own.join(named_, "digest").select("doc_id", "rep")
        said = extra.join(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("x")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("rep").alias("y")), "b")
        stars = stars.unionByName(said.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    stars = written(stars.distinct(), "set-stars")
    x, y = (maps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [b.column(2).to_numpy(), b.column(4).to_numpy()]
            hit = []
            for i, (u, v) in enumerate(zip(b.column(3).to_pylist(), b.column(5).to_pylist())):
                pair = maps_of([u, v])
                far = int(np.bitwise_count(pair[0] ^ pair[1]).sum())
                s, t = int(n[0][i]), int(n[1][i])
                hit.append(100 * min(s, t) >= percent * max(s, t) and far * (100 + percent) <= (100 - percent) * (s + t))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    likely = stars.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    likely = written(likely.mapInArrow(near, "a long, b long").distinct(), "set-likely")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in together(b.column(1)):
                own, size = shingle_sets(b.column(1)[at:end].to_pylist(), width)
                ends = np.cumsum(size)
                sets = [own[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0)[at:end], pa.array(sets, pa.binary())], ["rep", "own"])
        trim()

    def sets_of(reps: DataFrame, name: str) -> DataFrame:
        # a merge join at every size: what is joined with texts grows with them
        wanted = rows.join(reps.distinct().withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id", "left_semi")
        return written(wanted.select("doc_id", "text").mapInArrow(whole, "rep long, own binary").where(F.length("own") > 0), name)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))

    first_sets = sets_of(ends(likely), "first-sets")
    links = written(similar_pairs(likely, first_sets, percent), "first-links")
    dropped(first_sets)
    hung = written(components(links), "first-groups")

    # what hangs not together yet
    grouped = members.select("key", "size", "rep").join(hung, members.rep == hung.node, "left").select("key", "size", "rep", F.coalesce("root", "rep").alias("group"))
    open_ = grouped.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
    grouped = written(grouped.join(open_, "key").withColumn("band", F.col("key").bitwiseAND(F.lit(255)).cast("int")), "open-lists")
    dropped(members)
    is_short = F.col("band").isin([b for b in range(len(bands.tops)) if bands.short(b)])
    cold = grouped.where(is_short | (F.col("size") <= hot)).select("key", F.lit(2).alias("role"), "rep", F.lit(BOTH).alias("kind"))
    long_ = written(grouped.where(~is_short & (F.col("size") > hot)).select("key", "size", "rep"), "long-lists")
    todo = cold
    lack = written(wanting(long_, maps, bands), "wanting")
    if lack.limit(1).count():
        # a lost pair shares a long list, and one of it is wanting in its band
        with_band = long_.withColumn("band", F.col("key").bitwiseAND(F.lit(255)).cast("int"))
        told = with_band.join(lack, ["rep", "band"], "left_semi").select("key").distinct()
        long_ = written(long_.join(told, "key", "left_semi"), "wanted-lists")
        long_sets = sets_of(long_.select("rep"), "long-sets")
        found = written(entries(long_sets, long_, lack, bands, bits), "segment-entries")
        dropped(long_sets)
        neighbours, whole_lists = allocated(found, long_)
        dropped(found)
        again = long_.join(whole_lists, "key", "left_semi").select("key", F.lit(2).alias("role"), "rep", F.lit(BOTH).alias("kind"))
        todo = cold.unionByName(again).unionByName(neighbours.select("key", "role", "rep", "kind"))
    facts = maps.join(hung, maps.rep == hung.node, "left").select("rep", "n", "bits", F.coalesce("root", "rep").alias("group"))
    more = written(candidates(todo.join(facts.hint("merge"), "rep"), ["key", "role"], percent), "open-pairs")
    dropped(grouped)
    last_sets = sets_of(ends(more), "last-sets")
    late = written(similar_pairs(more, last_sets, percent), "last-links")
    dropped(last_sets)

    alike = own.withColumn("digest", F.coalesce("digest", F.lit(bytearray()))) if blanks else own.where("n > 0")
    reps = alike.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    same = alike.join(reps, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = hung.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(late).unionByName(same)
    ended = components(edges)
    return own.join(ended, own.doc_id == ended.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
