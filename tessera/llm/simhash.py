"""SimHash near-duplicates through vantage-point trees.

A document's fingerprint has 64 bits: bit b is 1 if it is set in over half of the hashes of the document's word shingles.
Two fingerprints link if they differ in at most ``radius`` bits, and linked documents form components.

How links are found, without pairs of documents ever meeting all at once:

* Copies fold first: only distinct fingerprints go on, each under its smallest doc_id.
* Seen from a vantage point over all 64 bits, nearly all distances are about 32, and a ball of radius 4 crosses nearly
  every boundary. So there are radius // 2 + 1 trees (three for 4), each over the distances in its own part of the bits:
  of two fingerprints within the radius, one part at least differs in no more than radius // (radius // 2 + 1) bits (one
  for 4), and the tree of that part finds them with balls of that size.
* A tree's node holds a vantage point and a boundary. By the triangle inequality a ball reaches across the boundary only
  from within its own size of it, so what lies just outside also goes to the inner side, all else to one side alone: the
  shards overlap at their boundaries, and each is searched for itself.
* The top of a tree is built from a bounded sample of fingerprints and sent to all tasks, which route every fingerprint to
  its shards. In a shard the tree goes on with vantage points of its own down to leaves, whose members are compared over all
  bits. Where no vantage point tells members apart, as in a group of near copies, the distances over all bits are split at
  their median, and the bands on either side of it are searched against each other.
* A shard of more than TILE rows is dealt into tiles: parts of it, each pair of parts being one task, whatever the table's size.

Only the links of a spanning forest leave a shard; their components are found by distributed rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Groups, by_group, components, partitions, starts, trim, written

SEED = 42
#: Members of a leaf, about; a node is split if its larger side has no more than this share of it.
LEAF, TELLING = 8, 0.9
#: Fingerprints that the tops of the trees are built from; rows of a shard, about; most rows of a part of a shard, about.
SAMPLE, SHARD, TILE = 1 << 16, 1000, 20_000
LANES = np.uint64(0x0101010101010101)
#: Shingles that are hashed at a time: bounds the memory that one very long text takes.
BLOCK = 1 << 16
#: Rows of whole shards that are searched together.
ROWS = 20_000


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of width words, in blocks; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - width + 1, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        first = np.concatenate(([0], ends[:-1] + 1))[: len(part) - width + 1].tolist()
        last = ends[width - 1 :].tolist()
        yield np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits drawn from the hashes; the 0-th are the hashes themselves."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; bit 63 first. Eight byte-wide counters add up in one word."""
    out = np.zeros((8, 8), np.int64)
    at = np.arange(0, len(h), 255)
    for j in range(8):
        sums = np.add.reduceat((h >> np.uint64(j)) & LANES, at)
        out[:, j] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)  # little-endian: byte i holds bits 8i..8i+7
    return out.reshape(64)[::-1]


def fingerprint(text: str | None, width: int, longs: int = 1) -> bytes:
    """Big-endian bytes of the fingerprint; all zero for a text without words."""
    counts, n = np.zeros((longs, 64), np.int64), 0
    for h in shingle_hashes(text, width):
        n += len(h)
        for k in range(longs):
            counts[k] += bit_counts(mixed(h, k))
    return np.packbits(counts.reshape(-1) * 2 > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 4, longs: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp binary) for every row. A null text counts as empty; rows with a null id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(t.as_py(), width, longs) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "fp"])
        trim()

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary")


# ---- vantage-point trees


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def link_tree(fp: np.ndarray, groups: Groups, idx: np.ndarray, radius: int, parts: np.ndarray | None = None) -> None:
    """Links in groups all idx whose fingerprints lie within the radius of each other. With parts, a label for each
    of the rows of fp, only members of different parts are sought (both parts of a tile meet themselves elsewhere)."""
    todo: list[tuple[np.ndarray, np.ndarray | None]] = []
    if parts is None:
        todo.append((idx, None))
    else:
        todo.append((idx[parts[idx] == 0], idx[parts[idx] == 1]))
    while todo:
        a, b = todo.pop()
        if b is None:
            split_self(fp, groups, a, radius, todo)
        elif len(a) and len(b):
            split_cross(fp, groups, a, b, radius, todo)


def split_self(fp, groups, a, radius, todo) -> None:
    if len(a) < 2:
        return
    labels = groups.roots(a)
    if (labels == labels[0]).all():
        return
    if len(a) <= 6 * LEAF:
        i, j = np.nonzero(np.triu(distance(fp[a][:, None], fp[a][None]) <= radius, 1))
        groups.link(a[i], a[j])
        return
    d = distance(fp[a], fp[a[0]])
    near = a[d <= radius]
    groups.link(near, np.full(len(near), a[0]))
    m = boundary(d)
    if m is None:
        half = len(a) // 2
        todo += [(a[:half], None), (a[half:], None), (a[:half], a[half:])]
        return
    todo += [(a[d <= m], None), (a[d > m], None), (a[(d <= m) & (d > m - radius)], a[(d > m) & (d <= m + radius)])]


def split_cross(fp, groups, a, b, radius, todo) -> None:
    la, lb = groups.roots(a), groups.roots(b)
    if (la == la[0]).all():
        b = b[lb != la[0]]
    elif (lb == lb[0]).all():
        a = a[la != lb[0]]
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= 36 * LEAF * LEAF or min(len(a), len(b)) == 1:
        i, j = np.nonzero(distance(fp[a][:, None], fp[b][None]) <= radius)
        groups.link(a[i], b[j])
        return
    da, db = distance(fp[a], fp[a[0]]), distance(fp[b], fp[a[0]])
    near = b[db <= radius]
    groups.link(near, np.full(len(near), a[0]))
    m = boundary(np.concatenate([da, db]))
    if m is None:
        if len(a) >= len(b):
            todo += [(a[: len(a) // 2], b), (a[len(a) // 2 :], b)]
        else:
            todo += [(a, b[: len(b) // 2]), (a, b[len(b) // 2 :])]
        return
    todo += [(a[da <= m], b[db <= m]), (a[da > m], b[db > m])]
    todo += [(a[(da <= m) & (da > m - radius)], b[(db > m) & (db <= m + radius)]), (a[(da > m) & (da <= m + radius)], b[(db <= m) & (db > m - radius)])]


def boundary(d: np.ndarray) -> int | None:
    """The median distance, moved so that both sides have members; None if all are equal."""
    low, high = int(d.min()), int(d.max())
    return None if low == high else min(int(np.median(d)), high - 1)


def link_leaves(fp: np.ndarray, row: np.ndarray, groups: Groups, first: np.ndarray, size: np.ndarray, radius: int) -> None:
    """All pairs of each leaf, of all leaves at once: its i-th row against its i + k-th for k = 1, 2, ..."""
    end = np.repeat(first + size, size)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(end))
    k = 1
    while len(at):
        live = at + k < end
        at, end = at[live], end[live]
        a, b = row[at], row[at + k]
        hit = distance(fp[a], fp[b]) <= radius
        groups.link(a[hit], b[hit])
        k += 1


def parts_of(bits: int, radius: int) -> tuple[list[np.ndarray], int]:
    """A mask of the fingerprint's longs for each part of the bits, and the ball: of two fingerprints within the radius
    one part at least differs in no more bits than that."""
    n = radius // 2 + 1
    out = []
    for at in np.array_split(np.arange(bits), n):
        one = np.zeros(bits, np.uint8)
        one[at] = 1
        out.append(np.frombuffer(np.packbits(one).tobytes(), ">u8").astype(np.uint64))
    return out, radius // n


def cut(counts: np.ndarray, ball: int) -> tuple[np.ndarray, np.ndarray]:
    """The boundary of each node for which the larger side is smallest, and that side's size, given how many members of
    the node lie at each distance. The inner side takes what is at most the ball beyond the boundary."""
    inner = np.cumsum(counts, axis=1)
    size = inner[:, -1:]
    over = np.minimum(np.arange(counts.shape[1]) + ball, counts.shape[1] - 1)
    larger = np.maximum(inner[:, over], size - inner)
    m = larger.argmin(1)
    return m, larger[np.arange(len(m)), m]


class Top:
    """The top of a tree: for each node a vantage point (the masked longs), a boundary, and the nodes of its two sides;
    a shard has none."""

    def __init__(self, sample: np.ndarray, mask: np.ndarray, ball: int, least: int):
        """sample: rows of longs; a node of at most ``least`` of them is a shard."""
        self.mask, self.ball = mask, ball
        points, bounds, sides, todo = [], [], [], [(0, sample & mask)]
        while todo:
            at, own = todo.pop()
            for x in (points, bounds, sides):
                x.extend([None] * (at + 1 - len(x)))
            points[at], bounds[at], sides[at] = np.zeros_like(mask), -1, (-1, -1)
            if len(own) <= least:
                continue
            v = own[(at * 7919) % len(own)]
            d = distance(own, v)
            m, larger = (int(x[0]) for x in cut(np.bincount(d)[None], ball))
            if larger > TELLING * len(own):
                continue
            points[at], bounds[at], sides[at] = v, m, (len(points), len(points) + 1)
            for x in (points, bounds, sides):
                x.extend([None, None])
            todo += [(len(points) - 2, own[d <= m + ball]), (len(points) - 1, own[d > m])]
        self.points, self.bounds, self.sides = np.array(points, np.uint64).reshape(-1, len(mask)), np.array(bounds), np.array(sides)

    def shards(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard): every row of fp once for each of its shards."""
        masked = fp & self.mask
        row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        out = []
        while len(row):
            ended = self.sides[node, 0] < 0
            out.append((row[ended], node[ended]))
            row, node = row[~ended], node[~ended]
            d, m = distance(masked[row], self.points[node]), self.bounds[node]
            inner, outer = d <= m + self.ball, d > m
            row, node = np.concatenate([row[inner], row[outer]]), np.concatenate([self.sides[node[inner], 0], self.sides[node[outer], 1]])
        return tuple(np.concatenate(x) for x in zip(*out))


def leaves(masked: np.ndarray, shard: np.ndarray, ball: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, size) of the leaves of many shards' trees, grown at once level by level: leaf i holds
    row[start[i] : start[i] + size[i]]. masked: the part's bits of each row; shard: its shard, in order."""
    row, node = np.arange(len(shard)), np.cumsum(np.concatenate(([0], shard[1:] != shard[:-1])))
    found, bits, level = [], int(np.bitwise_count(masked).sum(-1).max(initial=0)) * 2 + 1, 0
    while len(row):
        first = starts(node)
        size = np.diff(np.append(first, len(node)))
        place = np.repeat(np.arange(len(first)), size)
        d = distance(masked[row], masked[row[first + (level * 7919) % size]][place])
        level += 1
        m, larger = cut(np.bincount(place * bits + d, minlength=len(first) * bits).reshape(-1, bits), ball)
        ended = (size <= LEAF) | (larger > TELLING * size)
        found += [(row[a : a + n], n) for a, n in zip(first[ended].tolist(), size[ended].tolist())] if ended.any() else []
        live = ~ended[place]
        inner, outer = live & (d <= m[place] + ball), live & (d > m[place])
        row, node = np.concatenate([row[inner], row[outer]]), np.concatenate([2 * place[inner], 2 * place[outer] + 1])
        order = np.argsort(node, kind="stable")
        row, node = row[order], node[order]
    size = np.array([n for _, n in found], np.int64)
    return (np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)), np.cumsum(size) - size, size


def search(fp: np.ndarray, shard: np.ndarray, mask: np.ndarray, groups: Groups, radius: int, ball: int) -> int:
    """Links in groups the rows of shards (in order) that lie within the radius of each other, as far as the tree over
    the part of the bits finds them; how many leaves it had."""
    row, start, size = leaves(fp & mask, shard, ball)
    small = size <= 4 * LEAF
    link_leaves(fp, row, groups, start[small], size[small], radius)
    for a, n in zip(start[~small].tolist(), size[~small].tolist()):
        link_tree(fp, groups, np.sort(row[a : a + n]), radius)
    return len(size)


def sampled(classes: DataFrame, n: int) -> np.ndarray:
    """At most SAMPLE fingerprints of n, drawn by hash."""
    share = min(1.0, SAMPLE / max(1, n))
    rows = classes.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp").limit(SAMPLE).toArrow()
    return longs_of(rows.column("fp"))


def longs_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64)
    return raw.reshape(len(column), -1) if len(column) else raw.reshape(0, 1)


def shard_rows(classes: DataFrame, bits: int, radius: int, shard_size: int = SHARD) -> DataFrame:
    """(part, shard, rep, fp): every class in each tree's shards."""
    spark, n = classes.sparkSession, classes.count()
    masks, ball = parts_of(bits, radius)
    few = sampled(classes, n)
    least = max(LEAF, int(shard_size * len(few) / max(1, n)))
    sent = spark.sparkContext.broadcast([Top(few, mask, ball, least) for mask in masks])  # under SAMPLE nodes a tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = longs_of(b.column(1))
            for part, top in enumerate(sent.value):
                row, shard = top.shards(fp)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), part, np.int32)), pa.array(shard), b.column(0).take(at), b.column(1).take(at)], ["part", "shard", "rep", "fp"])

    return classes.select("rep", "fp").mapInArrow(run, "part int, shard long, rep long, fp binary")


def shard_links(rows: DataFrame, bits: int, radius: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each shard."""
    n = partitions(rows.sparkSession)
    masks, ball = parts_of(bits, radius)
    sizes = written(rows.groupBy("part", "shard").agg(F.count("*").alias("size")).where("size > 1"), "shard-sizes")
    parts = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
    dealt = rows.join(sizes.withColumn("parts", parts), ["part", "shard"])
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    dealt = dealt.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("part", "shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "fp")
    keys = ["part", "shard", "lo", "hi"]

    def process(whole: pa.Table) -> pa.RecordBatch | None:
        cols = [whole.column(k).to_numpy() for k in keys]
        rep, side = whole.column("rep").to_numpy(), whole.column("side").to_numpy()
        fp = longs_of(whole.column("fp"))
        first = starts(*cols)
        shard = np.zeros(len(rep), np.int64)
        shard[first[1:]] = 1
        shard = np.cumsum(shard)
        groups = Groups(len(rep))
        cross = cols[2] != cols[3]
        for part in np.unique(cols[0]).tolist():
            own = np.nonzero((cols[0] == part) & ~cross)[0]
            if len(own):
                local = Groups(len(own))
                search(fp[own], shard[own], masks[part], local, radius, ball)
                groups.link(own, own[local.roots(np.arange(len(own)))])
        for a, b in zip(first.tolist(), np.append(first[1:], len(rep)).tolist()):
            if cross[a]:
                link_tree(fp, groups, np.arange(a, b), radius, side)
        root = groups.roots(np.arange(len(rep)))
        far = rep[root] != rep
        return pa.RecordBatch.from_arrays([pa.array(rep[root[far]]), pa.array(rep[far])], ["a", "b"])

    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(by_group(process, keys, ROWS), "a long, b long")


def near_groups(fps: DataFrame, radius: int = 4, bits: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for the rows of fingerprints(); component_id is the smallest doc_id reachable over
    links of at most ``radius`` differing bits. Texts without words have the zero fingerprint and are linked like any
    other. Repeated ids keep their rows. An empty table gives an empty table."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = shard_links(shard_rows(classes, bits, radius), bits, radius)
    found = components(links)
    named = classes.join(found, classes.rep == found.node, "left").select(F.col("fp").alias("key"), F.coalesce("root", "rep").alias("component_id"))
    named = written(named, "named")
    return fps.join(named, fps.fp == named.key).select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every document."""
    return near_groups(written(fingerprints(docs, width), "fingerprints"), radius)
