"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

A model file is read for its pieces, normalizer flags and byte pieces. A text is escaped (a leading blank is added,
blanks become the marker U+2581), and the best segmentation is the one whose pieces' log scores add up to most; a
character that no piece covers alone may be an unknown, at the least score less 10, and is then spelled by byte pieces.
Ties go to the earlier start, as float32 sums have it.

No piece of such a model holds a marker after other characters, nor a line feed, so no piece crosses the start of a
marked word or a line's end: the best segmentation of a text is that of its words, one after another. Words are looked
up in a bounded cache; new ones are segmented many at a time, all byte positions walking down the trie together.

Scores: ``rank`` takes the pieces' own. Those of a merge-ordered vocabulary are minus their ranks, which are no log
probabilities: ``zipf`` makes them the logarithms of 1 / (rank + 1), normalized. Tokenizers are not trained.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import trim

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
CACHE = 300_000
RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield key >> 3, raw[at : at + n]
            at += n


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    dummy_prefix: bool
    byte_fallback: bool


def read_model(path: str, scores: str = "zipf") -> Vocabulary:
    """A vocabulary from a model file. Models that fold characters or white space, or have pieces set by a user, are refused."""
    raw = open(path, "rb").read()
    pieces, own, kinds = [], [], []
    dummy, squeeze, folds, fallback = True, True, b"", False
    for number, value in fields(raw):
        if number == 1:
            piece = dict(fields(value))
            pieces.append(piece.get(1, b"").decode())
            own.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            fallback = bool(dict(fields(value)).get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            folds, dummy, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    normal = [i for i, k in enumerate(kinds) if k == NORMAL]
    if folds or squeeze or USER in kinds:
        raise ValueError("this model's normalizer or user-defined pieces are not supported")
    if any(MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i] for i in normal):
        raise ValueError("a piece crosses words or lines")
    s = np.array(own, np.float32)
    if scores == "zipf":
        order = sorted(normal, key=lambda i: (-s[i], i))
        p = 1 / np.arange(1, len(order) + 1)
        s[order] = np.log(p / p.sum()).astype(np.float32)
    return Vocabulary(pieces, s, kinds, dummy, fallback)


class Trie:
    """A double array over bytes: the child of state s by byte b is t = base[s] + b + 1, if check[t] is s."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free, hint = 257, 1  # where single and several children are sought from
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(keys[lo][0]) == depth:
                value[state] = keys[lo][1]
                lo += 1
            if lo == hi:
                continue
            kids, at = [], lo
            while at < hi:
                b, first = keys[at][0][depth], at
                while at < hi and keys[at][0][depth] == b:
                    at += 1
                kids.append((b, first, at))
            if len(check) - max(free, hint) < 4096:
                for x, f in ((base, 0), (check, -1), (value, -1)):
                    x.extend([f] * size)
            while check[free] >= 0:
                free += 1
            if len(kids) == 1:
                start = free - kids[0][0] - 1
            else:
                start = hint
                while any(check[start + k + 1] >= 0 for k, _, _ in kids):
                    start += 1
                hint += (start - hint + 1) // 2  # moves on where it is crowded
                if len(check) - start < 1024:
                    for x, f in ((base, 0), (check, -1), (value, -1)):
                        x.extend([f] * size)
            base[state] = start
            for k, first, end in kids:
                check[start + k + 1] = state
                todo.append((start + k + 1, first, end, depth + 1))
        last = max(i for i, c in enumerate(check) if c >= 0) + 258
        pad = max(0, last - len(check))
        self.base, self.check, self.value = (np.array((x + [f] * pad)[:last], np.int32) for x, f in ((base, 0), (check, -1), (value, -1)))
        self.check[0] = -1

    def matches(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, value) of all keys found at the positions, none reaching beyond its end."""
        state, pos, depth = np.zeros(len(at), np.int64), at, 0
        out: list[tuple] = []
        while len(pos):
            live = pos + depth < end
            pos, end, state = pos[live], end[live], state[live]
            nxt = self.base[state] + data[pos + depth].astype(np.int64) + 1
            ok = self.check[nxt] == state
            pos, end, state = pos[ok], end[ok], nxt[ok]
            depth += 1
            v = self.value[state]
            hit = v >= 0
            out.append((pos[hit], np.full(int(hit.sum()), depth), v[hit]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        normal = [i for i, k in enumerate(v.kinds) if k == NORMAL]
        self.trie = Trie([(v.pieces[i].encode(), i) for i in normal])
        self.unknown = np.float32(v.scores[normal].min() - np.float32(UNKNOWN_PENALTY))
        self.unknown_id = v.kinds.index(UNKNOWN)
        self.byte_ids = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == BYTE} if v.byte_fallback else {}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k == NORMAL else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(v.pieces, v.kinds)]
        self.known: dict[str, bytes] = {}

    def segment(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by Viterbi over all of them together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        end = np.cumsum(size)
        first = end - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        heads = np.nonzero((data & 0xC0) != 0x80)[0]
        own = np.repeat(np.arange(len(raw)), size)
        start, length, piece = self.trie.matches(data, heads, end[own[heads]])
        wide = np.diff(np.append(heads, len(data)))
        alone = np.zeros(len(data), bool)
        char = np.zeros(len(data), np.int64)
        char[heads] = wide
        alone[start[length == char[start]]] = True
        lost = heads[~alone[heads]]
        start, length = np.concatenate([start, lost]), np.concatenate([length, char[lost]])
        piece = np.concatenate([piece, np.full(len(lost), -1)])
        score = np.where(piece >= 0, self.vocabulary.scores[piece], self.unknown).astype(np.float32)
        place = start - first[own[start]]
        order = np.lexsort((length, place))
        start, length, piece, score, place = start[order], length[order], piece[order], score[order], place[order]
        # position p + word: each word has a node more than bytes
        node = start + own[start]
        best = np.full(len(data) + len(raw), -np.inf, np.float32)
        best[first + np.arange(len(raw))] = 0
        back, by = np.zeros(len(best), np.int64), np.full(len(best), -2)
        cuts = np.searchsorted(place, np.arange(int(size.max(initial=0)) + 1))
        for a, b in zip(cuts, np.append(cuts[1:], len(place))):
            if a < b:
                # of one start all ends differ, so no two rows of a step write to one node
                to, value = node[a:b] + length[a:b], best[node[a:b]] + score[a:b]
                more = value > best[to]
                to, rows = to[more], np.arange(a, b)[more]
                best[to], back[to], by[to] = value[more], node[rows], piece[rows]
        out, back_, by_, byte_ids = [], back.tolist(), by.tolist(), self.byte_ids
        for k, (a, b) in enumerate(zip((first + np.arange(len(raw))).tolist(), (end + np.arange(len(raw))).tolist())):
            ids: list[int] = []
            while b > a:
                p = by_[b]
                if p >= 0:
                    ids.append(p)
                elif byte_ids:
                    ids += [byte_ids[x] for x in raw[k][back_[b] - a : b - a][::-1]]
                else:
                    ids.append(self.unknown_id)
                b = back_[b]
            out.append(ids[::-1])
        return out

    def words(self, text: str) -> list[str]:
        """The words of an escaped text, line feeds as words of their own; joined they are the text again."""
        if not text:
            return []
        text = (" " if self.vocabulary.dummy_prefix else "") + text
        out: list[str] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append("\n")
            if "  " in line or MARK in line or line[-1:] == " ":
                out += RUN.findall(line.replace(" ", MARK))
            elif line:
                head, *rest = line.split(" ")
                if head:
                    out.append(head)
                out += [MARK + w for w in rest]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; none for null and empty ones."""
        words = self.words(text or "")
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = list(dict.fromkeys(words))
            short = [w for w in fresh if len(w) <= 64]
            long = [w for w in fresh if len(w) > 64]
            for group in [short[i : i + 20_000] for i in range(0, len(short), 20_000)] + [[w] for w in long]:
                for w, ids in zip(group, self.segment(group)):
                    known[w] = np.array(ids, "<u4").tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")

    def prepare(self, texts: list[str | None]) -> None:
        """Segments the new words of many texts at once."""
        fresh: dict[str, None] = {}
        for t in texts:
            fresh.update(dict.fromkeys(w for w in self.words(t or "") if w not in self.known and len(w) <= 64))
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
        new = list(fresh)
        for i in range(0, len(new), 20_000):
            for w, ids in zip(new[i : i + 20_000], self.segment(new[i : i + 20_000])):
                self.known[w] = np.array(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: markers become blanks, the added one goes, bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.dummy_prefix and text[:1] == " " else text


def tokenized(docs: DataFrame, path: str, scores: str = "zipf", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_bytes, round_trip, ids) of every document: the whole text is encoded and decoded.

    n_bytes counts byte pieces; round_trip says whether decoding gave the text again (a literal U+2581 reads as a blank).
    Null and empty texts have no ids. Repeated and null ids of documents keep their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or Codec(read_model(path, scores))
            byte = np.zeros(len(codec.vocabulary.pieces), np.int64)
            byte[list(codec.byte_ids.values())] = 1
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column(1).to_pylist()
                codec.prepare(texts)
                ids = [codec.encode(t) for t in texts]
                flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
                cols = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    pa.array([int(byte[x].sum()) for x in ids], pa.int64()),
                    pa.array([codec.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts)]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(flat)),
                ]
                yield pa.RecordBatch.from_arrays(cols if with_ids else cols[:-1], ["doc_id", "n_tokens", "ids_crc32", "n_bytes", "round_trip", "ids"][: len(cols) if with_ids else -1])
        codec = None
        trim()

    kind = "doc_id long, n_tokens long, ids_crc32 long, n_bytes long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)
