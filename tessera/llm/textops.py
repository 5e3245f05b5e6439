"""Words of many texts at once, by numpy over their joined bytes."""

from __future__ import annotations

import numpy as np

MULT = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in bytes; words are runs of anything but ASCII white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, built eight bytes at a time, then mixed."""
    h = np.zeros(len(start), np.uint64)
    if not len(start):
        return h
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = 0
    live = np.arange(len(start))
    with np.errstate(over="ignore"):
        while len(live):
            pos = start[live] + at
            lane = np.zeros(len(live), np.uint64)
            for j in range(8):
                byte = padded[pos + j].astype(np.uint64)
                byte[length[live] <= at + j] = 0
                lane |= byte << np.uint64(8 * j)
            h[live] = mix(h[live] * np.uint64(MULT) + lane + np.uint64(at + 1))
            at += 8
            live = live[length[live] > at]
        return mix(h + length.astype(np.uint64))
