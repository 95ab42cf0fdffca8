"""Word-shingle sets of many texts at once, as flat arrays: no Python runs for each word."""

from __future__ import annotations

import numpy as np
import xxhash

from tidewater.llm.shared import LOWER, UPPER

#: Lower-cases A-Z and makes the other white space bytes blanks.
FOLD = bytes.maketrans((UPPER + "\t\n\v\f\r").encode(), (LOWER + " " * 5).encode())
#: Masks of the first k bytes of eight; bytes from which a word is hashed on its own.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
LONG_WORD = 64
STEP, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> TURN)) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes], fold: bytes = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's begin (one entry more than texts).

    Words are what lies between blanks once bytes are replaced by ``fold``.
    """
    raw = b" " + b" ".join(texts).translate(fold) + b" " * 9
    data = np.frombuffer(raw, np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    h = (eight[starts] & FIRST[np.minimum(sizes, 8)]) * STEP + sizes.astype(np.uint64)
    at, done = np.flatnonzero((sizes > 8) & (sizes < LONG_WORD)), 8
    while len(at):
        h[at] = (h[at] ^ (h[at] >> TURN)) * STEP + (eight[starts[at] + done] & FIRST[np.minimum(sizes[at] - done, 8)])
        done += 8
        at = at[sizes[at] > done]
    for k in np.flatnonzero(sizes >= LONG_WORD).tolist():
        h[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + sizes[k]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mixed(h, 0x3C6EF372), np.concatenate(([0], np.searchsorted(starts, ends)))


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, one text after the other, and where each text's begin.

    A text of fewer than n words has its whole sequence as one shingle, one without words none.
    """
    h, first = word_hashes(texts)
    words = np.diff(first)
    counts = np.where(words >= n, words - n + 1, words > 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    flat = np.empty(offsets[-1], np.uint64)
    short = np.flatnonzero((words > 0) & (words < n))
    whole = np.ones(len(flat), bool)
    whole[offsets[short]] = False
    if len(h) >= n:
        rolled = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            rolled = rolled * STEP + h[k : len(h) - n + 1 + k]
        fits = np.arange(len(rolled)) + n <= np.repeat(first[1:], words)[: len(rolled)]
        flat[whole] = rolled[fits]
    for k in short.tolist():
        value = int(words[k])
        for x in h[first[k] : first[k + 1]].tolist():
            value = (value * int(STEP) + x) & 0xFFFFFFFFFFFFFFFF
        flat[offsets[k]] = value
    flat = mixed(flat, 0x2545F491)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[offsets[:-1][counts > 0]] = True
    return flat[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of the values between neighbouring offsets, modulo 2 ** 64."""
    return np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))[offsets])
