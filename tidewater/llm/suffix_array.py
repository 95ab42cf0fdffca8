"""Suffix arrays by induced sorting, on arrays: what a sequential scan does entry by entry is done here bucket by bucket.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour. Leftmost-smaller (LMS) substrings are sorted
by inducing from their first characters, named, and, where names repeat, ordered as a string of names. From the order of
the LMS suffixes all L-type and then all S-type suffixes are induced. A bucket's entries are taken in waves: a wave's
predecessors in later buckets are appended there in order, those in the same bucket are the next wave.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: What a character stands for in the hashes.
VALUES = np.random.default_rng(5).integers(1, 1 << 63, 1 << 9, np.uint64) | np.uint64(1)


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type; the last character of ``t`` is its only 0."""
    n = len(t)
    rises = np.empty(n, np.int8)
    rises[:-1] = np.sign(t[1:] - t[:-1])
    rises[-1] = 1
    place = np.where(rises != 0, np.arange(n, dtype=np.int32), n)
    place = np.minimum.accumulate(place[::-1])[::-1]  # the next place where the text rises or falls
    return rises[place] > 0


def spread(found: np.ndarray, chars: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append ``found`` to the buckets of its characters, in order."""
    order = np.argsort(chars, kind="stable")
    chars, found = chars[order], found[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for c, part in zip(chars[np.concatenate(([0], cuts))].tolist(), np.split(found, cuts), strict=True):
        buckets[c].append(part)


def waves(first: list[np.ndarray], wanted: np.ndarray, t: np.ndarray, c: int, buckets: list[list[np.ndarray]]) -> None:
    """Induce the predecessors that are ``wanted`` from a bucket's entries, in order, and from what that adds to the bucket."""
    done = 0
    while done < len(first):
        entries = np.concatenate(first[done:]) if len(first) - done > 1 else first[done]
        done = len(first)
        before = entries[entries > 0] - 1
        before = before[wanted[before]]
        if len(before):
            spread(before, t[before], buckets)


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that ``lms``, in order within each first character, induces."""
    larger = ~smaller
    ends: list[list[np.ndarray]] = [[] for _ in range(size)]
    spread(lms, t[lms], ends)
    low: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size):
        waves(low[c], larger, t, c, low)
        if ends[c]:
            before = ends[c][0]
            before = before[before > 0] - 1
            before = before[larger[before]]
            if len(before):
                spread(before, t[before], low)
    high: list[list[np.ndarray]] = [[] for _ in range(size)]  # in falling order
    for c in range(size - 1, -1, -1):
        waves(high[c], smaller, t, c, high)
        if low[c]:
            before = np.concatenate(low[c])[::-1]
            before = before[before > 0] - 1
            before = before[smaller[before]]
            if len(before):
                spread(before, t[before], high)
    out = [np.array([len(t) - 1], np.int32)]  # the terminator, which nothing induces
    for c in range(1, size):
        out += low[c]
        out += [x[::-1] for x in reversed(high[c])]
    return np.concatenate(out)


@functools.lru_cache(4)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hashes' base, and of its inverse, modulo 2 ** 64: 2 ** bits of them."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        power = np.full(1 << bits, base, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power))
    return out[0], out[1]


def prefix_hashes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash modulo 2 ** 64, and powers of its base's inverse."""
    power, inverse = powers(len(t).bit_length())
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUES[t] * power[: len(t)], dtype=np.uint64))), inverse


def substring_hashes(hashes: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums, inverse = hashes
    h = (sums[stop] - sums[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def name_order(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``depth`` names, by doubling; its alphabet is too large for buckets."""
    n = len(names)
    rank, reach = names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == n - 1 or reach >= min(depth, n):
            return order


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of bytes. With ``depth``, suffixes that agree on so many bytes may stand in any order."""
    if not len(data):
        return np.empty(0, np.int32)
    t = np.concatenate((data.astype(np.int16) + 1, np.zeros(1, np.int16)))
    smaller = classify(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    by_first = induce(t, smaller, lms, 257)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    ordered = by_first[is_lms[by_first]]
    # LMS substrings that are equal get one name
    hashes = prefix_hashes(t)
    stop = np.minimum(np.concatenate((lms[1:] + 1, [len(t)])), len(t))
    size, digest = stop - lms, substring_hashes(hashes, lms, stop)
    at = np.empty(len(t), np.int32)
    at[lms] = np.arange(len(lms))
    k = at[ordered]
    new = np.concatenate(([0], np.cumsum((digest[k][1:] != digest[k][:-1]) | (size[k][1:] != size[k][:-1]))))
    if len(new) and new[-1] < len(lms) - 1:
        names = np.empty(len(lms), np.int64)
        names[k] = new
        ordered = lms[name_order(names, len(lms) if depth is None else depth)]
    return induce(t, smaller, ordered, 257)[1:]


def diagonal_prefixes(data: np.ndarray, at: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that are the same from each of two places on, compared eight at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for done in range(0, most, 8):
        x, y = at[live] + done, other[live] + done
        inside = np.minimum(x, y) >= 0
        room = len(data) - np.maximum(x, y)
        live, x, y, room = live[inside & (room > 0)], x[inside & (room > 0)], y[inside & (room > 0)], room[inside & (room > 0)]
        if not len(live):
            break
        differ = eight[x] ^ eight[y]
        lowest = differ & (~differ + np.uint64(1))  # the first bit that differs
        same = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)
        same = np.minimum(same, room)
        out[live] += same
        live = live[same == 8]
    return np.minimum(out, most)


def permuted_prefixes(data: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most`` bytes, of the suffix at each place with the suffix at ``before`` (-1: none), in text order.

    Where a place and its predecessor's lie on one diagonal, the prefix at the predecessor's goes on: a byte is compared for each
    place, and eight at a time only where a diagonal ends.
    """
    if not (n := len(data)):
        return np.empty(0, np.int64)
    at = np.arange(n)
    there = before >= 0
    diagonal = np.where(there, before - at, n + 1)
    same = np.zeros(n, bool)
    same[there] = data[at[there]] == data[before[there]]
    ends = np.flatnonzero(np.concatenate((diagonal[1:] != diagonal[:-1], [True])))  # last places of the diagonals
    end = np.repeat(ends, np.diff(np.concatenate(([-1], ends))))
    has = there[ends]
    tail = np.zeros(len(ends), np.int64)
    tail[has] = diagonal_prefixes(data, ends[has] + 1, ends[has] + 1 + diagonal[ends[has]], most)
    tail = np.repeat(tail, np.diff(np.concatenate(([-1], ends))))
    stop = np.where(same, n, at)  # the next place that differs, itself included
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    reach = np.where(stop <= end, stop - at, end + 1 - at + tail)
    return np.where(there, np.minimum(reach, most), 0)


def permuted_repeats(data: np.ndarray, window: int) -> np.ndarray:
    """Whether the ``window`` bytes from each position also start elsewhere in ``data``, from suffix neighbours' common prefixes.

    Common prefixes are taken in text order (each position against its predecessor in the suffix array), up to ``window``, by bytes.
    """
    n = len(data)
    out = np.zeros(n, bool)
    if n <= window:
        return out
    order = suffix_array(data, window)
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    reach = np.flatnonzero(permuted_prefixes(data, previous, window) >= window)
    out[reach] = True
    out[previous[reach]] = True
    return out
