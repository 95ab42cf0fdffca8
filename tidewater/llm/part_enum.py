"""PartEnum signatures of many sets at once.

A pair is looked for in the band of its larger set; bands double, and a set signs for its own band and, where a partner
could be in the next one, for that too. A band fixes how the domain of shingles is cut: into first-level partitions, and each
of these into ``n2`` parts. Two similar sets differ in at most ``k = floor(size / 3)`` shingles (size of either). So among
any ``k // (k2 + 1) + 1`` first-level partitions there is one in which they differ in ``k2`` parts at most, and they agree there on
a subset of ``n2 - k2`` parts. All such subsets are enumerated, and each is signed with a hash of its shingles.

Empty subsets can't be signed, so a set walks through the partitions in order until it has seen the number above, and a
reserve, of *full* ones, which have more than k2 parts that are not empty: whatever subset of a full partition it agrees on
is not empty. Whichever of two similar sets stops first shares a signature with the other from each of its full partitions
but ``k // (k2 + 1)``. ``needed`` states that least number. It is 0 for the few sets that have too few full partitions; only a
pair of two such sets can go without a shared signature.

Sets up to ``SMALL`` have k2 = 0 and n2 = 1 (partitions of hardly more than one shingle), larger ones k2 = 1 and n2 = 3.
"""

from __future__ import annotations

import numpy as np

from tidewater.llm.shingle_sets import mixed

#: Similarity as a fraction; size up to which partitions are not cut; shingles a partition beyond it in a set of a band's largest size.
SIMILAR, SMALL, FULLNESS = (3, 4), 256, 4
G = np.uint64(0x9E3779B97F4A7C15)


def most_different(sizes: np.ndarray) -> np.ndarray:
    """Shingles in which a set of this size and a similar one can differ."""
    return sizes * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[0]


def reserve(sizes: np.ndarray) -> np.ndarray:
    """Full partitions beyond those that must be seen."""
    return np.where(sizes <= SMALL, sizes // 4, sizes // 32)


def bands_of(sizes: np.ndarray) -> np.ndarray:
    """Bands hold sizes of up to 2 ** band."""
    return np.ceil(np.log2(np.maximum(sizes, 1)) - 1e-12).astype(np.int64)


def band_signatures(flat: np.ndarray, counts: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets that all are of uncut or all of cut bands; the set of each; and ``needed`` of each set.

    ``flat`` holds the shingles of the sets one after the other and ``counts`` their sizes.
    """
    sets, largest = len(counts), np.left_shift(1, bands)
    cut = bool(largest[0] > SMALL)
    n2 = 3 if cut else 1
    n1 = largest // FULLNESS if cut else np.where(largest <= 32, 8, 2) * largest
    first = np.concatenate(([0], np.cumsum(n1)))
    of = np.repeat(np.arange(sets), counts)
    place = mixed(flat, 0x1234567)
    cell = first[of] + (place % n1[of].astype(np.uint64)).astype(np.int64)
    if cut:
        cell = cell * 3 + ((place >> np.uint64(40)) % np.uint64(3)).astype(np.int64)
    # what a cell holds: the sum of 40 bits of its shingles, exact in a float
    held = np.bincount(cell, (mixed(flat, 0x7654321) >> np.uint64(24)).astype(np.float64) + 1, first[-1] * n2).astype(np.uint64).reshape(-1, n2)
    full = (held > 0).sum(1) > (1 if cut else 0)
    seen = np.concatenate(([0], np.cumsum(full)))
    owner = np.repeat(np.arange(sets), n1)
    enough = most_different(counts) // (2 if cut else 1) + 1
    taken = np.flatnonzero(seen[:-1] - seen[first[:-1]][owner] < (enough + reserve(counts))[owner])
    held, owner = held[taken], owner[taken]
    salt = (taken - first[owner]).astype(np.uint64) * G + bands[owner].astype(np.uint64)
    if cut:  # subsets of two of the three parts; with one part that is not empty they are the same
        parts = held > 0
        several = parts.sum(1) > 1
        wanted = np.stack([parts[:, 0] | parts[:, 1] & ~several, parts[:, 1] & several | parts[:, 2], (parts[:, 0] | parts[:, 2]) & several], 1)
        wanted[~several] &= parts[~several].any(1)[:, None]
        wanted[~several, 0] |= parts[~several, 2]
        wanted[~several, 1:] = False
        wanted[several] = True
        subsets = np.stack([held[:, 0] + held[:, 1], held[:, 1] + held[:, 2], held[:, 0] + held[:, 2]], 1)
        subsets[~several, 0] = held[~several].sum(1)
        signed = wanted
        sigs = mixed(subsets[signed] * G + np.repeat(salt, 3).reshape(-1, 3)[signed], 0xA5A5A5A5)
        whose = np.repeat(owner, 3).reshape(-1, 3)[signed]
    else:
        signed = held[:, 0] > 0
        sigs, whose = mixed(held[signed, 0] * G + salt[signed], 0xA5A5A5A5), owner[signed]
    had = np.minimum(seen[first[1:]] - seen[first[:-1]], enough + reserve(counts))
    partner = -(-counts * SIMILAR[0] // SIMILAR[1])  # the least size of a similar set, which may stop first
    needed = np.minimum(had - (enough - 1), reserve(partner) + 1)
    return sigs, whose, np.maximum(needed, 0)


def signatures(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (``flat`` between ``offsets``), the set of each, and ``needed`` of each set, the least over its bands."""
    sizes = np.diff(offsets)
    k = most_different(sizes)
    needed = np.full(len(sizes), np.iinfo(np.int64).max)
    sigs, whose = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    own, top = bands_of(sizes), bands_of(sizes * SIMILAR[1] // SIMILAR[0])
    for bands, signs in ((own, k > 0), (top, (k > 0) & (top > own))):  # k = 0: only an equal set is similar
        for cut in (False, True):
            rows = np.flatnonzero(signs & ((np.left_shift(1, bands) > SMALL) == cut))
            if len(rows):
                part = np.concatenate([flat[a:b] for a, b in zip(offsets[rows].tolist(), offsets[rows + 1].tolist(), strict=True)])
                s, w, m = band_signatures(part, sizes[rows], bands[rows])
                sigs.append(s)
                whose.append(rows[w])
                needed[rows] = np.minimum(needed[rows], m)
    return np.concatenate(sigs), np.concatenate(whose), needed
