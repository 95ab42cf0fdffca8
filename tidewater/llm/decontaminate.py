"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``min_match`` words that a text shares with a test item; texts join items on their seeds. Pairs whose seeds
could cover enough of the item are tiled: Karp-Rabin hashes of windows run over the unmarked words of both sides, at lengths
that fall from the longest that matches, and each match is marked on both sides, until none of ``min_match`` words is left. The
share of the item's words under such tiles catches passages whose parts are reordered or broken up by other text.

The items are the query set. They are taken in blocks of a stated size (``block_bytes`` of item text), each against all texts,
and one block is alive at a time, on the driver as in the workers; a block is held as flat arrays. No text is shuffled but
where several blocks drop rows of documents, and then rows are dropped by number.

Defined cases: words are runs of letters, digits and non-ASCII characters, lower-cased, and are equal if their 64-bit hashes
are; an item of fewer than ``min_match`` words is matched by all its words, in one tile; null texts and items, and those without
words, match nothing; items or texts that repeat each give their own pairs; other columns are ignored; empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm.shared import drop_rows, free_name, give_back, materialise, row_ids, sliced
from tidewater.llm.shingle_sets import mixed, word_hashes

#: Words of the shortest tile; least share of an item's words under tiles; item text in a block.
MIN_MATCH, LEAST_COVER, BLOCK_BYTES = 5, 0.5, 4 << 20
#: Non-word ASCII bytes become spaces.
SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Odd multiplier of the Karp-Rabin hashes, modulo 2 ** 64. Words are compared themselves after a hash matches.
BASE = 0x9E3779B97F4A7C15


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's begin."""
    return word_hashes([t.lower().encode("utf-8", "replace") for t in texts], SPACED)


class Runner:
    """Karp-Rabin hashes of the windows of one word sequence, of any length, from prefix sums."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.free = ids, np.ones(len(ids), bool)
        power = np.full(len(ids) + 1, BASE, np.uint64)
        inverse = np.full(len(ids) + 1, pow(BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        power, self.inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(ids.astype(np.uint64), 0x77) * power[:-1], dtype=np.uint64)))
        self.mark(0, 0)

    def mark(self, start: int, n: int) -> None:
        self.free[start : start + n] = False
        self.taken = np.concatenate(([0], np.cumsum(~self.free)))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of n unmarked words, and their hashes."""
        if len(self.ids) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.taken[n:] == self.taken[:-n])
        return at, (self.sums[at + n] - self.sums[at]) * self.inverse[at]


def first_match(item: Runner, text: Runner, n: int) -> tuple[int, int] | None:
    """The earliest unmarked window of n words in the item that the text has too, and where it has it first."""
    (qs, hq), (ps, hp) = item.windows(n), text.windows(n)
    for k in np.flatnonzero(np.isin(hq, hp)).tolist():
        q = int(qs[k])
        for p in ps[hp == hq[k]].tolist():
            if np.array_equal(item.ids[q : q + n], text.ids[p : p + n]):
                return q, p
    return None


def tiles(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, text start, length), longest first, earliest in the item of equals.

    A prefix of a match is a match, so the longest length is found by halving; lengths never rise from tile to tile.
    """
    q, p = Runner(item), Runner(text)
    out: list[tuple[int, int, int]] = []
    most = min(len(item), len(text))
    while most >= min_match:
        low, high, found = min_match - 1, most, None
        while low < high:
            n = high if not out and high == most or out and high == out[-1][2] else (low + high + 1) // 2  # what was longest may be so again
            if match := first_match(q, p, n):
                low, found = n, (*match, n)
            else:
                high = n - 1
        if found is None:
            return out
        out.append(found)
        most = found[2]
        q.mark(found[0], most)
        p.mark(found[1], most)
    return out


@dataclass
class Block:
    """Test items of one block: words of all items one after the other, and their seeds by hash."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    min_match: int
    least_cover: float

    @classmethod
    def of(cls, items: list[tuple[object, str]], min_match: int, least_cover: float) -> Block:
        each, first = words([t for _, t in items])
        sizes = np.diff(first)
        seeds = {}
        for n in sorted({min(min_match, s) for s in sizes.tolist() if s}):
            whole = sizes >= min_match if n == min_match else sizes == n
            at, h = Runner(each).windows(n)
            owner = np.searchsorted(first, at, "right") - 1
            keep = whole[owner] & (at + n <= first[owner + 1])
            order = np.argsort(h[keep], kind="stable")
            seeds[n] = (h[keep][order], owner[keep][order], (at - first[owner])[keep][order])
        return cls([i for i, _ in items], each, first, seeds, min_match, least_cover)

    def find_all(self, texts: list[str]) -> Iterator[tuple[int, object, float, int]]:
        """(place of the text, item id, share of its words under tiles, tiles) of each item that a text covers enough of."""
        each, first = words(texts)
        runner = Runner(each)
        for n, (seeds, items, places) in self.seeds.items():
            at, h = runner.windows(n)
            if not len(at) or not len(seeds):
                continue
            hit = seeds[np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)] == h
            at, h = at[hit], h[hit]
            owner = np.searchsorted(first, at, "right") - 1
            inside = at + n <= first[owner + 1]
            at, h, owner = at[inside], h[inside], owner[inside]
            for k in np.unique(owner).tolist():
                mine = owner == k
                yield from ((k, *x) for x in self.tiled(each, n, at[mine], h[mine], seeds, items, places))

    def tiled(self, each: np.ndarray, n: int, at: np.ndarray, h: np.ndarray, seeds: np.ndarray, items: np.ndarray, places: np.ndarray) -> Iterator[tuple[object, float, int]]:
        """Of one text, whose seeds stand at ``at``."""
        shared = np.unique(h)
        low, high = np.searchsorted(seeds, shared, "left"), np.searchsorted(seeds, shared, "right")
        found = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        which = items[found]
        for i in np.unique(which).tolist():
            item = self.words[self.first[i] : self.first[i + 1]]
            own = found[which == i]
            under = np.zeros(len(item) + 1, np.int64)
            np.add.at(under, places[own], 1)
            np.add.at(under, places[own] + n, -1)
            if (np.cumsum(under) > 0).sum() < self.least_cover * len(item):
                continue
            starts = at[np.isin(h, seeds[own])]
            spots = np.unique((starts[:, None] + np.arange(n)).ravel())
            gaps = np.flatnonzero(np.diff(spots) > 1) + 1  # only the parts with seeds; a word that no item has keeps them apart
            made = tiles(item, np.insert(each[spots], gaps, self.stranger(item)), n)
            if (covered := sum(x[2] for x in made)) >= self.least_cover * len(item):
                yield self.ids[i], covered / len(item), len(made)

    @staticmethod
    def stranger(item: np.ndarray) -> np.uint64:
        """A word hash that the item has not."""
        return np.setdiff1d(np.arange(len(item) + 1, dtype=np.uint64), item)[0]


def blocks_of(items: DataFrame, min_match: int, least_cover: float, block_bytes: int) -> tuple[int, Iterator[Block]]:
    """Of items (item_id, t), the number of blocks of about ``block_bytes`` of text, and the blocks, made one at a time."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = total // block_bytes + 1
    dealt = items.withColumn("k", F.pmod(F.xxhash64("t", "item_id"), F.lit(blocks)))
    used = sorted(r.k for r in dealt.select("k").distinct().collect()) if blocks > 1 else [0]  # a row a block
    rows = lambda k: dealt.where(F.col("k") == k).collect()
    return blocks, (Block.of([(r.item_id, r.t) for r in rows(k)], min_match, least_cover) for k in used)


def item_rows(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t")).where("t IS NOT NULL")


def against(rows: DataFrame, block: Block, item_type) -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles`` of rows (doc_id, t) and the items of one block."""
    kind = to_arrow_type(item_type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "t"):
            found = list(block.find_all(b.column("t").to_pylist()))
            columns = [pa.array([x[k] for x in found], t) for k, t in ((1, kind), (2, pa.float64()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())), *columns], names=["doc_id", "item_id", "coverage", "n_tiles"])
        give_back()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, coverage double, n_tiles long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, least_cover: float = LEAST_COVER, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles`` of each text and item whose tiles cover ``least_cover`` of the item's words."""
    items = item_rows(benchmark, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    _, blocks = blocks_of(items, min_match, least_cover, block_bytes)
    return reduce(DataFrame.unionByName, (materialise(against(rows, block, items.schema["item_id"].dataType), "contaminated") for block in blocks))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, least_cover: float = LEAST_COVER, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text contains an item: one pass over the texts for each block of items, of equal items one."""
    items = item_rows(benchmark, item_col, item_text_col).groupBy("t").agg(F.min("item_id").alias("item_id"))
    _, blocks = blocks_of(items, min_match, least_cover, block_bytes)
    number = free_name(docs, "row")
    rows = row_ids(docs, id_col, number)
    texts = rows.select(F.col(number).alias("doc_id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    found = [materialise(against(texts, block, items.schema["item_id"].dataType).select(F.col("doc_id").alias(number)), "contaminated") for block in blocks]
    return drop_rows(rows, materialise(reduce(DataFrame.union, found).distinct(), "contaminated"), number)
