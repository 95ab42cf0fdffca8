"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A piece's halves are encoded recursively. Two encodings join by a window at the seam: what the two tokens there encode to.
It grows on either side by joining it with the token beside it, until it is compatible with its neighbours (encoding two
tokens gives just the two). Then every two neighbouring tokens of the result are compatible, and the sequence with that
property is the encoding, so tokens outside the window cannot change. A window that has grown by ``STEPS`` tokens, or
joins in joins as deep, is encoded anew from its bytes, twice as large each time. Decoding halves the ids and concatenates
byte strings up the tree. Every piece that is no token of its own goes through the tree, down to leaves of
``LEAF_BYTES``; pieces that were met before are looked up.

Defined cases: a null text counts as empty (no ids, decoded to no bytes); ids that the vocabulary lacks raise; rows are
independent; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.bpe import plain_split, tiktoken_ranks
from tidewater.llm.shared import give_back, sliced

#: Bytes of a leaf in encoding, and ids of one in decoding.
LEAF_BYTES, LEAF_IDS = 2, 64
#: Pieces of up to so many characters kept by a worker, in each of two generations: at most some 130 MB. A worker keeps them from
#: task to task until it runs another operator; Spark ends workers that are idle for a minute.
KEEP_FRAGMENTS, KEEP_CHARS = 320_000, 64
#: Windows of two tokens and halves kept by a worker, and bytes of the longest half that is kept.
KEEP_PAIRS, KEEP_HALVES = 250_000, 6
#: Windows encoded anew that are kept by a worker: at most some 30 MB.
KEEP_WINDOWS = 100_000
#: Tokens by which a window grows one by one, and joins within joins.
STEPS = 4
#: Bytes that are merged without a heap; a rank that no token has.
SHORT_BYTES, NEVER = 24, 1 << 60


def merge(data: bytes, ranks: dict[bytes, int], first: list[int]) -> list[int]:
    """Lowest-ranked neighbours merge first, the leftmost of equals: short data by looking for the least rank, else by a heap over a linked list.

    ``first`` holds the ranks of two bytes a, b at 256 a + b.
    """
    n = len(data)
    if n <= SHORT_BYTES:
        parts = [data[i : i + 1] for i in range(n)]
        each, rank = [first[a << 8 | b] for a, b in pairwise(data)], ranks.get
        while each and (least := min(each)) < NEVER:
            i = each.index(least)
            del each[i]
            grown = parts[i] = parts[i] + parts.pop(i + 1)
            if i:
                each[i - 1] = rank(parts[i - 1] + grown, NEVER)
            if i < len(each):
                each[i] = rank(grown + parts[i + 1], NEVER)
        return [ranks[x] for x in parts]
    after, before, end = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if j >= n or end[i] != j or end[j] != stop:
            continue
        k = after[j]
        after[i], end[i], end[j] = k, stop, -1
        before[k] = i
        if k < n and (r := ranks.get(data[i : end[k]])) is not None:
            heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = after[i]
    return out


class Codec:
    def __init__(self, path: str):
        self.ranks = tiktoken_ranks(path)
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.first = [self.ranks.get(bytes(divmod(k, 256)), NEVER) for k in range(1 << 16)]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, list[int] | None] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.windows: dict[bytes, list[int]] = {}

    def window(self, left: list[int], right: list[int]) -> list[int]:
        """The two sides' bytes encoded anew; short windows are kept."""
        data = self.decode(left + right)
        if len(data) > SHORT_BYTES:
            return merge(data, self.ranks, self.first)
        if (found := self.windows.get(data)) is None:
            if len(self.windows) >= KEEP_WINDOWS:
                self.windows.clear()
            found = self.windows[data] = merge(data, self.ranks, self.first)
        return found

    def seam(self, a: int, b: int) -> list[int] | None:
        """What two tokens' bytes encode to, None if to just the two. Kept by the tokens."""
        if (found := self.pairs.get(a << 32 | b, NEVER)) is NEVER:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            found = merge(self.bytes_of[a] + self.bytes_of[b], self.ranks, self.first)
            found = self.pairs[a << 32 | b] = None if found == [a, b] else found
        return found

    def join(self, left: list[int], right: list[int], depth: int = 0) -> list[int]:
        if not left or not right or (window := self.seam(left[-1], right[0])) is None:
            return left + right
        if depth >= STEPS:
            return self.window(left, right)
        n, m, i, j = len(left), len(right), 1, 1
        for _ in range(STEPS):
            if i < n and window[0] != left[-i] and (more := self.seam(left[-i - 1], window[0])) is not None:
                i, window = i + 1, self.join(more, window[1:], depth + 1)
            elif j < m and window[-1] != right[j - 1] and (more := self.seam(window[-1], right[j])) is not None:
                j, window = j + 1, self.join(window[:-1], more, depth + 1)
            else:
                return left[:-i] + window + right[j:]
        while True:
            loose_left = i < n and window[0] != left[-i]
            loose_right = j < m and window[-1] != right[j - 1]
            if not loose_left and not loose_right:
                return left[:-i] + window + right[j:]
            i, j = min(n, i * 2) if loose_left else i, min(m, j * 2) if loose_right else j
            window = self.window(left[-i:], right[:j])

    def reduce(self, data: bytes) -> list[int]:
        n = len(data)
        if n <= LEAF_BYTES and (r := self.ranks.get(data)) is not None:
            return [r]
        if n > KEEP_HALVES:
            return self.join(self.reduce(data[: n // 2]), self.reduce(data[n // 2 :]))
        if (found := self.halves.get(data)) is None:
            if len(self.halves) >= KEEP_PAIRS:
                self.halves.clear()
            middle = n // 2
            found = self.halves[data] = self.join(self.reduce(data[:middle]), self.reduce(data[middle:])) if middle else merge(data, self.ranks, self.first)
        return found

    def keep(self, text: str, ids: bytes) -> bytes:
        """A full generation becomes the older one, from which what is met again comes back."""
        if len(text) <= KEEP_CHARS:
            if len(self.kept) >= KEEP_FRAGMENTS:
                self.kept, self.older = {}, self.kept
            self.kept[text] = ids
        return ids

    def piece(self, text: str) -> bytes:
        """Ids as int32 bytes."""
        if (found := self.kept.get(text)) is not None:
            return found
        if (found := self.older.get(text)) is None:
            data = text.encode()
            r = self.ranks.get(data)
            found = array("i", self.reduce(data) if r is None else (r,)).tobytes()
        return self.keep(text, found)

    def encode(self, text: str) -> np.ndarray:
        pieces = plain_split(text)
        found = [x or self.piece(t) for x, t in zip(map(self.kept.get, pieces), pieces, strict=True)]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def ids_column(coder: Codec, texts: list[str | None]) -> pa.ListArray:
    each = [coder.encode(x) if x else np.empty(0, np.int32) for x in texts]
    offsets = np.fromiter(accumulate(map(len, each), initial=0), np.int32, len(each) + 1)
    return pa.ListArray.from_arrays(offsets, np.concatenate(each) if each else np.empty(0, np.int32))


def decoded_column(coder: Codec, ids: pa.ListArray) -> pa.Array:
    values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    return pa.array([coder.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``doc_id, ids array<int>`` per row, by a rank file (.tiktoken) that every executor has; with ``decode`` also ``decoded binary``.

    Decoding in the same pass spares a second worker for each core and the way of the ids to it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in sliced(batches, "t"):
            ids = ids_column(coder, batch.column("t").to_pylist())
            more = [decoded_column(coder, ids)] if decode else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, *more], names=["doc_id", "ids", "decoded"][: 2 + decode])
        give_back("codec", codec.cache_clear)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded binary" * decode)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds ``decoded binary`` to rows of ``doc_id, ids``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in batches:
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded_column(coder, ids)], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
