"""Removal of repeated byte strings by suffix arrays over shards.

Which shard a string belongs to follows from its bytes: the least hash of its 32-byte grams. Neighbouring windows of
``window`` bytes whose leftmost least gram is the same one form a stretch; equal windows have equal keys and, unless they are
one window, lie in different stretches, so every repeat is one between stretches of a key.
A stretch whose whole text repeats is decided by counts (combined before their shuffle). Where a key has stretches of
different text, one of each text goes to the key's shard, whose suffix array (induced sorting) and common prefixes with
suffix neighbours, compared by bytes in text order, show the windows that repeat. Whole stretches are equal if key and text
hash, of 64 bits each and computed apart, are. A key with more such texts than a shard should hold is
decided window by window, by counting hashes of windows, which spreads it over all tasks.

Defined cases: null texts count as empty; texts under ``window`` bytes are kept; rows are told apart by id, or by a number where ids
are null, negative or repeat, so that such rows count as texts of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import MAX_BROADCAST_ROWS, materialise, row_ids, sized, sliced
from tidewater.llm.suffix_array import permuted_repeats, prefix_hashes, substring_hashes

#: Bytes of a repeated string; bytes of the grams that make keys; bytes of a shard; texts of a key that one shard takes.
WINDOW, GRAM, SHARD_BYTES, SHARD_TEXTS = 200, 32, 2 << 20, 4000
#: Bits that hold any place in a text.
PLACE_BITS = np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-byte grams (n a power of two), by doubling."""
    h, size = mixed(data.astype(np.uint64) + np.uint64(0x51ED2701)), 1
    while size < n:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:]
        size *= 2
    return mixed(h)


def sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """Place of the minimum of every n neighbours by the hashes' upper bits, the leftmost of equals, by doubling.

    The lower bits give way to the place, so that one minimum finds both; as many in every text, so that equal windows agree.
    """
    least, size = h >> PLACE_BITS << PLACE_BITS | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= n:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if n > size:
        least = np.minimum(least[: len(least) - (n - size)], least[n - size :])
    return (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)


def stretches(data: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(key, first window, windows, text hash) of each stretch."""
    gram = min(GRAM, 1 << (window.bit_length() - 2))
    if len(data) < window:
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int64))
    grams = gram_hashes(data, gram)
    place = sliding_least(grams, window - gram + 1)
    lo = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    hi = np.concatenate((lo[1:], [len(place)]))
    text = substring_hashes(prefix_hashes(data), lo, hi + window - 1)
    return grams[place[lo]].astype(np.int64), lo.astype(np.int32), (hi - lo).astype(np.int32), text.astype(np.int64)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true flags."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def stretch_table(docs: DataFrame, window: int) -> DataFrame:
    """``key, doc, lo, n, text``: the stretches of all rows (doc, t)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            docs, texts = batch.column("doc").to_numpy(), batch.column("t").to_pylist()
            for at in range(0, len(texts), 100):
                each = [stretches(as_bytes(t), window) for t in texts[at : at + 100]]
                n = [len(x[0]) for x in each]
                key, lo, count, text = (np.concatenate(x) for x in zip(*each, strict=True))
                columns = [key, np.repeat(docs[at : at + 100], n), lo, count, text]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "doc", "lo", "n", "text"])

    return docs.mapInArrow(run, "key long, doc long, lo int, n int, text long")


def cut_out(docs: DataFrame, wanted: DataFrame, window: int, max_broadcast: int) -> DataFrame:
    """``key, doc, lo, s``: the bytes of the wanted stretches (key, doc, lo, n)."""
    lists = materialise(wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "lo", "n")).alias("wanted")), "wanted", "zstd")
    have = docs.join(sized(lists.select("doc"), max_broadcast), "doc", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, each in zip(*(batch.column(c).to_pylist() for c in ("doc", "t", "wanted")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(w["key"], doc, w["lo"], data[w["lo"] : w["lo"] + w["n"] + window - 1]) for w in each]
            for at in range(0, len(rows), 5000):
                part = rows[at : at + 5000]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["key", "doc", "lo", "s"])

    return have.join(lists, "doc").select("doc", "t", "wanted").mapInArrow(run, "key long, doc long, lo int, s binary")


def shard_spans(texts: DataFrame, window: int) -> DataFrame:
    """``doc, start, stop`` of what repeats among the stretches of each key, by shards of whole keys."""
    spans = "doc long, start int, stop int"

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"\xff".join(r[3] for r in rows), np.uint8)  # no byte of UTF-8: no window goes across it
        repeats = permuted_repeats(data, window)
        ends = np.cumsum([len(r[3]) + 1 for r in rows])
        out = []
        for (_, doc, lo, s), end in zip(rows, ends.tolist(), strict=True):
            begin = end - 1 - len(s)
            for a, b in zip(*runs_of(repeats[begin : begin + len(s) - window + 1]), strict=True):
                out.append((doc, lo + int(a), lo + int(b) - 1 + window))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["doc", "start", "stop"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "lo", "s")), strict=True):
                if held >= SHARD_BYTES and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield solve(rows)

    return texts.repartition("key").sortWithinPartitions("key").mapInArrow(run, spans)


def window_spans(texts: DataFrame, window: int, max_broadcast: int) -> DataFrame:
    """The same for keys with too many texts for a shard: windows are hashed, and hashes counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, lo, s in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "lo", "s")), strict=True):
                data = np.frombuffer(s, np.uint8)
                at = np.arange(len(data) - window + 1)
                h = substring_hashes(prefix_hashes(data), at, at + window).astype(np.int64)
                columns = [np.full(len(at), key), h, np.full(len(at), doc), (at + lo).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "h", "doc", "start"])

    windows = materialise(texts.mapInArrow(run, "key long, h long, doc long, start int"), "windows")
    again = materialise(windows.groupBy("key", "h").count().where("count > 1").select("key", "h"), "again")
    return windows.join(sized(again, max_broadcast), ["key", "h"], "left_semi").select("doc", "start", (F.col("start") + window).alias("stop"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_texts: int = SHARD_TEXTS, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``doc, start, stop``: bytes of rows (doc, t) under a repeated window; spans of a row can overlap."""
    found = stretch_table(docs, window)
    keys = materialise(found.groupBy("key").count().where("count > 1").select("key"), "keys")
    rows = materialise(found.join(sized(keys, max_broadcast), "key", "left_semi"), "stretches")
    first = F.min(F.struct("doc", "lo", "n")).alias("first")
    texts = materialise(rows.groupBy("key", "text").agg(F.count("*").alias("copies"), first), "texts")
    whole = materialise(texts.where("copies > 1").select("key", "text"), "whole")
    spans = rows.join(sized(whole, max_broadcast), ["key", "text"], "left_semi").select("doc", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + window).alias("stop"))
    several = materialise(texts.groupBy("key").count().where("count > 1").select("key", (F.col("count") > shard_texts).alias("hot")), "several")
    wanted = texts.join(sized(several, max_broadcast), "key").select("key", "hot", "first.*")
    cut = materialise(cut_out(docs, wanted, window, max_broadcast), "cut")
    hot = materialise(several.where("hot").select("key"), "hot")
    if hot.isEmpty():
        return materialise(spans.unionByName(shard_spans(cut, window)), "spans")
    cool = cut.join(sized(hot, max_broadcast), "key", "left_anti").select(*cut.columns)
    warm = cut.join(sized(hot, max_broadcast), "key", "left_semi").select(*cut.columns)
    return materialise(spans.unionByName(shard_spans(cool, window)).unionByName(window_spans(warm, window, max_broadcast)), "spans")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, doc, t``: rows with the number that tells them apart."""
    return row_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), "id", "doc")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_bytes: bool = False, shard_texts: int = SHARD_TEXTS, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row, and with ``keep_bytes`` the ``kept`` bytes."""
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows.select("doc", "t"), window, shard_texts, max_broadcast)
    lists = materialise(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spanlists")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t"):
            out = []
            texts, spans = batch.column("t").to_pylist(), batch.column("spans")
            for text, each in zip(texts, spans, strict=True):
                data = as_bytes(text)
                gone = np.zeros(len(data) + 1, np.int32)
                if each.is_valid:
                    pairs = each.values
                    np.add.at(gone, pairs.field("start").to_numpy(), 1)
                    np.add.at(gone, pairs.field("stop").to_numpy(), -1)
                gone = np.cumsum(gone[:-1]) > 0
                kept = data[~gone].tobytes()
                out.append((len(data), int(gone.sum()), len(runs_of(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string()) + (pa.binary(),) * keep_bytes
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)

    spans = lists.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0))).first()[0]  # eight bytes each
    joined = rows.join(F.broadcast(lists) if spans <= 10 * max_broadcast else lists, "doc", "left").select("id", "t", "spans")
    return materialise(joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes), "kept")
