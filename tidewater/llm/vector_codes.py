"""Vector codes: parts of integer vectors are replaced by the nearest entries of codebooks that are refined over all vectors.

The search is by partial distances: dimensions are added in the order of falling codebook variance, and an entry leaves as
soon as its sum strictly exceeds the best complete distance known so far. Entries that tie stay, so the lower index wins.

Each round is a job of its own over the source: a task gives a row for each entry it used (sums and a count), Spark adds them
up, and only the codebooks reach the driver: ``entries`` vectors, whatever the number of rows.

Defined cases: dropped are rows whose vector is null, holds null, NaN or infinite components, or has another length than most
(of lengths equally frequent the longest counts). A length that the parts do not divide gives the first parts one
component more; vectors of length 0 have codes of zeros and error 0. Of rows that share an id the smaller vector comes first
in the choice of entries, ids that are null come last, and each row is coded. With fewer rows than entries there are fewer
entries. Ties go to the lower index. Null labels count as one label. An empty table gives no rows. Further columns are not
read, whatever their names. Components whose squared distances could leave 64 bits (beyond about 2^27 after scaling) raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import give_back, materialise, sized, small_batches

#: Components are floor(SCALE * x). Codebooks have 256 entries for each of 4 parts and are refined in 4 rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4

#: Vectors that are compared with a codebook at a time: 8 MB of distances.
BLOCK = 4096


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    each, more = divmod(length, parts)
    return [k * each + min(k, more) for k in range(parts + 1)]


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_vectors(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch that are kept, and their vectors as integers, one a row."""
    lists = batch.column("v")
    ends = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ends == length)
    flat = pc.list_flatten(lists.take(pa.array(rows)))
    values = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), length)  # nulls become NaN
    good = np.isfinite(values).all(1)
    return rows[good], scaled(values[good])


def scaled(values: np.ndarray) -> np.ndarray:
    whole = np.floor(values * SCALE)
    if whole.size and np.abs(whole).max() >= 2.0**31 / np.sqrt(max(4, whole.shape[-1])):
        raise ValueError("components are too large for distances of 64 bits")
    return whole.astype(np.int64)


class Codebook:
    """The entries of one part, arranged for the search."""

    def __init__(self, entries: np.ndarray) -> None:
        self.order = np.argsort(-entries.astype(np.float64).var(0), kind="stable")
        self.entries = np.ascontiguousarray(entries[:, self.order].T)  # by dimension
        self.first = (len(self.order) + 1) // 2

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each vector."""
        index, error = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
        for a in range(0, len(vectors), BLOCK):
            index[a : a + BLOCK], error[a : a + BLOCK] = self.block(vectors[a : a + BLOCK][:, self.order].T)
        return index, error

    def block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, n = self.entries, x.shape[1]
        spread = max(int(x.max(initial=0)) - int(c.min(initial=0)), int(c.max(initial=0)) - int(x.min(initial=0)))
        kind = np.int32 if len(c) * spread**2 < 2**31 else np.int64
        x, c = x.astype(kind), c.astype(kind)
        sums = np.zeros((n, c.shape[1]), kind)
        for d in range(self.first):
            apart = x[d][:, None] - c[d]
            sums += apart * apart
        # the entry that leads so far gives the first complete distance
        lead = sums.argmin(1)
        best = sums[np.arange(n), lead]
        for d in range(self.first, len(c)):
            best = best + (x[d] - c[d][lead]) ** 2
        row, entry = np.nonzero(sums <= best[:, None])
        sums = sums[row, entry]
        for d in range(self.first, len(c)):
            sums = sums + (x[d][row] - c[d][entry]) ** 2
            stays = sums <= best[row]
            row, entry, sums = row[stays], entry[stays], sums[stays]
        # what is left is complete and no worse than the leader: the least, then the lowest index
        order = np.lexsort((entry, sums, row))
        at = order[np.searchsorted(row[order], np.arange(n))]
        return entry[at].astype(np.int64), sums[at].astype(np.int64)


def refine(vectors: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, and each used entry becomes the floored mean of its parts."""
    at = cuts(length, len(books))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, whole = whole_vectors(batch, length)
            for k, book in enumerate(search):
                part = whole[:, at[k] : at[k + 1]]
                index, _ = book.nearest(part)
                np.add.at(sums[k], index, part)
                counts[k] += np.bincount(index, minlength=len(counts[k]))
        used = [(k, e) for k in range(len(books)) for e in np.flatnonzero(counts[k]).tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([counts[k][e] for k, e in used], pa.int64()), pa.array([sums[k][e].tolist() for k, e in used], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )
        give_back()

    widest = max(b - a for a, b in zip(at, at[1:], strict=False))
    each = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(widest)]
    partial = vectors.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    found = [b.copy() for b in books]
    with small_batches(vectors.sparkSession):
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts * entries rows at most
            width = at[r.part + 1] - at[r.part]
            found[r.part][r.entry] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return found


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> tuple[list[np.ndarray], int]:
    """The parts of the kept vectors with the smallest ids, and the length that vectors have. No vectors: no entries."""
    kept = vectors.where(finite(F.col("v")))
    lengths = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return [], 0
    length = lengths[0].n
    order = (F.col("id").asc_nulls_last(), F.col("v"))
    rows = [r.v for r in kept.where(F.size("v") == length).orderBy(*order).limit(entries).select("v").collect()]
    whole, at = scaled(np.array(rows, np.float64).reshape(len(rows), length)), cuts(length, parts)
    return [whole[:, a:b].copy() for a, b in zip(at, at[1:], strict=False)], length


def train(vectors: DataFrame, parts: int, entries: int, rounds: int) -> tuple[list[np.ndarray], int]:
    books, length = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        books = refine(vectors, books, length)
    return books, length


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """``id, label, code, error`` of kept rows (id, v, label) by given codebooks."""
    at = cuts(length, len(books))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in batches:
            rows, whole = whole_vectors(batch, length)
            codes, error = np.zeros((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
            for k, book in enumerate(search):
                codes[:, k], apart = book.nearest(whole[:, at[k] : at[k + 1]])
                error += apart
            packed, width = codes.tobytes().hex(), 2 * len(books)
            code = [packed[a : a + width] for a in range(0, len(packed), width)]
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])
        give_back()

    return vectors.select("id", "v", "label").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """``vec_id, code, error, label, label_error, codebooks_sha256`` of every kept row. Entries are at most 256, two hex digits each."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so 256 entries at most")
    vectors = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    books, length = train(vectors, parts, entries, rounds)
    coded = materialise(encode(vectors, books, length) if books else vectors.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), "codes")
    totals = materialise(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "labels")
    joined = coded.join(sized(totals), F.col("label").eqNullSafe(F.col("l")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
