"""What the operators share: the cluster's shared folder, written intermediates, and joins whose small side is checked."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.layout import fresh_folder

#: Rows up to which the small side of a join is broadcast. Those sides are narrow (under 200 bytes a row), so 20 MB at most.
MAX_BROADCAST_ROWS = 100_000

#: Bytes of an Arrow batch, and text bytes that a Python worker takes up at a time. A longer text is a batch of its own.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches of up to ``BATCH_BYTES`` go to Python workers; afterwards as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Lists that note the folders of tables as this thread writes them.
noted: ContextVar[tuple[list[str], ...]] = ContextVar("noted", default=())


@contextmanager
def noting(folders: list[str]) -> Iterator[None]:
    """Within it, ``folders`` takes the names of all tables that this thread writes."""
    token = noted.set((*noted.get(), folders))
    try:
        yield
    finally:
        noted.reset(token)


def delete_tables(folders: list[str], needed: DataFrame) -> None:
    """Delete the noted tables, but for those that ``needed`` still reads, and forget them."""
    spark = needed.sparkSession
    reads = [urlsplit(f).path for f in needed.inputFiles()] if folders else []
    for folder in list(folders):
        if not any(f.startswith(urlsplit(folder).path) for f in reads):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            folders.remove(folder)


#: What operators keep in this Python worker from task to task: how each lets go of it.
KEPT: dict[str, Callable[[], None]] = {}


def give_back(owner: str = "", forget: Callable[[], None] | None = None) -> None:
    """At the end of a task, return freed memory to the system, and what other operators than ``owner`` kept: workers are used again.

    ``forget`` says how to let go of what ``owner`` keeps for its next tasks.
    """
    if forget:
        KEPT[owner] = forget
    for name in [x for x in KEPT if x != owner]:
        KEPT.pop(name)()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and lost executors cost no recompute.

    What Python workers take at a time is bounded meanwhile; so operators that run Python give their results in this way.
    """
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, label)
    for folders in noted.get():
        folders.append(path)
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df``, hinted for broadcast only if its counted rows are within ``limit``; else the join shuffles.

    ``df`` should be a materialised table, so that the count is a metadata read.
    """
    return F.broadcast(df) if df.count() <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take ``lower``, which is then the same and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a further column that numbers its rows. It is written, so that every evaluation has the same numbers."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def row_ids(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """``df`` with a further long column that tells its rows apart: the id, or a negative number.

    Numbers go to rows whose id is null, negative or repeated; only these rows are written.
    """
    own = df.withColumn(name, F.when(F.col(id_col) >= 0, F.col(id_col).cast("long")))
    odd = materialise(own.groupBy(name).count().where(f"count > 1 OR {name} IS NULL").select(name), "oddids")
    if odd.isEmpty():
        return own
    single = own.where(F.col(name).isNotNull()).join(sized(odd), name, "left_anti")
    several = odd.withColumnRenamed(name, "odd")
    rest = own.join(sized(several), F.col(name).eqNullSafe(F.col("odd")), "left_semi").drop(name)
    columns = [*df.columns, name]
    return single.select(columns).unionByName(numbered(rest, name).withColumn(name, -1 - F.col(name)).select(columns))


def drop_rows(rows: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """Rows that :func:`row_ids` told apart, but for those of the materialised one-column table ``dropped``, without the number."""
    return rows.join(sized(dropped), name, "left_anti").drop(name)


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in zero-copy slices of about ``limit`` bytes of ``column``; a longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
