"""JSON lines that are read by key: an index of where each line lies, and a reader that seeks.

The index is a table (path, offset, length, keys, digest, failed), written sorted by key, so that Parquet's statistics prune it and the lookup
is a filter or a join like any other. Lines are found by a data source whose partitions are ranges of bytes. A lookup sorts
the chosen entries by place and reads them in runs, each with one seek.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of a batch of lines, and between two lines that are still read in one go.
RANGE_BYTES, BATCH_BYTES, GAP_BYTES = 64 << 20, 8 << 20, 4 << 10
#: Bytes that one read takes at most, but for a longer line.
RUN_BYTES = 4 << 20


def file_system(uri: str):
    """A pyarrow file system, and the path in it."""
    from pyarrow import fs

    parts = urlsplit(uri.replace("s3a://", "s3://", 1))
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(parts.geturl())


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


def lines_from(f: io.BufferedIOBase, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in a range; a line that began before it is the range's before."""
    at = start
    if start:
        f.seek(start - 1)
        at += len(f.readline()) - 1
    while at < stop and (line := f.readline()):
        if line.strip():
            yield at, line
        at += len(line)


class LineReader(DataSourceReader):
    """Options: ``path`` (a file or a folder), ``rangeBytes``."""

    def __init__(self, options: dict) -> None:
        self.uri, self.bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, path = file_system(self.uri)
        folder = system.get_file_info(path).type == fs.FileType.Directory
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if folder else [system.get_file_info(path)]
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and os.path.basename(x.path)[0] not in "._")
        return [Range(p, a, min(a + self.bytes, n)) for p, n in files for a in range(0, n, self.bytes)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = file_system(self.uri)
        rows, held = [], 0
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("line", pa.string())])
        with system.open_input_file(part.path) as raw:
            for offset, line in lines_from(io.BufferedReader(raw, 1 << 20), part.start, part.stop):
                rows.append((part.path, offset, len(line), line.decode("utf-8")))
                held += len(line)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placed_lines"

    def schema(self) -> str:
        return "path string, offset long, length long, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))


def index_lines(spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], digested: list[str], failed: Column, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, offset, length``, the keys, ``digest`` of the ``digested`` fields and ``failed``, for each line. Blank lines are skipped."""
    spark.dataSource.register(LineSource)
    lines = spark.read.format("placed_lines").option("rangeBytes", str(range_bytes)).load(path)
    rows = lines.select("path", "offset", "length", F.from_json("line", schema).alias("row")).select("path", "offset", "length", "row.*")
    digest = F.sha2(F.to_json(F.struct(*digested), {"ignoreNullFields": "false"}), 256)
    return rows.select("path", "offset", "length", *keys, digest.alias("digest"), F.coalesce(failed, F.lit(False)).alias("failed"))


def save_index(index: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The index, sorted by key over its files: a predicate on keys reads the files and pages that can have them."""
    index.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(folder)
    return index.sparkSession.read.schema(index.schema).parquet(folder)


def chosen_entries(index: DataFrame, keys: list[str]) -> DataFrame:
    """One entry a key: its first success, else its first failure. Successes of a key that differ raise; equal ones are one."""
    good = F.when(~F.col("failed"), F.col("digest"))
    best = F.min(F.struct("failed", "path", "offset", "length", "digest")).alias("best")
    found = index.groupBy(*keys).agg(best, F.min(good).alias("least"), F.max(good).alias("most"))
    conflict = F.raise_error(F.concat(F.lit("conflicting successes for "), F.to_json(F.struct(*keys))))
    checked = F.when(F.col("least") < F.col("most"), conflict.cast("string")).otherwise(F.col("best.digest"))
    return found.select(*keys, "best.path", "best.offset", "best.length", checked.alias("digest"), "best.failed")


def repaired_entries(entries: DataFrame, repairs: DataFrame, keys: list[str]) -> DataFrame:
    """Entries with successes of a repair index (with ``repair_of``, the repaired file) in the place of failures. Any other repair raises."""
    fix = repairs.where("NOT failed").select(*keys, *(F.col(c).alias(f"_{c}") for c in ("path", "offset", "length", "digest", "repair_of")))
    joined = entries.join(fix, keys, "full_outer")
    bad = F.col("_path").isNotNull() & ~F.coalesce(F.col("failed") & (F.col("_repair_of") == F.col("path")), F.lit(False))
    refuse = F.raise_error(F.concat(F.lit("a repair replaces no failure of its file: "), F.to_json(F.struct(*keys)))).cast("string")
    new = F.col("_path").isNotNull()
    path = F.when(bad, refuse).when(new, F.col("_path")).otherwise(F.col("path"))
    return joined.select(*keys, path.alias("path"), *(F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("offset", "length", "digest")), (F.col("failed") & ~new).alias("failed"))


def read_runs(f, entries: Iterable[tuple[int, int]], gap: int = GAP_BYTES, most: int = RUN_BYTES) -> Iterator[bytes]:
    """Bytes of entries (offset, length) in rising order; neighbours are read in one go."""
    run: list[tuple[int, int]] = []

    def taken() -> Iterator[bytes]:
        first = run[0][0]
        f.seek(first)
        data = f.read(max(a + n for a, n in run) - first)
        yield from (data[a - first : a - first + n] for a, n in run)

    for a, n in entries:
        if run and (a - (run[-1][0] + run[-1][1]) > gap or a + n - run[0][0] > most):
            yield from taken()
            run = []
        run.append((a, n))
    if run:
        yield from taken()


def read_entries(entries: DataFrame, uri: str, schema: T.StructType | str) -> DataFrame:
    """``path, offset`` and the fields of the lines of entries (path, offset, length), read by seeking. ``uri`` names their file system."""
    out = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("line", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(uri)
        for batch in batches:
            paths, offsets, lengths = (batch.column(c).to_pylist() for c in ("path", "offset", "length"))
            a = 0
            while a < len(paths):
                b = a
                while b < len(paths) and paths[b] == paths[a]:
                    b += 1
                with system.open_input_file(paths[a]) as f:
                    held: list[str] = []
                    size, first = 0, a
                    for line in read_runs(f, zip(offsets[a:b], lengths[a:b], strict=True)):
                        held.append(line.decode("utf-8"))
                        size += len(line)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(paths[first : first + len(held)]), pa.array(offsets[first : first + len(held)]), pa.array(held)], schema=out)
                            first, held, size = first + len(held), [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(paths[first:b]), pa.array(offsets[first:b]), pa.array(held)], schema=out)
                a = b

    placed = entries.select("path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    lines = placed.mapInArrow(run, "path string, offset long, line string")
    return lines.select("path", "offset", F.from_json("line", schema).alias("row")).select("path", "offset", "row.*")
