"""WARC archives: a writer on Spark's own text sink and a reader as a PySpark Python data source.

The writer makes each record one row of the sink, whose line separator is the blank lines that end a record, so archives
go to any file system that Spark writes, under its commit protocol. Payloads that repeat become ``revisit`` records.

The reader plans partitions of whole archive files, takes predicates on record type and on headers, reads a record's
headers first, and seeks past the payload of a record that a predicate rejects or when no payload column is asked for.
It takes others' archives too: gzipped ones (``.gz``, a member a record), header names in any case, and HTTP messages, whose
payload is what follows their own headers. A response's length and SHA-256 are its headers' if they state them; else they are taken from
its payload, which is read for them even if no payload column is asked for. A predicate on what headers do not state is decided
after that, so predicates and ``payload`` change no row.

Defined cases: a null payload is written as an empty one; a null id is written without its header and read as null;
pages that repeat id and payload are records of their own, and all but one of them revisit it, as do all but one of equal
payloads that all lack an id; an empty table gives no archive rows; other columns are ignored. URIs are read as they stand, blanks
at their ends included, but for line breaks, which a header can't hold and which are written as %0D and %0A; a null URI reads as null.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from tidewater.llm.shared import MAX_BROADCAST_ROWS, materialise, numbered, sized
from tidewater.operators.layout import fresh_folder

END = "\r\n\r\n"
SCHEMA = "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Column, header and conversion.
HEADERS = {"page_id": ("WARC-Page-Id", int), "record_type": ("WARC-Type", str.strip), "target_uri": ("WARC-Target-URI", str), "refers_to": ("WARC-Refers-To-Page-Id", int), "payload_bytes": ("WARC-Payload-Length", int), "payload_digest": ("WARC-Payload-Digest", lambda x: x.strip().rpartition(":")[2])}
#: A stated digest that is taken as it stands.
SHA256 = re.compile(r"sha256:[0-9a-f]{64}", re.IGNORECASE)
#: Bytes that a reader takes at a time, and rows and payload bytes of one batch.
BLOCK, BATCH_ROWS, BATCH_BYTES = 1 << 20, 2_000, 16 << 20


def with_first(rows: DataFrame, least_bytes: int, max_broadcast: int) -> DataFrame:
    """Adds to rows (i, u, b, d, n) ``first``, the id of the response that a row revisits or is, and ``revisit``.

    Digests go through an aggregation that combines before its shuffle; only digests that repeat are joined back, by
    broadcast up to ``max_broadcast`` of them and else by a shuffle join, which Spark splits where a digest is hot. Where
    the smallest id of a payload repeats, those rows are written with a number, by which one of them is chosen.
    """
    long = rows.where(F.col("n") >= least_bytes)
    # ids that are null come last
    ids = long.groupBy("d", "i").agg(F.count("*").alias("rows")).groupBy("d").agg(F.min(F.struct(F.col("i").isNull(), "i", "rows")).alias("least"), F.sum("rows").alias("copies"))
    keyed = materialise(ids.where("copies > 1").select("d", F.col("least.i").alias("first"), (F.col("least.rows") > 1).alias("tied"), F.lit(True).alias("again")), "warc-copies")
    rows = rows.join(sized(keyed, max_broadcast), "d", "left")
    names = [*[c for c in rows.columns if c not in ("tied", "again")], "revisit"]
    if keyed.where("tied").isEmpty():
        return rows.withColumn("revisit", F.col("again").isNotNull() & ~F.col("i").eqNullSafe(F.col("first"))).select(names)
    tied = F.coalesce(F.col("tied") & F.col("i").eqNullSafe(F.col("first")), F.lit(False))
    chosen = numbered(rows.where(tied), "number")
    best = materialise(chosen.groupBy("d").agg(F.min("number").alias("best")), "warc-first")
    chosen = chosen.join(sized(best, max_broadcast), "d").withColumn("revisit", F.col("number") != F.col("best"))
    others = rows.where(~tied).withColumn("revisit", F.col("again").isNotNull() & ~F.col("i").eqNullSafe(F.col("first")))
    return others.select(names).unionByName(chosen.select(names))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 100, max_broadcast: int = MAX_BROADCAST_ROWS) -> None:
    """A record per row. Of equal payloads of ``least_bytes`` or more the one with the smallest id is a response, others revisit it."""
    payload = F.coalesce(F.col("b"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(uri_col).cast("string").alias("u"), F.col(payload_col).alias("b")).select("i", "u", payload.alias("b"))
    rows = rows.withColumn("d", F.sha2(F.col("b").cast("binary"), 256)).withColumn("n", F.octet_length("b").cast("long"))
    rows, revisit = with_first(rows, least_bytes, max_broadcast), F.col("revisit")
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(head(name, value), F.lit(""))
    uri = F.replace(F.replace(F.col("u"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        head("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        head("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws(" ", "i", "d"), 256), F.lit(">"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        optional("WARC-Target-URI", uri),
        optional("WARC-Page-Id", F.col("i")),
        optional("WARC-Refers-To-Page-Id", F.when(revisit, F.col("first"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("d"))),
        head("WARC-Payload-Length", F.col("n")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        head("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("b")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def file_system(uri: str):
    """A pyarrow file system and path for what Spark names by URI; only local files need no further library."""
    from pyarrow import fs

    parts = urlsplit(uri.replace("s3a://", "s3://", 1))
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(parts.geturl())


def list_archives(uri: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, path = file_system(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
    hidden = lambda p: os.path.basename(p)[0] in "._"
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.size and not hidden(x.path))


@dataclass
class Archives(InputPartition):
    uri: str
    files: list[str] = field(default_factory=list)

    def __init__(self, uri: str, files: list[str]):
        super().__init__((uri, tuple(files)))
        self.uri, self.files = uri, files


def parse_headers(block: bytes) -> dict[str, str]:
    """By lower-case name; of a value one blank before it goes and nothing else."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def payload_of(block: bytes, heads: dict[str, str]) -> bytes:
    """What a record's block holds: of an HTTP message, what follows its headers."""
    if heads.get("content-type", "").strip().lower().startswith("application/http"):
        head, gap, body = block.partition(b"\r\n\r\n")
        return body if gap else b""
    return block


class WarcReader(DataSourceReader):
    """Options: ``path``; ``payload`` (false: payloads are skipped and read as null); ``verify`` (digests and lengths of payloads are compared);
    ``derive`` (as ``payload`` unless stated; false: lengths and digests that headers do not state are null).
    """

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.derive = options.get("derive", str(self.payload)).lower() == "true"
        self.bytes = int(options.get("partitionBytes", 32 << 20))
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, IsNotNull):
                self.present.add(name)
            else:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[Archives]:
        out, size = [[]], 0
        for path, n in list_archives(self.uri):
            if out[-1] and size + n > self.bytes:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Archives(self.uri, x) for x in out]

    def keeps(self, row: dict, known: Container[str] = HEADERS) -> bool:
        """Whether the predicates take a row of which the ``known`` columns are settled."""
        return all(row[k] in v for k, v in self.wanted.items() if k in known) and all(row[k] is not None for k in self.present if k in known)

    def records(self, f: io.BufferedIOBase) -> Iterator[dict]:
        data, at = b"", 0
        while True:
            while (stop := data.find(b"\r\n\r\n", at)) < 0:
                more = f.read(BLOCK)
                if not more:
                    if data[at:].strip():
                        raise ValueError("an archive ends inside a record's headers")
                    return
                data, at = data[at:] + more, 0
            if not data.startswith(b"WARC/", at):
                raise ValueError("a record does not begin with its version")
            heads = parse_headers(data[at:stop])
            row = {c: convert(heads[h.lower()]) if h.lower() in heads else None for c, (h, convert) in HEADERS.items()}
            row["payload"] = None
            stated = SHA256.fullmatch(heads.get("warc-payload-digest", "").strip())
            if stated:
                row["payload_digest"] = row["payload_digest"].lower()
            settled, response = set(HEADERS), row["record_type"] == "response"
            if response and self.derive:
                settled -= {c for c, known in (("payload_bytes", row["payload_bytes"] is not None), ("payload_digest", stated)) if not known}
            at, length = stop + 4, int(heads["content-length"])
            end = at + length + 4
            if self.keeps(row, settled) and (self.payload or len(settled) < len(HEADERS)):
                if end > len(data):
                    data, at, end = data[at:] + f.read(end - len(data)), 0, length + 4
                if len(data) < at + length:
                    raise ValueError("an archive ends inside a payload")
                payload = payload_of(data[at : at + length], heads)
                if response:
                    digest = hashlib.sha256(payload).hexdigest()
                    if self.verify and (stated and row["payload_digest"] != digest or row["payload_bytes"] not in (None, len(payload))):
                        raise ValueError("a payload differs from its digest or its length")
                    if "payload_bytes" not in settled:
                        row["payload_bytes"] = len(payload)
                    if "payload_digest" not in settled:
                        row["payload_digest"] = digest
                if self.payload:
                    row["payload"] = payload
            if end > len(data):  # past what has been read: seek, nothing is read
                f.seek(end - len(data), io.SEEK_CUR)
                data, at = b"", 0
            else:
                at = end
            if self.keeps(row):
                yield row

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.uri)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for path in partition.files:
            rows, size = [], 0
            with system.open_input_file(path) as f:
                for row in self.records(gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``; filters on header columns are taken by the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("derive", "true").load(path)


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back, payloads included."""
    path = path or fresh_folder(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
