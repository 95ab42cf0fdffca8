import gzip
import hashlib
import os

from pyspark.sql import functions as F

from tidewater.llm.warc import WarcReader, archive_round_trip, read_warc, write_warc

ROWS = [(1, "http://a/é", "x" * 150), (2, "http://b", "x" * 150), (3, None, "short"), (4, "http://c", "short"), (5, "http://d", None), (6, " u\r\nv ", "WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n" * 9), (7, "http://e", "ü" * 50), (8, "http://f", "ü" * 50), (9, "g", "y" * 300_000)]


def expected(rows, least=100):
    first = {}
    for i, _, h in rows:
        d = hashlib.sha256((h or "").encode()).hexdigest()
        if len((h or "").encode()) >= least:
            first[d] = min(i, first.get(d, i))
    out = []
    for i, _, h in rows:
        d = hashlib.sha256((h or "").encode()).hexdigest()
        again = first.get(d, i) != i
        out.append((i, len((h or "").encode()), d, "revisit" if again else "response", first[d] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, payload_digest string")
    for broadcast in (100_000, 0):
        path = f"file://{tmp_path}/w{broadcast}"
        write_warc(pages, path, max_broadcast=broadcast)
        got = read_warc(spark, path)
        assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(ROWS)
    payloads = {r.page_id: bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()}
    assert all(payloads[i] == (h or "") for i, _, h in ROWS if i in payloads)


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3), path)
    df = read_warc(spark, path).where((F.col("record_type") == "revisit") & F.col("page_id").isin(2, 3))
    assert [r.page_id for r in df.collect()] == [2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    bare = read_warc(spark, path, payload=False).collect()
    assert len(bare) == len(ROWS) and all(r.payload is None for r in bare)


def test_seeks_past_rejected_payloads():
    class Counting:
        def __init__(self, data):
            self.data, self.at, self.taken = data, 0, 0

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            self.taken += len(out)
            return out

        def seek(self, n, whence):
            self.at += n

    record = lambda i, n: (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-Id: {i}\r\nContent-Length: {n}\r\n\r\n" + "z" * n + "\r\n\r\n").encode()
    f = Counting(record(1, 50_000_000) + record(2, 10))
    reader = WarcReader({"path": "x", "payload": "false"})
    assert [r["page_id"] for r in reader.records(f)] == [1, 2]
    assert f.taken < 5_000_000


def test_edge_tables(spark):
    schema = "page_id long, url string, html string, first long"
    assert archive_round_trip(spark.createDataFrame([], schema)).count() == 0
    one, none, other = "p" * 200, "q" * 200, "r" * 200
    rows = [(None, None, None), (1, "a", one), (1, "a", one), (1, "b", one), (2, "c", one), (None, "d", one), (None, "e", none), (None, "e", none), (None, "f", other), (7, "g", other), (1, "h", "s"), (1, "h", "s")]
    got = archive_round_trip(spark.createDataFrame([(*r, 3) for r in rows], schema)).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for text, kept, refers in ((one, 1, 1), (none, None, None), (other, 7, 7)):
        mine = [r for r in got if r.payload_digest == digest(text)]
        assert len(mine) == sum(r[2] == text for r in rows)
        assert [r.page_id for r in mine if r.record_type == "response"] == [kept]
        assert all(r.refers_to == refers and r.payload_bytes == 200 for r in mine if r.record_type == "revisit")
    assert sum(r.record_type == "response" for r in got) == 6
    assert {r.target_uri for r in got} == {r[1] for r in rows}


def test_uris_as_they_stand(spark):
    uris = [" sp ", "a\tb ", "x\r\ny", "", None, "é: ü"]
    rows = archive_round_trip(spark.createDataFrame(list(enumerate(uris)), "page_id long, url string").selectExpr("*", "'h' AS html")).collect()
    assert {r.page_id: r.target_uri for r in rows} == dict(enumerate([" sp ", "a\tb ", "x%0D%0Ay", "", None, "é: ü"]))


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>\r\n\r\nmore"
    record = lambda kind, block, more="": (f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-TARGET-URI: http://x\r\n{more}CONTENT-LENGTH: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    records = [record("warcinfo", b"software: x"), record("response", http, "Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:ABC\r\n"), record("resource", b"plain")]
    with open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(r) for r in records))
    rows = {r.record_type: r for r in read_warc(spark, f"file://{tmp_path}").collect()}
    body = b"<p>hi</p>\r\n\r\nmore"
    assert bytes(rows["response"].payload) == body and rows["response"].payload_bytes == len(body) and rows["response"].target_uri == "http://x"
    assert bytes(rows["resource"].payload) == b"plain" and bytes(rows["warcinfo"].payload) == b"software: x"
    assert rows["response"].payload_digest == hashlib.sha256(body).hexdigest()


def test_predicates_and_payloads_change_no_row(spark, tmp_path):
    http = lambda body: b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    sha = lambda b: hashlib.sha256(b).hexdigest()
    record = lambda kind, block, more="": (f"WARC/1.0\r\nWARC-Type: {kind}\r\n{more}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    http_type = "Content-Type: application/http; msgtype=response\r\n"
    records = [
        record("response", http(b"plain"), http_type + "WARC-Payload-Digest: sha1:ABC\r\nWARC-Target-URI: http://a\r\nWARC-Page-Id: 1\r\n"),
        record("response", http(b"stated"), http_type + f"WARC-Payload-Digest: SHA256:{sha(b'stated').upper()}\r\nWARC-Page-Id: 2\r\n"),
        record("response", b"no headers of its own"),
        record("revisit", b"", "WARC-Payload-Digest: sha1:ABC\r\nWARC-Refers-To-Page-Id: 1\r\nWARC-Page-Id: 3\r\n"),
        record("warcinfo", b"software: x"),
    ]
    for name, packed in (("others", False), ("gzipped", True)):
        os.makedirs(tmp_path / name)
        with open(tmp_path / name / ("a.warc.gz" if packed else "a.warc"), "wb") as f:
            f.write(b"".join(gzip.compress(r) if packed else r for r in records))
    write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string"), f"file://{tmp_path}/own")
    columns = ["page_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest"]
    for name in ("others", "gzipped", "own"):
        path = f"file://{tmp_path}/{name}"
        rows = sorted((tuple(r) for r in read_warc(spark, path).select(columns).collect()), key=str)
        assert sorted((tuple(r) for r in read_warc(spark, path, payload=False).select(columns).collect()), key=str) == rows
        for k, column in enumerate(columns):
            values = sorted({r[k] for r in rows if r[k] is not None}, key=str)[:4] + (["ABC"] if column == "payload_digest" else [])
            for payload in (True, False):
                read = lambda: read_warc(spark, path, payload=payload).select(columns)  # noqa: B023, E731
                for value in values:
                    assert sorted((tuple(r) for r in read().where(F.col(column) == value).collect()), key=str) == [r for r in rows if r[k] == value]
                assert sorted((tuple(r) for r in read().where(F.col(column).isNotNull()).collect()), key=str) == [r for r in rows if r[k] is not None]
    found = {r.page_id: r for r in read_warc(spark, f"file://{tmp_path}/others").where("record_type = 'response'").collect()}
    assert (found[1].payload_bytes, found[1].payload_digest) == (5, sha(b"plain")) and found[2].payload_digest == sha(b"stated") and found[None].payload_bytes == 21
