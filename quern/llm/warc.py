"""WARC writing with deduplicated payloads, and transaction assembly on reading.

Writing: each page becomes a request, a response (or a revisit of the page with the smallest id among
those with an equal payload) and a metadata record that names both by WARC-Concurrent-To, every record its own gzip
member. Roles come from a digest -> smallest id table (partial aggregation; a hot digest is one row) that ids and digests are joined with;
payloads then meet their page's role by page, so a hot digest doesn't bring its payloads together.

Reading: files are parsed record by record; records are joined into captures through their concurrent-to
identifiers, and one nested row goes out for each capture.

Results for odd input: null html is an empty payload; a null or empty url is written as "urn:none" and read back as null, others without blanks at their ends; pages with a null id are
responses, read back with a null id; rows that repeat an id and payload are responses both if theirs is the smallest id. An
empty table gives no files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, ship
from .storage import streamed, writing

_SPACE = uuid.UUID("8f6f1c55-3f0c-5a53-9d0f-0d6a6d1f7a10")
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, own: str, headers: list[tuple[str, str]], block: bytes, mime: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", DATE), *headers, ("Content-Type", mime), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 1, mtime=0)


def transaction(page_id: int | None, url: str | None, payload: bytes, first: int | None, name: str) -> bytes:
    """The three records of one page; first: the page that this one revisits."""
    ids = {k: str(uuid.uuid5(_SPACE, f"{name}/{k}")) for k in ("request", "response", "metadata")}
    uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    digest = payload_digest(payload)
    host, _, path = uri.partition("://")[2].partition("/")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    both = ("WARC-Concurrent-To", f"<urn:uuid:{ids['response']}>")
    target = ("WARC-Target-URI", uri)
    ask = _record("request", ids["request"], [target, both], f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), "application/http; msgtype=request")
    if first is None:
        main = _record("response", ids["response"], [target, ("WARC-Payload-Digest", f"sha1:{digest}")], http + payload, "application/http; msgtype=response")
    else:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        main = _record("revisit", ids["response"], [target, profile, ("WARC-Payload-Digest", f"sha1:{digest}")], http, "application/http; msgtype=response")
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("refers-to-page", first)) if v is not None)
    return ask + main + _record("metadata", ids["metadata"], [target, both], fields.encode(), "application/warc-fields")


def _write(folder: str):
    def run(batches):
        from pyspark import TaskContext

        number, n = TaskContext.get().partitionId(), 0
        uri = f"{folder}/pages-{number:06d}.warc.gz"
        todo = (b for b in batches if b.num_rows)
        some = next(todo, None)
        if some is None:
            return
        with writing(uri) as out:
            out.write(_record("warcinfo", str(uuid.uuid5(_SPACE, f"{number}")), [], b"format: WARC File Format 1.1\r\n", "application/warc-fields"))
            for batch in chain([some], todo):
                columns = [batch.column(k).to_pylist() for k in ("page_id", "url", "html", "first")]
                for page, url, html, first in zip(*columns):
                    revisit = first if page is not None and first is not None and first != page else None
                    out.write(transaction(page, url, (html or "").encode(), revisit, f"{number}/{n}"))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n])], ["uri", "n"])

    return run


def write_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = 0) -> list:
    """Write the archives; rows (uri, n) of the files. Payloads under `least` bytes are never revisits."""
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    sized = pages.where(F.col("page_id").isNotNull() & (F.col("size") >= least)).select("page_id", "digest")
    firsts = sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # a hot digest's pages meet their first by id and digest alone; payloads travel by page
    later = sized.join(firsts, "digest").where("page_id != first").distinct()
    rows = pages.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "first")
    return sorted(rows.mapInArrow(_write(folder), "uri string, n long").collect())


def parse(stream) -> list:
    """Records of a .warc.gz stream one after another: (headers in lower case, block)."""
    with io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            headers = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                headers[k.strip().lower()] = v.strip()
            yield headers, f.read(int(headers["content-length"]))


_RECORD = "capture string, kind string, record_id string, url string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _read(with_payload: bool):
    def run(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, size = [], 0
                with streamed(uri) as stream:
                    for h, block in parse(stream):
                        kind = h["warc-type"]
                        if kind == "warcinfo":
                            continue
                        page = refers = length = digest = body = None
                        if kind == "metadata":
                            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                            page, refers = (int(fields[k]) if k in fields else None for k in ("page-id", "refers-to-page"))
                        elif kind in ("response", "revisit"):
                            head, _, body = block.partition(b"\r\n\r\n")
                            digest = h["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response":
                                length = len(body)
                                if payload_digest(body) != digest:
                                    raise ValueError(f"{uri}: a payload doesn't have its digest")
                            else:
                                length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        url = None if h["warc-target-uri"] == "urn:none" else h["warc-target-uri"]
                        rows.append((h.get("warc-concurrent-to", h["warc-record-id"]), kind, h["warc-record-id"], url, page, refers, length, digest, body if with_payload and kind == "response" else None))
                        size += len(block)
                        if size > 4 << 20 or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _RECORD.split(", ")])


def read_captures(spark: SparkSession, uris: list[str], with_payload: bool = True) -> DataFrame:
    """One nested row for each capture: capture, url, request, response, metadata."""
    ship(spark)
    files = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, len(uris)))
    records = files.mapInArrow(_read(with_payload), _RECORD)
    of = lambda kinds, *cols: F.first(F.when(F.col("kind").isin(*kinds), F.struct(*cols)), ignorenulls=True)
    return records.groupBy("capture").agg(
        F.first("url", ignorenulls=True).alias("url"),
        of(["request"], "record_id").alias("request"),
        of(["response", "revisit"], "record_id", "kind", "payload_bytes", "payload_digest", "payload").alias("response"),
        of(["metadata"], "record_id", "page_id", "refers_to").alias("metadata"),
    )


def digest(captures: DataFrame) -> DataFrame:
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("metadata.refers_to").alias("refers_to"),
    )
