"""WARC archives: write captures, read records back, assemble one nested row per capture.

A capture is a transaction of three records: request, response (or revisit) and metadata.
Request and metadata name the response in WARC-Concurrent-To; the reader joins on that.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.secrets import in_filter, uid_filter
from linekeeper.llm.store import binary_column, materialize, new_folder, put_file, tidy

#: Uncompressed bytes after which a task starts its next file.
FILE_BYTES = 32 << 20
#: The tables carry no capture time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("5f0c3a52-8f0e-5d7c-9d0e-0b6f7f6f2a11")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page: object, url: str | None, number: int, digest: str) -> str:
    """The same for the same row of pages: a record that a repeated task writes again counts once; ``number`` tells rows apart that repeat page, URL and payload."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, repr((kind, page, url, number, digest)))}>"


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def capture_records(page: object, url: str | None, number: int, payload: bytes, digest: str, first: dict | None, revisit: bool) -> list[bytes]:
    """The three records of one capture, response or revisit first; ``first``: page, url and number of the capture that a revisit refers to."""
    uri = None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    own = record_id("response", page, url, number, digest)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", first["page"], first["url"], first["number"], digest))]
    answer = _record([*head, ("Content-Type", "application/http;msgtype=response")], http if revisit else http + payload)
    where = urlsplit(uri or "")
    asked = f"GET {where.path or '/'} HTTP/1.1\r\nHost: {where.netloc}\r\n\r\n".encode()
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page, url, number, digest)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")],
        asked,
    )
    fields = b"" if page is None else f"pageId: {quote(str(page), safe='')}\r\n".encode()
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page, url, number, digest)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")],
        fields,
    )
    return [answer, request, metadata]


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> tuple[str, DataFrame]:
    """Write ``pages`` as .warc.gz files; returns the folder and the list of files (file, records).

    Of equal payloads with ``min_bytes`` bytes or more, the one with the smallest id (any
    type) is written whole, the others as revisits of it.  Only payloads that may have an
    equal are shuffled.  Null body: an empty payload; null url: no target URI; null ids are
    written, and are never the response if an equal payload has one; every row is a capture
    of its own, also one that repeats another; an empty table gives no files.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("sha1"), F.monotonically_increasing_id().alias("number"))
    # stored: a row's number is the same wherever it is read
    rows = materialize(rows.withColumn("__uid", F.xxhash64("sha1")), "warc-rows")
    # of payloads that several rows have, pre-aggregated and stored: a hot one costs a row a task, and the join can split it
    first = F.min(F.when(F.col("page").isNotNull(), F.struct("page", "url", "number"))).alias("first")
    shared = materialize(rows.groupBy("sha1", "__uid").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "warc-firsts")
    marked = rows.withColumn("__bits", uid_filter(shared))
    columns = ("page", "url", "number", "body")
    alone = marked.filter(~in_filter()).select(*columns, F.lit(None).cast(shared.schema["first"].dataType).alias("first"))
    joined = alone.union(marked.filter(in_filter()).drop("__bits").join(shared.drop("__uid"), "sha1", "left").select(*columns, "first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, out, size, count = TaskContext.get().partitionId(), 0, io.BytesIO(), 0, 0
        done = []

        def close() -> None:
            nonlocal k, out, size, count
            if count:
                done.append((put_file(folder, f"part-{task:06d}-{k:04d}.warc.gz", out.getvalue()), count))
            k, out, size, count = k + 1, io.BytesIO(), 0, 0

        for batch in batches:
            bodies = binary_column(batch, "body")
            for page, url, number, body, first in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "number")), bodies, batch.column("first").to_pylist(), strict=True):
                digest = payload_digest(body)
                revisit = len(body) >= min_bytes and first is not None and page != first["page"]
                for record in capture_records(page, url, number, body, digest, first, revisit):
                    out.write(gzip.compress(record, 6, mtime=0))
                    size += len(record)
                    count += 1
                if size >= FILE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["file", "records"])

    return folder, materialize(joined.mapInArrow(tidy(write), "file string, records long"), "warc-list")


RECORD = (
    "record_type string, record_id string, concurrent_to string, uri string, refers_to_id string, payload_digest string, "
    "payload_bytes long, page_id long, payload binary"
)


def parse_archive(raw: bytes) -> Iterator[dict]:
    """Records of a .warc.gz file; a payload that doesn't match its digest is an error."""
    with gzip.open(io.BytesIO(raw)) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    raise ValueError(f"no WARC record: {line[:40]!r}")
                continue
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            block = f.read(int(head["content-length"]))
            kind = head["warc-type"]
            out = {
                "record_type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "uri": head.get("warc-target-uri"),
                "refers_to_id": head.get("warc-refers-to"), "payload_digest": None, "payload_bytes": None, "page_id": None, "payload": None,
            }
            if kind in ("response", "revisit"):
                http, _, payload = block.partition(b"\r\n\r\n")
                lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                out |= {"payload_digest": digest, "payload_bytes": int(lengths[0]), "payload": None if kind == "revisit" else payload}
                if kind == "response" and (payload_digest(payload) != digest or len(payload) != out["payload_bytes"]):
                    raise ValueError(f"payload of {out['record_id']} does not match its digest")
            elif kind == "metadata":
                fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                out["page_id"] = unquote(fields["pageId"]) if "pageId" in fields else None
            yield out


def read_records(spark, folder: str, payloads: bool = False, id_kind: str = "long") -> DataFrame:
    """A row for each WARC record in the folder's files; ``id_kind``: type of the page ids, which the records hold as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] if payloads or n != "payload" else None for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for row in parse_archive(content.as_py()):
                    rows.append(row)
                    if len(rows) >= 500:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).select("content")
    return files.mapInArrow(tidy(run), RECORD.replace("page_id long", "page_id string")).withColumn("page_id", F.col("page_id").cast(id_kind))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row (capture, request, response, metadata, refers_to) per transaction.

    Records meet through the response's identifier: its own or, for request and metadata,
    their concurrent-to.  ``refers_to`` is the page of the record that a revisit refers to.
    A part that is missing is null; repeated records of one identifier count once.
    """
    fields = [c for c in records.columns if c not in ("refers_to_id",)]
    part = F.struct(*fields, "refers_to_id")
    key = F.coalesce("concurrent_to", "record_id").alias("capture")

    def of(*kinds: str):
        return F.first(F.when(F.col("record_type").isin(*kinds), F.col("part")), ignorenulls=True)

    nested = (
        records.select(key, part.alias("part"), "record_type")
        .groupBy("capture")
        .agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))
    )
    nested = materialize(nested, "captures")  # read twice: the archives are parsed once
    targets = nested.filter("response.record_type = 'response'").select(F.col("capture").alias("to"), F.col("metadata.page_id").alias("refers_to"))
    return nested.join(targets, F.col("response.refers_to_id") == F.col("to"), "left").drop("to")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Null html: an empty payload; null url: no target URI; null page_id: its payloads are never the response if another has an id.

    Every row of pages is a capture of its own, also one that repeats another; with an empty
    table there are no files and no rows; other columns are ignored.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType.simpleString()
    folder, files = write_archives(pages)
    if not files.isEmpty():
        rows = assemble(read_records(spark, folder, id_kind=kind))
    else:
        rows = assemble(spark.createDataFrame([], RECORD))
    return rows.select(
        F.col("metadata.page_id").cast(kind).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
