"""Web archives: pages written as WARC records, and records joined again into captures.

Each page makes three records: a response (or a revisit, where an earlier page has the same payload),
and a request and a metadata record that name it in ``WARC-Concurrent-To``. The archives are gzip
files made by Spark's text writer, whose line separator is the blank lines that end a record, so tasks
commit or leave nothing and any file system that Spark writes to will do.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayframe.llm.spread import spread_lookup, text_or_empty
from stayframe.session import scratch_path

# A smaller payload is always written out.
LEAST_SHARED = 100
# Records of one file, three to a page, so that a reader's task has a bounded file to hold.
FILE_RECORDS = 6_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def _record(kind: str, record_id: Column, block: Column, *fields: tuple[str, Column]) -> Column:
    """One WARC record as text, without the blank lines that end it."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\n")]
    for name, value in fields:
        lines += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def shared_payloads(pages: DataFrame, least: int) -> DataFrame:
    """``key, first_id, first_url, copies`` of payloads of ``least`` bytes or more that several rows have."""
    wide = pages.where(F.col("bytes") >= least)
    place = F.struct(F.col("page_id").isNull(), F.col("page_id"))
    return wide.groupBy("key").agg(
        F.min_by(F.struct("page_id", "url"), place).alias("_first"), F.count(F.lit(1)).alias("copies")
    ).where("copies > 1").select(
        "key", F.col("_first.page_id").alias("first_id"), F.col("_first.url").alias("first_url"), "copies",
        F.lit(True).alias("shared"),
    )


def write_warc(
    pages: DataFrame, path: str, *, least: int = LEAST_SHARED, date: str = DATE,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> None:
    """Write every page's records. Of equal payloads of ``least`` bytes or more the smallest page id is
    the response, the others revisit it.

    A null html is an empty payload, a null url an empty address; blanks and control characters in an
    address become ``%20``. A null page id comes after all others. Rows that share the smallest page id
    and the payload are all responses, repeated rows are captures of their own, no rows make no
    records. Extra columns are ignored.
    """
    spark = pages.sparkSession
    body = text_or_empty(pages, html)
    digest = F.sha2(body.cast("binary"), 256)
    bytes_ = F.octet_length(body).cast("bigint")
    address = F.regexp_replace(text_or_empty(pages, url), r"[\x00-\x20\x7F]", "%20")
    number = F.col(f"`{page_id}`").cast("bigint")
    # Small payloads share nothing: their key is their own, so that the empty ones do not meet in one task.
    own = F.concat(F.lit("own "), F.xxhash64(number, address).cast("string"))
    known = pages.select(
        number.alias("page_id"), address.alias("url"), bytes_.alias("bytes"), digest.alias("digest"), body.alias("body")
    ).withColumn("key", F.when(F.col("bytes") >= least, F.col("digest")).otherwise(own))
    shared_at = scratch_path(spark, "shared-payloads")
    shared_payloads(known, least).write.parquet(shared_at)
    shared = spark.read.parquet(shared_at)
    met = spread_lookup(known, shared, ["key"], "copies", pages.count())
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    # The number makes repeated rows differ; all records of a row are written by one attempt of one task.
    name = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest", F.monotonically_increasing_id())

    def urn(kind: str) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(kind), "name"))
        return F.concat_ws("-", F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8)), *[F.substring(h, a, 4) for a in (9, 13, 17)], F.substring(h, 21, 12))

    rows = met.select("*", revisit.alias("revisit"), name.alias("name")).withColumn("id", urn("capture"))
    uri, when = ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))
    payload = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", F.col("id"), F.concat(head, "body"), uri, when, payload, http)
    again = _record(
        "revisit", F.col("id"), head, uri, when, payload, http, ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To-Target-URI", F.col("first_url")), ("WARC-Refers-To-Date", F.lit(date)),
    )
    to = ("WARC-Concurrent-To", F.concat(F.lit("<"), "id", F.lit(">")))
    ask = F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record("request", urn("request"), ask, uri, when, to, ("Content-Type", F.lit("application/http; msgtype=request")))
    about = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\npayload-bytes: "), F.col("bytes").cast("string"),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nrefers-to-page: "), F.coalesce(F.col("first_id").cast("string"), F.lit(""))))
        .otherwise(""), F.lit("\r\n"),
    )
    metadata = _record("metadata", urn("metadata"), about, uri, when, to, ("Content-Type", F.lit("application/warc-fields")))
    records = rows.select(F.explode(F.array(request, F.when(F.col("revisit"), again).otherwise(response), metadata)).alias("value"))
    writer = records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS)
    writer.text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an uncompressed archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        for line in iter(stream.readline, b"\r\n"):
            if not line:
                raise ValueError("the archive ends within a record's head")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        yield headers, block


_RECORDS = (
    "capture_id string, record_id string, record_type string, target_uri string, payload_digest string, "
    "payload_bytes bigint, payload binary, fields map<string,string>"
)


def read_records(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the gzip archives under ``path``.

    ``capture_id`` is the record that a request or metadata record is concurrent to, else its own id. A
    response's digest and size are measured on the payload read; a revisit has the digest of its head.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([
            ("capture_id", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
            ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
        ])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    row = _row(headers, block, with_payload)
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 8_000_000 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return files.mapInArrow(unpack, _RECORDS)


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind, own = headers.get("warc-type", ""), headers.get("warc-record-id", "").strip("<>")
    row = {
        "capture_id": headers.get("warc-concurrent-to", own).strip("<>"), "record_id": own, "record_type": kind,
        "target_uri": headers.get("warc-target-uri"), "payload_digest": None, "payload_bytes": None, "payload": None,
        "fields": {},
    }
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        row |= {"payload_digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload)}
        row["payload"] = payload if with_payload else None
    elif kind == "revisit":
        row["payload_digest"] = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    elif kind == "metadata":
        lines = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
        row["fields"] = {name.strip().lower(): value.strip() for name, _, value in lines}
    return row


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, capture, request, metadata``.

    The records meet under the id that they are concurrent to. A part that is missing is null; of
    several of one kind the one with the smallest record id counts.
    """
    parts = F.struct(*[c for c in records.columns if c != "capture_id"])

    def first(*kinds: str) -> Column:
        return F.min_by(F.when(F.col("record_type").isin(*kinds), parts), F.when(F.col("record_type").isin(*kinds), F.col("record_id")))

    return records.groupBy("capture_id").agg(
        first("response", "revisit").alias("capture"), first("request").alias("request"), first("metadata").alias("metadata")
    )
