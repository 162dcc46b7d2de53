"""WARC archives with resolved revisits.

Headers are shuffled by payload digest: of equal payloads of at least ``least`` bytes the
record with the smallest page_id becomes the response, the others are joined to it and
become revisits without payload. Archives are written with fresh headers and read back.

Defined results: a null html is an empty payload; a null page_id counts after all others
and is read back as null; rows that repeat the smallest page_id with the same payload are
all responses; an empty table gives archives without records. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BYTES = 100
RECORDS_PER_FILE = 5_000
_END = "\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to; the
    payload is null in revisits."""
    payload = F.coalesce("html", F.lit(""))
    records = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    originals = (
        records.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"))
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        records.join(originals, "payload_digest", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .withColumn("payload", F.when(~revisit, F.col("payload")))
        .drop("first_id")
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    text = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(" "), digest).cast("binary"))
    parts = [F.substring(text, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _utc_now() -> Column:
    """The time of the run in UTC, whatever the session's time zone shows."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())


def _lines(*lines: tuple[str, Column]) -> Column:
    """Header lines; those with a null value are left out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value, F.lit(_END)) for name, value in lines])


def records_as_text(resolved: DataFrame) -> DataFrame:
    """One column ``record``: a whole record up to, not including, its closing blank lines."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}"),
        _lines(
            ("Content-Type", F.lit("text/html; charset=utf-8")),
            ("Content-Length", F.col("payload_bytes").cast("string")),
        ),
        F.lit(_END),
    )
    block = F.concat(http, F.coalesce("payload", F.lit("")))
    digest = F.col("payload_digest")
    head = _lines(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _record_id(F.col("page_id"), digest)),
        ("WARC-Date", F.date_format(_utc_now(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        ("WARC-Profile", F.when(revisit, F.lit(_REVISIT))),
        ("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), digest))),
        ("X-Page-Id", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        ("X-Payload-Length", F.col("payload_bytes").cast("string")),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return resolved.select(F.concat(F.lit(f"WARC/1.1{_END}"), head, F.lit(_END), block).alias("record"))


def write_archives(resolved: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Gzipped archives in ``path``; the line separator of the writer closes each record."""
    (
        records_as_text(resolved)
        .write.option("lineSep", _END * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def _parse(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split(_END)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        begin = head_end + 4
        end = begin + int(head["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        at = end + 4
        kind = head["WARC-Type"]
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(head["X-Payload-Length"])
        payload = None
        if kind == "response":
            payload = data[data.index(b"\r\n\r\n", begin) + 4 : end]
            size, found = len(payload), hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError(f"payload digest {found} is not {digest}")
        page_id, refers_to = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
        yield {
            "page_id": None if page_id is None else int(page_id),
            "target_uri": head.get("WARC-Target-URI"),
            "payload": payload,
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": None if refers_to is None else int(refers_to),
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``path``; lengths and digests of payloads are those of
    the bytes read. A damaged archive raises an error."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("target_uri", pa.string()),
            ("payload", pa.binary()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = zlib.decompress(content.as_py(), wbits=31)
                rows = list(_parse(data))
                if not payloads:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(
        run,
        "page_id long, target_uri string, payload binary, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long",
    )
