"""WARC archives in which records with a payload seen elsewhere are revisits."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..session import materialize
from .common import arrow_schema, batches

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE, RECORD_END = "\r\n", "\r\n\r\n"

#: About so many payload bytes go to an archive file, since a task reads one whole; a record has about HEADER_BYTES more.
FILE_BYTES, HEADER_BYTES = 64 << 20, 1 << 10

RECORD = StructType([
    StructField("record_id", StringType()), StructField("record_type", StringType()), StructField("page_id", StringType()),
    StructField("target_uri", StringType()), StructField("payload_digest", StringType()),
    StructField("refers_to_record", StringType()), StructField("payload_bytes", LongType()), StructField("payload", BinaryType())])


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column as 32 base-32 characters: each five bytes of the digest are eight of them."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line, empty where the value is null; control characters are percent-encoded, so it stays one line."""
    safe = value.cast("string")
    for sign, code in (("\r", "%0D"), ("\n", "%0A")):
        safe = F.replace(safe, F.lit(sign), F.lit(code))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(LINE)), F.lit(""))


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers with `original` and `original_page`, the record that holds the payload (its own id for responses).

    Only headers are shuffled, by digest. Of the records with one payload of at
    least `min_bytes` the one with the largest page id is the original; ties go
    to the largest record id, and a null page id is the smallest. Smaller
    payloads are all originals. The originals are an aggregate with one row per
    digest, so a payload that a third of all records share meets them in a join
    that adaptive execution splits.
    """
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    originals = large.groupBy("payload_digest").agg(F.max(F.struct("page_id", "record_id", "target_uri")).alias("_original"))
    found = headers.join(originals, "payload_digest", "left")
    large = F.col("payload_bytes") >= min_bytes
    return found.select(
        *headers.columns, F.when(large, F.col("_original.record_id")).otherwise(F.col("record_id")).alias("original"),
        F.when(large, F.col("_original.target_uri")).otherwise(F.col("target_uri")).alias("original_uri"))


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write a record per row below `path`, gzipped, with payloads that occur more than once stored once.

    The headers are made first and written to a scratch table, so each row has
    a record id that stays the same when a task runs again; revisits are
    resolved on them alone. Payloads are reduced to one row per digest before
    and after the only shuffle in which they take part, and join the responses.
    A null payload is empty, a null url or id leaves out its header line, and
    repeated rows are records of their own. `date` is the WARC-Date (now, if
    not given). A file takes as many records as hold `file_bytes` on average.
    Other columns are not read.
    """
    stamp = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    pages = pages.select("*", base32_sha1(F.col("payload")).alias("payload_digest"))
    headers = materialize(pages.select(
        "page_id", "target_uri", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.monotonically_increasing_id().alias("record_id")), "headers")
    mean = headers.agg(F.coalesce(F.avg("payload_bytes"), F.lit(0.0))).first()[0]
    per_file = max(1, int(file_bytes / (mean + HEADER_BYTES)))
    payloads = pages.groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    is_response = F.col("original") == F.col("record_id")
    records = resolve_revisits(headers, min_bytes).select("*", is_response.alias("response")).join(
        payloads.select(F.col("payload_digest"), "payload", F.lit(True).alias("response")), ["payload_digest", "response"], "left")

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}"),
        F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    block = F.when(F.col("response"), F.concat(http.cast("binary"), F.col("payload"))).otherwise(http.cast("binary"))
    head = F.concat(
        F.lit(f"{VERSION}{LINE}"),
        _line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
        _line("WARC-Record-ID", _record_uri(F.col("record_id"))),
        _line("WARC-Date", F.lit(stamp)),
        _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("response"), F.lit("")).otherwise(F.concat(
            _line("WARC-Profile", F.lit(REVISIT_PROFILE)), _line("WARC-Refers-To", _record_uri(F.col("original"))),
            _line("WARC-Refers-To-Target-URI", F.col("original_uri")))),
        _line("X-Page-ID", F.col("page_id")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)), F.lit(LINE))
    # the text writer puts the bytes down as they are and ends each record as the format asks
    records.select(F.concat(head.cast("binary"), block).cast("string").alias("value")).write.option(
        "lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _record_uri(record_id: Column) -> Column:
    """A URN in the form of a UUID, made from the record's number."""
    digits = F.md5(record_id.cast("string").cast("binary"))
    parts = [F.substring(digits, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records_in(archive: bytes) -> Iterator[dict]:
    """Records of a gzipped archive, one after the other: header lines by lower-case name, and `block`."""
    with gzip.GzipFile(fileobj=io.BytesIO(archive)) as stream:
        reader = io.BufferedReader(stream, 1 << 16)
        while line := reader.readline():
            if line != f"{VERSION}{LINE}".encode():
                raise ValueError(f"a record starts with {line[:40]!r}")
            record = {}
            while (line := reader.readline()) not in (b"\r\n", b""):
                name, _, value = line.partition(b":")
                record[name.decode().lower()] = value.strip().decode("utf-8", "replace")
            size = int(record["content-length"])
            record["block"] = reader.read(size)
            if len(record["block"]) != size or reader.read(4) != RECORD_END.encode():
                raise ValueError("a record is cut off")
            yield record


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives below `path` as `RECORD`; payload and its size only where the record holds it.

    The digest of each payload is computed anew and must be the one in its
    header. A task reads one archive at a time; `with_payload=False` leaves the
    payload in the task. Revisits have neither payload nor size: see `join_originals`.
    """
    out = arrow_schema(RECORD)

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in source:
            for archive in batch.column(0):
                for r in records_in(archive.as_py()):
                    digest, payload = r["warc-payload-digest"].removeprefix("sha1:"), None
                    if r["warc-type"] == "response":
                        payload = r["block"].partition(RECORD_END.encode())[2]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"the payload of {r['warc-record-id']} does not have its digest")
                    yield (r["warc-record-id"], r["warc-type"], r.get("x-page-id"), r.get("warc-target-uri"), digest,
                           r.get("warc-refers-to"), None if payload is None else len(payload), payload if with_payload else None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda s: batches(out, rows(s), lambda r: 300 + len(r[7] or b"")), RECORD)


def join_originals(records: DataFrame) -> DataFrame:
    """Records with `refers_to` (page id of the original, for revisits) and the size of the full payload.

    Revisits meet their original by digest and record id; a response is never
    looked up, and of responses only the header goes through the shuffle.
    """
    originals = records.where("record_type = 'response'").select(
        "payload_digest", F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"))
    return records.join(originals, ["payload_digest", "refers_to_record"], "left").select(
        *[c for c in records.columns if c != "payload_bytes"], F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        "refers_to")
