"""WARC archives: captures written as records, and assembled again from them.

A capture is a transaction of three records: the response (or a revisit that refers to an
earlier response with the same payload), its request and its metadata; the latter two name
the first by ``WARC-Concurrent-To``.  Archives are written and read through Spark's file
sources only, so that any shared store serves.  Reading joins the records of a transaction
into one nested row.

Cases: a null html is an empty payload; a null url or page_id is left out of the headers
and read back as null; payloads under ``min_dedup_bytes`` are always responses; of equal
payloads, all rows with the smallest page_id are responses; a repeated row is written and
read back as often as it occurs; an empty table gives empty archives; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.texts import has_columns
from veriscope.shared import broadcast_if_small, settle, shared_folder

MIN_DEDUP_BYTES = 100
ARCHIVE_BYTES = 32 * 1024 * 1024
CLASS_BYTES = 8 * 1024  # the longest payload of the smallest size class
# Fixed values of the format.
VERSION = "WARC/1.1"
NEWLINE = "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
          "page_id long, payload_digest string, declared_digest string, payload_bytes long, payload binary")


def record_id(page_id: Column, url: Column, digest: Column, kind: str) -> Column:
    """The same id for the same capture, in the form of a UUID."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in (page_id, digest, url)]
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(kind: Column | str, headers: dict[str, Column], block: Column) -> Column:
    """A record without the empty lines that end it; null headers are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(NEWLINE, *lines), F.lit(RECORD_END), block)


def first_captures(pages: DataFrame, min_dedup_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Per payload that occurs more than once: its digest and the smallest (page_id, url)."""
    order = F.struct(F.isnull("page_id").alias("none"), "page_id", "url")
    return (
        pages.where(F.col("payload_bytes") >= min_dedup_bytes)
        .groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", F.col("first.page_id").alias("first_page_id"),
                               F.col("first.url").alias("first_url"))
    )


def size_class(payload_bytes: Column) -> Column:
    """0 for up to ``CLASS_BYTES``; every further class holds payloads up to four times as long."""
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(payload_bytes, F.lit(1)) / CLASS_BYTES))).cast("int")


def write_archives(pages: DataFrame, folder: str, min_dedup_bytes: int = MIN_DEDUP_BYTES) -> None:
    """Write request, response or revisit, and metadata of every page to archives in ``folder``.

    Records end with the separator of the text sink, which is the format's own.  Pages are
    written by size class, with as many records to an archive as its largest
    pages allow: no archive exceeds ``ARCHIVE_BYTES`` by more than a page and its headers.
    """
    has_columns(pages, "page_id", "url", "html")
    payload = F.coalesce(pages["html"], F.lit(""))
    known = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"),
                         F.octet_length(payload).cast("long").alias("payload_bytes"))
    firsts = broadcast_if_small(settle(first_captures(known, min_dedup_bytes)))
    revisit = F.col("first_page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page_id"))
    held = known.join(firsts, "digest", "left").withColumn("revisit", revisit)
    ids = {k: record_id(F.col("page_id"), F.col("url"), F.col("digest"), k) for k in ("capture", "request", "metadata")}
    # a line break in a url would end its header
    uri = F.regexp_replace("url", "[\r\n]", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    referred = record_id(F.col("first_page_id"), F.col("first_url"), F.col("digest"), "capture")
    capture = record(F.when(F.col("revisit"), "revisit").otherwise("response"), {
        "WARC-Record-ID": ids["capture"],
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest")),
        "WARC-Profile": F.when(F.col("revisit"), REVISIT_PROFILE),
        "WARC-Refers-To": F.when(F.col("revisit"), referred),
        "Content-Type": F.lit("application/http;msgtype=response"),
    }, F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))))
    beside = {"WARC-Concurrent-To": ids["capture"], "WARC-Target-URI": uri}
    request = record("request", {
        "WARC-Record-ID": ids["request"], **beside, "Content-Type": F.lit("application/http;msgtype=request"),
    }, F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + RECORD_END)))
    metadata = record("metadata", {
        "WARC-Record-ID": ids["metadata"], **beside, "Content-Type": F.lit("application/warc-fields"),
    }, F.concat_ws("", F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(NEWLINE)))
    records = F.explode(F.array(request, capture, metadata)).alias("value")
    classes = pages.select(size_class(F.octet_length(payload)).alias("no")).distinct().collect()  # some ten rows
    for no in sorted(r["no"] for r in classes) or [0]:
        captures = max(1, ARCHIVE_BYTES // (CLASS_BYTES << 2 * no))
        (
            held.where(size_class(F.col("payload_bytes")) == no).select(records)
            .write.option("lineSep", RECORD_END).option("maxRecordsPerFile", 3 * captures).mode("append").text(folder)
        )


def parsed_records(content: memoryview, with_payload: bool):
    """The records of one archive, found by their lengths alone."""
    at, end = 0, len(content)
    while at < end:
        head = bytes(content[at:at + 4096])
        size = 4096
        while (stop := head.find(b"\r\n\r\n")) < 0:
            if at + size >= end:
                raise ValueError(f"the archive ends in the headers of the record at byte {at}")
            size *= 2
            head = bytes(content[at:at + size])
        lines = head[:stop].decode("utf-8").split(NEWLINE)
        if lines[0] != VERSION:
            raise ValueError(f"no record begins at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = at + stop + 4
        block = content[start:start + int(fields["Content-Length"])]
        if len(block) < int(fields["Content-Length"]):
            raise ValueError(f"the archive ends in the record at byte {at}")
        at = start + len(block) + 4
        kind, payload, page_id = fields["WARC-Type"], None, None
        if kind == "response":
            opening = bytes(block[:4096])
            payload = block[opening.index(b"\r\n\r\n") + 4:]
        elif kind == "metadata":
            value = bytes(block).decode("utf-8").removeprefix("page_id: ").strip()
            page_id = int(value) if value else None
        yield {
            "record_id": fields["WARC-Record-ID"], "type": kind,
            "concurrent_to": fields.get("WARC-Concurrent-To"), "refers_to": fields.get("WARC-Refers-To"),
            "target_uri": fields.get("WARC-Target-URI"), "page_id": page_id,
            "payload_digest": None if payload is None else hashlib.sha256(payload).hexdigest(),
            "declared_digest": (fields.get("WARC-Payload-Digest") or "").removeprefix("sha256:") or None,
            "payload_bytes": None if payload is None else len(payload),
            "payload": bytes(payload) if with_payload and payload is not None else None,
        }


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in ``folder``; digests and lengths are of the bytes read."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                found, size = [], 0
                for item in parsed_records(memoryview(content.as_buffer()), with_payload):
                    found.append(item)
                    size += len(item["payload"] or b"") + 500
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(found, schema=schema).select(names)
                        found, size = [], 0
                yield pa.RecordBatch.from_pylist(found, schema=schema).select(names)

    return archives.mapInArrow(parse, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture``, ``request``, ``metadata`` and, for a revisit,
    ``original`` (the response it refers to).

    Requests and metadata find their capture by ``concurrent_to``.  Payloads stay on the
    capture's side; the other sides are a few short columns.
    """
    captured = records.where(F.col("type").isin("response", "revisit"))
    beside = {
        kind: records.where(F.col("type") == kind).dropDuplicates(["concurrent_to"]).select(
            F.col("concurrent_to").alias("record_id"),
            F.struct(F.col("record_id"), "target_uri", "page_id").alias(kind))
        for kind in ("request", "metadata")
    }
    whole = captured.join(beside["request"], "record_id", "left").join(beside["metadata"], "record_id", "left").select(
        "record_id", "refers_to", "request", "metadata",
        F.struct("record_id", "type", "target_uri", "refers_to", "payload_digest", "declared_digest",
                 "payload_bytes", "payload").alias("capture"))
    originals = whole.where("capture.type = 'response'").dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("refers_to"),
        F.struct(F.col("metadata.page_id").alias("page_id"), "capture.payload_digest",
                 "capture.payload_bytes").alias("original"))
    revisits = whole.where("refers_to IS NOT NULL").join(originals, "refers_to", "left")
    columns = ("capture", "request", "metadata", "original")
    plain = whole.where("refers_to IS NULL").withColumn("original", F.lit(None).cast(originals.schema["original"].dataType))
    return plain.select(*columns).unionByName(revisits.select(*columns))


ORACLE = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


def op10_warc(spark, sf_dir):
    """All pages written to archives, and what the archives say about each."""
    folder = f"{shared_folder(spark)}/veriscope-warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = settle(read_records(spark, folder, with_payload=False), compact=True)
    return assembled(records).select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("original.payload_bytes", "capture.payload_bytes").alias("payload_bytes"),
        F.coalesce("original.payload_digest", "capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.col("original.page_id").alias("refers_to"),
    )
