"""WARC archives: writing captures, reading records, and assembling transactions.

Archives are gzip files of WARC records, written and read by Spark's text source with the blank line as separator, so
any store that Spark reaches will do and a task holds one record at a time. A file is one gzip member with the name that
Spark gives it: it reads from its start, and nothing can seek to a record within. A reader joins the pieces again by
Content-Length, so payloads may hold blank lines or whole records.

Defined results: a null payload is empty; a null page id is written as none and read as null, and is less than any
other; each row is a capture, also where rows repeat; of equal payloads all rows with the largest page id are responses;
what is not a record is returned with type `invalid`, a record cut off by the end of a file with truncated true.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

SEPARATOR = "\r\n\r\n"
VERSION = "WARC/1.1"
#: Fixed value: the profile of a revisit of the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MAINS = ("response", "revisit", "resource")
FIELDS = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, declared_digest string, http string, payload binary, payload_bytes long, payload_digest string, truncated boolean"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: each five hex digits are four digits of 32."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, record_id: Column, url: Column, content_type: str, block: Column, *more: tuple[str, Column]) -> Column:
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.concat(F.lit("WARC-Target-URI: "), url), *(F.concat(F.lit(f"{k}: "), v) for k, v in more), F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(SEPARATOR), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Writes a response or revisit, a request and a metadata record for each page, beside each other.

    Of equal payloads of least_bytes or more, the page with the largest id (then address) keeps the payload. Payloads
    are digested where they are read; only ids of payloads that repeat are joined. Only if rows repeat in all that names
    a record, the pages are written once with a mark for each.
    """
    scratch = Scratch(pages.sparkSession, "warc-write")
    clean = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    df = pages.select(F.col(id_col).cast("long").alias("id"), clean.alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    enough = F.octet_length("payload") >= least_bytes
    once = df.groupBy("digest", "id", "url", enough.alias("enough")).agg(F.count("*").alias("n"))
    found = once.groupBy("digest").agg(F.max(F.struct("id", "url", F.lit(0).cast("long").alias("mark"))).alias("top"), F.sum("n").alias("n"), F.max("n").alias("same"), F.max("enough").alias("enough"))
    found = scratch.write(found.where("n > 1"))
    if found.where("same > 1").isEmpty():
        df = df.withColumn("mark", F.lit(0).cast("long"))
    else:
        df = scratch.write(df.withColumn("mark", F.monotonically_increasing_id()))
        found = scratch.write(df.groupBy("digest").agg(F.max(F.struct("id", "url", "mark")).alias("top"), F.count("*").alias("n"), F.max(enough).alias("enough")).where("n > 1"))
    df = df.join(broadcast_if_small(found.where("enough").select("digest", "top")), "digest", "left")
    revisit = F.col("top").isNotNull() & ~F.col("top.id").eqNullSafe(F.col("id"))
    main = _urn("main", F.col("id"), F.col("url"), F.col("digest"), F.col("mark"))
    first = _urn("main", F.col("top.id"), F.col("top.url"), F.col("digest"), F.col("top.mark"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(SEPARATOR))
    url, digest = F.col("url"), F.concat(F.lit("sha1:"), F.col("digest"))
    host, target = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://([^/?#]*)", 1), F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://[^/?#]*([^#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(SEPARATOR))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n"))
    records = F.array(
        F.when(revisit, _record("revisit", main, url, "application/http; msgtype=response", http, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", first), ("WARC-Payload-Digest", digest))).otherwise(_record("response", main, url, "application/http; msgtype=response", F.concat(http, F.col("payload")), ("WARC-Payload-Digest", digest))),
        _record("request", _urn("request", main), url, "application/http; msgtype=request", request, ("WARC-Concurrent-To", main)),
        _record("metadata", _urn("metadata", main), url, "application/warc-fields", fields, ("WARC-Concurrent-To", main)),
    )
    df.select(F.explode(records).alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes, bool]]:
    """(head, block, truncated) of each record from a file's pieces between blank lines."""
    sep, rest = SEPARATOR.encode(), None
    while True:
        head = rest if rest is not None else next(pieces, None)
        rest = None
        if head is None:
            return
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        need = 0
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                need = int(value)
        if not head.startswith(b"WARC/"):
            yield head, b"", False
            continue
        block, truncated = [], False
        while True:
            piece = next(pieces, None)
            if piece is None:
                truncated = need > 0
                break
            block.append(piece[:need])
            if len(piece) >= need:
                rest = piece[need:] if len(piece) > need else None
                break
            need -= len(piece)
            block.append(sep[:need])
            need -= min(need, len(sep))
            if not need:
                break
        yield head, b"".join(block), truncated


def _parsed(head: bytes, block: bytes, truncated: bool) -> dict:
    if not head.startswith(b"WARC/"):
        return {"type": "invalid", "payload": head, "payload_bytes": len(head), "truncated": truncated}
    fields: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), []).append(value.strip())
    one = lambda k: fields.get(k, [None])[0]
    http, payload = None, block
    if (one("content-type") or "").startswith("application/http"):
        h, found, payload = block.partition(SEPARATOR.encode())
        http = h.decode("utf-8", "replace")
    return {
        "record_id": one("warc-record-id"), "type": one("warc-type"), "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "target_uri": one("warc-target-uri"),
        "date": one("warc-date"), "declared_digest": one("warc-payload-digest"), "http": http, "payload": payload, "payload_bytes": len(payload),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "truncated": truncated,
    }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the .warc.gz files at a path. A compressed file is read by one task, in order."""
    pieces = spark.read.option("lineSep", SEPARATOR).text(path, pathGlobFilter="*.gz").select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("declared_digest", pa.string()), ("http", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("truncated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        ahead = next(flat, None)

        def of_file(name: str) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[0] == name:
                piece = ahead[1]
                ahead = next(flat, None)
                yield piece

        out, size = [], 0
        while ahead is not None:
            for record in split_records(of_file(ahead[0])):
                out.append(_parsed(*record))
                size += len(record[1]) + 1000
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return pieces.mapInArrow(run, FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, response, request and metadata.

    Other records join a response, revisit or resource by a concurrent-to identifier in either direction, or through
    a record that has one; the links are narrow tables of identifiers, and each payload is shuffled once.
    """
    mains = records.where(F.col("type").isin(*MAINS)).dropDuplicates(["record_id"])
    others = records.where(~F.col("type").isin(*MAINS) & F.col("record_id").isNotNull()).dropDuplicates(["record_id"])
    ids = mains.select(F.col("record_id").alias("capture_id"))
    to = others.select(F.col("record_id").alias("member"), F.explode("concurrent_to").alias("target"))
    straight = to.join(ids, F.col("target") == F.col("capture_id")).select("member", "capture_id")
    back = mains.select(F.explode("concurrent_to").alias("member"), F.col("record_id").alias("capture_id"))
    linked = straight.unionAll(back).distinct()
    through = to.join(linked.select(F.col("member").alias("target"), "capture_id"), "target").select("member", "capture_id")
    members = others.join(linked.unionAll(through).distinct().withColumnRenamed("member", "record_id"), "record_id")
    fields = ["record_id", "type", "target_uri", "date", "http", "payload", "payload_bytes", "payload_digest"]
    grouped = members.groupBy("capture_id").agg(
        F.min(F.when(F.col("type") == "request", F.struct(*fields))).alias("request"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", F.struct(*fields)))).alias("metadata"),
    )
    response = F.struct(*fields, "refers_to", "declared_digest", "truncated").alias("response")
    captures = mains.select(F.col("record_id").alias("capture_id"), response).join(grouped, "capture_id", "left")
    return captures.withColumn("metadata", F.coalesce("metadata", F.array().cast(captures.schema["metadata"].dataType)))
