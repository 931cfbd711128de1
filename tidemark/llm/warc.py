"""Operator 13, WARC: archives written as segments and read back by segment reassembly.

A record longer than a segment is written as a first segment and continuation
records. Reading groups the continuations by the identifier of their origin,
orders them by segment number, checks that none is missing and that the lengths
add up to the total which the last one states, and only then decodes the HTTP
body, whose chunked framing may cross segments.

Spark's text files write and read the archives, so any store that Spark reaches
will do: a row is one record, and the version line in front of every record is
what lines are split at. A payload may hold that string too; the reader then
joins pieces until a record has the length that it states. Files are gzipped,
which Spark reads as a stream and doesn't split.

Equal payloads are told by SHA-256 and length. Only slim rows of digests move to
find them; the text of a page is joined once, and that of a revisit never.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder
from .common import BROADCAST_IDS, read_table, small_arrow_batches, stored

SEGMENT_BYTES, CHUNK_BYTES, MIN_BYTES = 8192, 4096, 0
#: A reassembled record is one value; longer ones are reported, not collected.
MAX_RECORD_BYTES = 1 << 30
FLUSH_BYTES = 4 << 20
#: Fixed values of the WARC format.
VERSION, DELIMITER, END = b"WARC/1.1\r\n", "WARC/1.", "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_of_hex(digest: str) -> Column:
    """A SHA-1 of 40 hex digits in base 32: ten hex digits are eight of these."""
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *BASE32)


# ---- which pages are revisits ---------------------------------------------------------------


def _row_key(id_col: str, url_col: str, payload_key: str) -> Column:
    """One value for the id, the address and the payload of a row; nulls count."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("\n", part(id_col), payload_key, part(url_col)), 256)


def _small(df: DataFrame) -> DataFrame:
    """df for the side of a join that has one row a key: broadcast where its count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per record to write, without payloads: row_key, page_id, url, bytes, sha1, n, copy, refers_key (null: a response).

    Of records with equal payloads of at least min_bytes bytes the one of the
    smallest id (null last, then smallest address) is the response. Rows repeated
    with one id, address and payload are copies 0, 1, 2 ... n - 1 of one row_key;
    at most copy 0 is the response.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("b")).select(
        "page_id", "url", F.octet_length("b").cast("long").alias("bytes"), F.sha1("b").alias("sha1"), F.sha2("b", 256).alias("payload"))
    slim = slim.withColumn("row_key", _row_key("page_id", "url", "payload"))
    rows = stored(slim.groupBy("row_key", "page_id", "url", "bytes", "sha1", "payload").agg(F.count("*").alias("n")), "warc-rows")
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id"), F.col("url").isNull().alias("no_url"), F.col("url").alias("u"), F.col("row_key").alias("key")))
    groups = rows.where(F.col("bytes") >= min_bytes).groupBy("payload", "bytes").agg(first.alias("first"), F.sum("n").alias("size"))
    groups = stored(groups.where("size > 1").select("payload", F.col("bytes").alias("group_bytes"), F.col("first.key").alias("origin")), "warc-groups")
    joined = rows.join(_small(groups), "payload", "left").where("group_bytes is null or group_bytes = bytes")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    is_response = F.col("origin").isNull() | ((F.col("row_key") == F.col("origin")) & (F.col("copy") == 0))
    return copies.select("row_key", "page_id", "url", "bytes", "sha1", "n", "copy", F.when(~is_response, F.col("origin")).alias("refers_key"))


# ---- writing --------------------------------------------------------------------------------


def record_id(row_key: str, copy: int, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{row_key}/{copy}/{segment}'.encode()).digest()[:16], version=4)}>"


def address(url: str | None) -> str:
    """A page's address as a header may hold it: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    parts = [payload[i : i + chunk_bytes] for i in range(0, len(payload), chunk_bytes)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def warc_record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without what follows its block; headers of None are left out."""
    lines = [f"{name}: {value}\r\n".encode() for name, value in [*headers, ("Content-Length", len(block))] if value is not None]
    return b"".join([VERSION, *lines, b"\r\n", block])


def page_records(page: dict, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in as many segments as it takes."""
    digest = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
    target, shared = address(page["url"]) or None, [("WARC-Page-ID", page["page_id"]), ("WARC-Payload-Digest", f"sha1:{digest}")]
    own = record_id(page["row_key"], page["copy"])
    if page["refers_key"] is not None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Target-URI", target), ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(page["refers_key"], 0)), *shared]
        yield warc_record([*head, ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    payload = (page["html"] or "").encode()
    framing = b"Transfer-Encoding: chunked" if chunk_bytes else b"Content-Length: %d" % len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%b\r\n\r\n" % framing + (chunked(payload, chunk_bytes) if chunk_bytes else payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Target-URI", target), *shared, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield warc_record([*head, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")], block)
        return
    for at in range(0, len(block), segment_bytes):
        number, part = at // segment_bytes + 1, block[at : at + segment_bytes]
        check, number_ = ("WARC-Block-Digest", f"sha1:{base32_sha1(part)}"), ("WARC-Segment-Number", number)
        if number == 1:
            yield warc_record([*head, number_, check], part)
            continue
        last = len(block) if at + segment_bytes >= len(block) else None
        origin = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page["row_key"], page["copy"], number)), ("WARC-Segment-Origin-ID", own)]
        yield warc_record([*origin, ("WARC-Target-URI", target), number_, ("WARC-Segment-Total-Length", last), check], part)


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = MIN_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> None:
    """Write a record for each row of pages to gzipped WARC files in the folder path, which must not exist.

    Null html is an empty payload and a null address no address; rows without an
    id are written without one. segment_bytes is the longest block of a record,
    chunk_bytes the length of an HTTP chunk (0: no chunked framing). Other
    columns are ignored; an empty table gives a folder without records.
    """
    if segment_bytes < 1 or chunk_bytes < 0:
        raise ValueError("segment_bytes must be positive and chunk_bytes 0 or more")
    small_arrow_batches(pages.sparkSession)
    plan = stored(plan_records(pages, id_col, url_col, html_col, min_bytes), "warc-plan")
    html = F.coalesce(html_col, F.lit(""))
    body = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("sha1", F.sha1("html"))
    body = body.withColumn("row_key", _row_key("page_id", "url", F.sha2("html", 256)))
    # A page is its own response unless the plan says otherwise, so only the keys of those others move while they are few enough.
    others = stored(plan.where("refers_key is not null or n > 1").select("row_key").distinct(), "warc-others")
    rows = body.join(_small(others), "row_key", "left_anti").withColumns({"copy": F.lit(0).cast("long"), "refers_key": F.lit(None).cast("string")})
    rows = rows.unionByName(plan.where("refers_key is not null").withColumn("html", F.lit(None).cast("string")).select(*rows.columns))
    repeated = plan.where("refers_key is null and n > 1")
    if repeated.take(1):  # of rows repeated in full one gives the payload
        one = body.join(_small(stored(repeated.select("row_key").distinct(), "warc-repeated")), "row_key", "left_semi").dropDuplicates(["row_key"])
        rows = rows.unionByName(one.join(repeated.select("row_key", "copy", "refers_key"), "row_key").select(*rows.columns))
    rows = rows.withColumn("page_id", F.col("page_id").cast("string"))

    def records(batches):
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", TaskContext.get().partitionId())), ("Content-Type", "application/warc-fields")]
        out, size = [warc_record(info, b"format: WARC File Format 1.1\r\n")], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for r in page_records({name: batch.column(name)[i].as_py() for name in batch.schema.names}, segment_bytes, chunk_bytes):
                    out.append(r)
                    size += len(r)
                if size >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


# ---- reading --------------------------------------------------------------------------------


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; of repeated names the first counts, folded lines are joined."""
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            key, value = line.split(":", 1)
            name = key.strip().lower()
            if name in fields:
                name = None
            else:
                fields[name] = value.strip()
    return fields


def cut_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields, block and fault of each record, from what stands between version strings: (file, piece) in file order.

    A piece that ends before its record does is joined with those that follow in its file.
    """
    file, buffer = None, None  # buffer: the record begun, from behind "WARC/1."
    need = None  # bytes of the buffer up to the block's end
    fields: dict[str, str] = {}

    def look():
        nonlocal need, fields
        end = buffer.find(b"\r\n\r\n")
        if end >= 0:
            fields = parse_head(bytes(buffer[:end]))
            size = fields.get("content-length", "")
            need = end + 4 + int(size) if size.isascii() and size.isdigit() else end + 4

    def finish():
        if buffer is None:
            return
        if need is None:
            if buffer.strip():
                yield parse_head(bytes(buffer)), b"", "no header end"
            return
        fault = None if "content-length" in fields else "no length"
        size = int(fields["content-length"]) if fault is None and fields["content-length"].isdigit() else 0
        if len(buffer) < need:
            fault = "truncated"
        yield fields, bytes(buffer[need - size : need]), fault

    for where, piece in pieces:
        if where != file:
            yield from finish()
            file, buffer, need = where, None, None
            if not piece.strip():
                continue  # what stands before the first version string
        if buffer is not None and (need is None or len(buffer) < need):
            buffer += DELIMITER.encode() + piece  # the string stood inside a record
        else:
            yield from finish()
            buffer, need = bytearray(piece), None
        if need is None:
            look()
    yield from finish()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of WARC files: record_id, type, page_id, target_uri, refers_to, payload_digest, segment, origin_id, total_length, block, fault.

    fault is null, or says why a record can't be trusted: truncated, no length,
    no header end, an unreadable segment number (then 0), or a block digest (SHA-1) that differs. gzip files are read as streams. An uncompressed
    file may be split by Spark; a record that holds the version string itself and
    lies across two splits is then reported as truncated.
    """
    small_arrow_batches(spark)
    texts = spark.read.option("lineSep", DELIMITER).option("recursiveFileLookup", True).text(path)
    split = F.concat_ws("@", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string"))
    pieces = texts.select(split.alias("file"), F.col("value").cast("binary").alias("piece"))
    kinds = "record_id string, type string, page_id string, target_uri string, refers_to string, payload_digest string, segment long, origin_id string, total_length long, block binary, fault string"
    names = ["warc-record-id", "warc-type", "warc-page-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "warc-segment-number", "warc-segment-origin-id", "warc-segment-total-length"]
    numbers = {"warc-segment-number", "warc-segment-total-length"}

    def parse(batches):
        columns = [k.split()[0] for k in kinds.split(", ")]
        types = [pa.int64() if n in numbers else pa.string() for n in names] + [pa.binary(), pa.string()]
        rows, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], columns)

        given = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for fields, block, fault in cut_records(given):
            stated = fields.get("warc-block-digest", "")
            if fault is None and stated.lower().startswith("sha1:") and stated[5:].upper() != base32_sha1(block):
                fault = "block digest"
            values = [fields.get(n) for n in names]
            values = [(int(v) if v and v.isascii() and v.isdigit() and len(v) < 19 else None) if n in numbers else v for n, v in zip(names, values, strict=True)]
            if values[6] is None and (fields.get("warc-type") == "continuation" or "warc-segment-number" in fields):
                values[6], fault = 0, fault or "segment number"
            rows.append((*values, block, fault))
            size += len(block)
            if size >= FLUSH_BYTES or len(rows) >= 4096:
                yield flush()
                rows, size = [], 0
        yield flush()

    return pieces.mapInArrow(parse, kinds)


def reassembled(records: DataFrame, max_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """Records in segments, made whole: record_id, page_id, payload_digest, block, fault.

    records are read several times, so they should be stored. Lengths and numbers
    are added up first, and only sets that are complete, in agreement with their
    total and of at most max_bytes bytes have their blocks brought together.
    Faults: missing segment, repeated segment, no total length, total length, too
    long, or that of a segment. A continuation whose origin is not there is
    reported under the origin's identifier.
    """
    parts = records.where("segment is not null").withColumn("whole_id", F.coalesce("origin_id", "record_id"))
    sets = parts.groupBy("whole_id").agg(
        F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"),
        F.sum(F.octet_length("block")).alias("bytes"), F.max("total_length").alias("total"), F.min("fault").alias("part_fault"),
        F.max(F.when(F.col("origin_id").isNull(), F.col("page_id"))).alias("page_id"), F.max(F.when(F.col("origin_id").isNull(), F.col("payload_digest"))).alias("payload_digest"),
    )
    n = F.col("n")
    fault = (
        F.when(F.col("part_fault").isNotNull(), F.col("part_fault"))
        .when(F.col("high") < n, "repeated segment")
        .when((F.col("low") != 1) | (F.col("high") != n), "missing segment")  # whether each of 1 .. n is there, sort_array tells below
        .when(F.col("total").isNull(), "no total length")
        .when(F.col("total") != F.col("bytes"), "total length")
        .when(F.col("bytes") > max_bytes, "too long")
    )
    sets = stored(sets.select("whole_id", "page_id", "payload_digest", n, fault.alias("fault")), "warc-sets")
    good = sets.where("fault is null").select("whole_id", "page_id", "payload_digest", n)
    blocks = parts.join(_small(sets.where("fault is not null").select("whole_id")), "whole_id", "left_anti").groupBy("whole_id")
    blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1).cast("long"), F.col("n"))
    block = F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["block"]))
    whole = blocks.join(good, "whole_id").select("whole_id", "page_id", "payload_digest", F.when(order, block).alias("block"), F.when(~order, "missing segment").alias("fault"))
    broken = sets.where("fault is not null").select("whole_id", "page_id", "payload_digest", F.lit(None).cast("binary").alias("block"), "fault")
    return whole.unionByName(broken).withColumnRenamed("whole_id", "record_id")


def decode_http(block: bytes) -> tuple[bytes | None, str | None]:
    """Payload of an HTTP response, its chunked framing taken off, and the fault if it can't be told."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return None, "no HTTP header"
    fields, at = parse_head(block[:end]), end + 4
    if fields.get("transfer-encoding", "").lower().split(",")[-1].strip() != "chunked":
        size = fields.get("content-length")
        if size is not None and (not size.isdigit() or int(size) != len(block) - at):
            return None, "HTTP length"
        return block[at:], None
    parts = []
    while True:
        line = block.find(b"\r\n", at)
        digits = block[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None, "chunk size"
        size, at = int(digits, 16), line + 2
        if not size:  # trailers may follow, up to an empty line
            closed = block[at:] == b"\r\n" or block[at:].endswith(b"\r\n\r\n")
            return (b"".join(parts), None) if closed else (None, "chunk end")
        if block[at + size : at + size + 2] != b"\r\n":
            return None, "chunk length"
        parts.append(block[at : at + size])
        at += size + 2


def _payloads(records: DataFrame) -> DataFrame:
    """record_id, page_id, record_type, refers_to, payload, payload_digest and fault of whole responses and of revisits, which have no payload."""
    columns = ["record_id", "page_id", "type", "refers_to", "payload_digest"]

    def decode(batches):
        for batch in batches:
            payloads, faults = [], []
            for kind, stated, block, fault in zip(*(batch.column(n).to_pylist() for n in ("type", "payload_digest", "block", "fault")), strict=True):
                payload = None
                if fault is None and kind == "response":
                    payload, fault = decode_http(block)
                if payload is not None and (stated or "").lower().startswith("sha1:") and stated[5:].upper() != base32_sha1(payload):
                    payload, fault = None, "payload digest"
                payloads.append(payload)
                faults.append(fault)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(payloads, pa.binary()), pa.array(faults, pa.string())], [*columns, "payload", "fault"])

    out = records.select(*columns, "block", "fault").mapInArrow(decode, ", ".join(f"{c} string" for c in columns) + ", payload binary, fault string")
    stated = F.regexp_extract("payload_digest", "^(?i:sha1):(.*)$", 1)
    digest = F.when(F.col("type") == "revisit", stated).otherwise(base32_of_hex(F.sha1("payload")))
    return out.select("record_id", "page_id", F.col("type").alias("record_type"), "refers_to", "payload", digest.alias("payload_digest"), "fault")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of WARC files: record_id, page_id, record_type, refers_to (a record's identifier), payload, payload_digest, fault.

    Segments are reassembled and payloads decoded. A revisit has no payload of
    its own and states the digest of the one it refers to. Rows with a fault
    (those of read_records, reassembled and decode_http, or a payload digest that
    differs) have no payload. page_id is the string that the archive states.
    Other record types give no rows.
    """
    records = read_records(spark, path)
    whole = records.where("segment is null and type in ('response', 'revisit')")
    parts = stored(records.where("segment is not null"), "warc-segments")  # the others are decoded as they are read
    made = reassembled(parts).select("record_id", "page_id", F.lit("response").alias("type"), F.lit(None).cast("string").alias("refers_to"), "payload_digest", "block", "fault")
    return _payloads(whole.select(*made.columns).unionByName(made))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of all pages, read back: what each record is and the size and digest of its full payload."""
    path = f"{shared_folder(spark)}/tidemark-warc-{uuid.uuid4().hex}"
    write_archives(read_table(spark, sf_dir, "pages"), path)
    back = read_pages(spark, path)
    slim = stored(back.select("record_id", "page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "fault"), "warc-read")
    origins = slim.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    origins = slim.where("record_type = 'response'").join(_small(stored(origins, "warc-origins")), "record_id", "left_semi")
    origins = origins.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("origin_page"), F.col("payload_bytes").alias("origin_bytes"), F.col("payload_digest").alias("origin_digest"))
    full = slim.join(_small(stored(origins, "warc-full")), "refers_to", "left")
    return full.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("payload_bytes", "origin_bytes").alias("payload_bytes"),
        F.coalesce("origin_digest", "payload_digest").alias("payload_digest"),
        "record_type",
        F.col("origin_page").cast("long").alias("refers_to"),
        "fault",
    )


OP13_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS keeper FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to, NULL::VARCHAR AS fault
FROM f
"""
