"""WARC archives: writing, reading and revisit resolution.

Headers (digest, page) are grouped by payload digest; the record of smallest page_id of equal payloads stays a response, the others
become revisits that refer to it. Only digests that several records have are joined back, as a table of known size: Spark sends it
to the payloads where it is small, so that these stay where they are, and else deals both out by digest. Every record is written as a gzip member of its own, so any
can be read by its offset; archives of bounded size are rows of Spark's own text writer, whose line separator is an empty gzip member at the end of the file, so
a lost executor's files are written anew and committed once. Reading goes through
the binary reader and follows the content lengths, unzipping a bounded piece at a time; revisits are joined to the responses they refer to.

Defined cases. A null payload is empty. Records with payloads under min_bytes are all responses. Rows with the smallest
page_id of a payload are all responses, if repeated. A null page_id is never the smallest one; where all are null
all are responses. A URL with control characters is form-encoded in its header; a null URL leaves its header out. An
empty table gives no archives. Very long payloads are written and read whole, one at a time. Only the columns named are read, so others may have any names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored

END = "\r\n\r\n"
#: A gzip member without content.
NOTHING = bytes.fromhex("1f8b08000000000000ff") + bytes.fromhex("0300") + bytes(8)
#: Before a URL that holds control characters or spaces, form-encoded to fit a header.
ESCAPED = "x-escaped:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id bigint, record_id string, record_type string, refers_to string, url string, payload_bytes bigint, payload_digest string, payload binary"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 40 hex digits: 5 of these are 4 of those."""
    groups = [F.lpad(F.conv(F.substring(sha1_hex, i, 5), 16, 32), 4, "0") for i in range(1, 40, 5)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, digest: Column) -> Column:
    """The same for the same record whenever it is written."""
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))


def resolved(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """records (page_id, url, payload) with digest, bytes and first: the page that a revisit refers to, null for responses."""
    payload = F.coalesce(F.col("payload"), F.lit("").cast("binary"))
    # md5 beside SHA-1: payloads made to collide in one are still told apart
    headers = records.select("page_id", F.octet_length(payload).alias("bytes"), F.concat(F.unhex(F.sha1(payload)), F.unhex(F.md5(payload))).alias("__key"))
    copied = headers.where(F.col("bytes") >= min_bytes).groupBy("__key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    first = stored(copied.select("__key", "first"), "warc-copies")
    known = records.select("page_id", "url", payload.alias("payload")).withColumns({"bytes": F.octet_length("payload").cast("bigint"), "digest": base32(F.sha1("payload")), "__key": F.concat(F.unhex(F.sha1("payload")), F.unhex(F.md5("payload")))})
    return (
        known.join(first, "__key", "left")  # by its size a broadcast, or AQE splits a payload that many pages share
        .withColumn("first", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")))
        .select("page_id", "url", "payload", "bytes", "digest", "first")
    )


def _archives(most_bytes: int, level: int):
    """Rows (value), each a record, as archives (value) of about most_bytes: a gzip member a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])
        held = 0
        for batch in batches:
            for record in batch.column(0):
                members.append(gzip.compress(record.as_py() + END.encode(), level, mtime=0))
                held += len(members[-1])
                if held >= most_bytes:
                    yield pack()
                    members, held = [], 0
        if members:
            yield pack()

    return run


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", most_bytes: int = 1 << 25, level: int = 6) -> None:
    """records as resolved() gives them, as gzipped WARC 1.1 files of about most_bytes with fresh headers; revisits without their payload."""
    crlf, revisit = "\r\n", F.col("first").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(crlf)), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    escaped = F.concat(F.lit(ESCAPED), F.url_encode("url"))
    url = F.when(F.col("url").rlike(rf"[\x00-\x20\x7F]|^{ESCAPED}"), escaped).otherwise(F.col("url"))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(crlf),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("page_id"), F.col("digest")), F.lit(">"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("Page-ID", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("first"), F.col("digest")), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), F.lit("Content-Length: "), size.cast("string"), F.lit(END), http,
    )
    value = F.concat(head.cast("binary"), F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")))
    archives = records.select(value.alias("value")).mapInArrow(_archives(most_bytes, level), "value binary")
    # Bytes as they are: a value is not looked into, and the separator's characters stand for its bytes.
    archives.select(F.col("value").cast("string").alias("value")).write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in a stream of bytes; holds one record and one chunk at a time."""
    held, wanted = bytearray(), 0
    for chunk in chunks:
        held += chunk
        if len(held) < wanted:
            continue
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            lines = held[at:end].decode("utf-8").split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            stop = end + 4 + int(headers["Content-Length"])
            wanted = stop + 4 - at
            if len(held) < stop + 4:
                break
            yield headers, bytes(held[end + 4 : stop])
            at, wanted = stop + 4, 0
        del held[:at]
    if held:
        raise ValueError("an archive ends inside a record")


def _unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of one or more gzip members in pieces of step bytes at most, however well they compress."""
    view, at, z = memoryview(data), 0, None
    while at < len(data):
        z = zlib.decompressobj(31)
        chunk = view[at : at + step]
        while not z.eof:
            at += len(chunk)
            if out := z.decompress(chunk, step):
                yield out
            rest = z.unconsumed_tail
            if z.eof:
                at -= len(z.unused_data)
            elif rest:
                at -= len(rest)
            elif at >= len(data) and not out:
                raise ValueError("an archive is cut short")
            chunk = view[at : at + step]


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives as READ says; each response's digest is recomputed from its payload. Payloads only if asked for."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "record_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload"]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)
        for batch in rows:
            for content in batch.column(0):
                out, held = [], 0
                for headers, block in parsed(_unzipped(content.as_py())):
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    response, payload = headers["WARC-Type"] == "response", None
                    if response:
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{headers['WARC-Record-ID']}: the payload doesn't have its digest")
                    url = headers.get("WARC-Target-URI")
                    url = unquote_plus(url.removeprefix(ESCAPED)) if url and url.startswith(ESCAPED) else url
                    page = headers.get("Page-ID")
                    out.append((int(page) if page else None, headers["WARC-Record-ID"], headers["WARC-Type"], headers.get("WARC-Refers-To"), url, len(payload) if response else None, digest, payload if payloads else None))
                    held += len(block) if payloads else 0
                    if len(out) >= 5_000 or held > 1 << 25:
                        yield pack(out)
                        out, held = [], 0
                yield pack(out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def with_originals(read: DataFrame) -> DataFrame:
    """Records as read, revisits with the size and payload of the response they refer to and refers_to its page_id."""
    responses, revisits = read.where("record_type = 'response'"), read.where("record_type = 'revisit'")
    # a repeated page is several equal responses of one id
    originals = responses.groupBy(F.col("record_id").alias("__id")).agg(F.min("page_id").alias("__page"), F.max("payload_bytes").alias("__bytes"), F.max("payload").alias("__payload"))
    joined = revisits.join(originals, F.col("refers_to") == F.col("__id"), "left")
    own = responses.withColumn("refers_to", F.lit(None).cast("bigint"))
    return own.unionByName(joined.select("page_id", "record_id", "record_type", F.col("__page").alias("refers_to"), "url", F.col("__bytes").alias("payload_bytes"), "payload_digest", F.col("__payload").alias("payload")))


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Archives that may hold copies and revisits, written anew with one response for equal payloads."""
    records = with_originals(read_archives(spark, source, payloads=True)).select("page_id", "url", "payload")
    write_archives(resolved(records, min_bytes), target)


def through_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Pages written as deduplicated archives in the shared folder, and their records read back."""
    spark = pages.sparkSession
    records = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("payload"))
    path = shared_path(spark, "warc")
    write_archives(resolved(records, min_bytes), path)
    return with_originals(read_archives(spark, path).drop("payload").withColumn("payload", F.lit(None).cast("binary")))
