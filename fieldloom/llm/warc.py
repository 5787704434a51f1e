"""WARC archives: writing, reading back and transaction assembly.

Writing: every page gives three records: ``request`` and ``metadata``, both concurrent to the third, a
``response`` or a ``revisit`` of the response with an equal payload. Records are written by Spark's own text
writer with the record separator of the format (two CRLF) as line separator, gzipped, so that the archives go
through the output committer to whatever store holds the folder, and a lost executor's files are written again.

Reading: each archive is parsed by the lengths in its record headers; payload lengths and digests are taken from
the stored bytes. Assembly joins request, response (or revisit) and metadata through WARC-Concurrent-To and gives
one nested row per capture. A pointer at a request or metadata record is followed once more.

Payloads are shuffled only if more payloads are repeated than a checked broadcast takes. Pages of LARGE bytes and more
get a file each, so that no archive is much larger than FILE_BYTES or its only page.

Defined cases: a null html is an empty payload; a null url gives the target ``urn:page:<id>``; line breaks in a
url are percent-encoded; a null page_id is kept as null and never is the smallest of its group unless all are
null; record identifiers hold the row's place in its table, so repeated rows are captures of their own, of which the
first is the response; an empty table gives no capture; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, maybe_broadcast, scratch, written

#: Payload bytes from which a payload may be stored as a revisit, and uncompressed bytes an archive file aims at.
MIN_REVISIT_BYTES, FILE_BYTES, LARGE = 0, 16 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
_PARSED = "file string, record_offset long, record_id string, warc_type string, concurrent_to string, refers_to string, target_uri string, page_id long, refers_to_page long, payload_bytes long, payload_digest string, digest_ok boolean, fields string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(kind: str, page: str, digest: str, mark: str) -> str:
    h = hashlib.md5(f"{kind}|{page}|{digest}|{mark}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, record_id: str, uri: str, content_type: str, block: str, *more: tuple[str, str]) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    lines += [f"{k}: {v}" for k, v in more] + [f"Content-Type: {content_type}", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def records_of(page_id: int | None, url: str | None, html: str, mark: str, first: int | None, first_mark: str | None, revisit: bool) -> Iterator[str]:
    """The request, main and metadata records of a page, without the separator that ends a record.

    ``mark`` is the row's place in its table: it tells pages of equal number and payload apart.
    """
    payload = html.encode()
    page, digest = "" if page_id is None else str(page_id), base32_sha1(payload)
    uri = (url or f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A")
    main = _urn("main", page, digest, mark)
    own = [("X-Page-Id", page), ("WARC-Payload-Digest", f"sha1:{digest}")]
    yield _record("request", _urn("request", page, digest, mark), uri, "application/http;msgtype=request", f"GET {uri} HTTP/1.1\r\n\r\n", ("WARC-Concurrent-To", main))
    if revisit:
        seen = "" if first is None else str(first)
        own += [("WARC-Refers-To", _urn("main", seen, digest, first_mark or "")), ("X-Refers-To-Page-Id", seen), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record("revisit", main, uri, "application/http;msgtype=response", "HTTP/1.1 200 OK\r\n\r\n", *own)
    else:
        yield _record("response", main, uri, "application/http;msgtype=response", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n{html}", *own)
    yield _record("metadata", _urn("metadata", page, digest, mark), uri, "application/warc-fields", f"payload-bytes: {len(payload)}\r\n", ("WARC-Concurrent-To", main))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the pages' records as gzipped archives into the folder ``path``."""
    columns = {"page_id": F.col(f"`{page_id}`").cast("long"), "url": F.col(f"`{url}`"), "html": F.coalesce(F.col(f"`{html}`"), F.lit(""))}
    rows = located(pages, columns, "warc-pages").withColumn("mark", F.concat_ws("#", "at_file", "at_row")).drop("at_file", "at_row")
    rows = rows.withColumn("key", F.sha2("html", 256))
    least = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "mark"))
    seen = rows.groupBy("key").agg(least.alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.octet_length("html")).alias("bytes"))
    seen = written(seen, "warc-payloads")
    total = seen.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bytes")).alias("bytes"), F.max("bytes").alias("most")).first()
    mean = 1500 + (total["bytes"] or 0) / max(1, total["n"] or 0)
    repeated = seen.where(f"n > 1 AND bytes >= {int(min_revisit_bytes)}").select("key", F.col("least.page_id").alias("first"), F.col("least.mark").alias("first_mark"))
    rows = rows.join(maybe_broadcast(repeated), "key", "left")
    rows = rows.withColumn("revisit", F.col("first_mark").isNotNull() & (F.col("mark") != F.col("first_mark"))).drop("key")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for r in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "mark", "first", "first_mark", "revisit"))):
                for text in records_of(*r):
                    out.append(text)
                    size += len(text)
                if size > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    large = F.octet_length("html") >= LARGE
    for part, most in ((rows.where(~large), min(FILE_BYTES / mean, 1000)), *([(rows.where(large), 1)] if (total["most"] or 0) >= LARGE else [])):
        made = part.mapInArrow(emit, "value string").write.mode("append").option("lineSep", "\r\n\r\n")
        made.option("compression", "gzip").option("maxRecordsPerFile", 3 * max(1, round(most))).text(path)


def inflated(data: bytes) -> bytes:
    """All gzip members of ``data``, or ``data`` itself if it isn't gzipped."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers (names in lower case) and block of each record, found by the lengths in the headers."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        yield at, head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row for each record: headers, payload length and digest of the stored bytes, and a locator."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARSED.split(", ")]
        for b in batches:
            for i in range(b.num_rows):
                file, rows = b.column("path")[i].as_py(), []
                for at, head, block in parsed(inflated(b.column("content")[i].as_py())):
                    stored = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    payload = block.partition(b"\r\n\r\n")[2]
                    whole = head["warc-type"] == "response"
                    digest = base32_sha1(payload) if whole else stored
                    number = lambda k, head=head: int(head[k]) if head.get(k) else None
                    rows.append((file, at, head["warc-record-id"], head["warc-type"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page-id"), len(payload) if whole else None, digest, digest == stored if whole else None, block.decode("utf-8", "replace") if head["warc-type"] == "metadata" else None))
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), _TYPES)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(scan, _PARSED)


_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in _PARSED.split(", ")]


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id and the structs response (or revisit), request, metadata."""
    main = F.col("warc_type").isin("response", "revisit")
    side = records.where(~main & F.col("concurrent_to").isNotNull())
    # a side record may point at another side record: its pointer then counts
    next_hop = side.select(F.col("record_id").alias("concurrent_to"), F.col("concurrent_to").alias("beyond"))
    side = side.join(next_hop, "concurrent_to", "left").withColumn("capture_id", F.coalesce("beyond", "concurrent_to")).drop("beyond")
    rows = records.where(main).withColumn("capture_id", F.col("record_id")).unionByName(side)
    body = [c for c in records.columns]
    one = lambda *kinds: F.min(F.when(F.col("warc_type").isin(*kinds), F.struct(*body)))
    found = rows.groupBy("capture_id").agg(one("response", "revisit").alias("response"), one("request").alias("request"), one("metadata").alias("metadata"))
    return found.where("response IS NOT NULL")


def captures(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives, read them back once and assemble the captures."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(pages, path, min_revisit_bytes)
    return assemble(written(read_warc(spark, path), "warc-records"))


def capture_rows(found: DataFrame) -> DataFrame:
    """Flat columns of assembled captures."""
    told = F.regexp_extract("metadata.fields", r"payload-bytes: (\d+)", 1).try_cast("long")
    return found.select(
        F.col("response.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", told).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        F.col("response.refers_to_page").alias("refers_to"),
        F.coalesce("response.digest_ok", F.lit(True)).alias("digest_ok"),
        (F.col("request").isNotNull() & F.col("metadata").isNotNull()).alias("complete"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS place FROM pages
), b AS (
  SELECT *, list_aggregate(list_transform(string_split(hex, ''), lambda x: lpad(bin(strpos('0123456789abcdef', x) - 1), 4, '0')), 'string_agg', '') AS bits FROM p
)
SELECT page_id, strlen(html)::bigint AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j: substr(bits, (i * 5 + j + 1)::bigint, 1)::bigint * (16 >> j::integer))))::bigint, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place = 1 THEN NULL ELSE first_id END AS refers_to, true AS digest_ok, true AS complete
FROM b
"""
