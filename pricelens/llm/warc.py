"""WARC: writes captures as archives and assembles them again from what is read.

A capture is three records - request, response (or revisit) and metadata - of
which the first and last name the response in WARC-Concurrent-To. Reading gives
one row per record; assembly joins the records of a transaction on that name
and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, shared_dir, table

CRLF = "\r\n"
BREAK = CRLF * 2
#: Pages in an archive at most; an archive is read by one task, as a stream.
PAGES_A_FILE = 2000
#: Bytes of payload and records in a batch that a reading task hands on.
BATCH_BYTES, BATCH_RECORDS = 8_000_000, 2000
#: The type of what is no record.
DAMAGED = "damaged"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, block_bytes long, "
    "payload_bytes long, payload_digest string, fields array<struct<name:string,value:string>>, payload binary"
)


def base32_sha1(c: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits at a time, as four digits of base 32, then the other alphabet."""
    hexed = F.sha1(c)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def header(*fields: tuple[str, Column | str]) -> Column:
    """A record's head; null fields are left out, as concat_ws leaves out nulls."""
    return F.concat_ws(CRLF, F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v) for k, v in fields))


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", id_col="page_id", url_col="url", html_col="html") -> None:
    """Archives of a capture for each row of pages, gzipped, below path.

    Of pages with equal payloads of at least least bytes the one with the
    largest id is the response that the others revisit; of several with that
    id, the one that is read first. Null payloads are empty; null ids are
    smaller than all others; line ends in a url are percent signs in the
    archive and a null url is left out; rows alike in all are captures of
    their own. pages is read twice and must give its rows in one order, as a
    table does: a row's number tells it from its like. A page is shuffled once;
    of the others of its payload only ids and numbers are.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    df = df.withColumn("digest", base32_sha1(F.col("html"))).withColumn("n", F.monotonically_increasing_id())
    own = F.struct("page_id", (-F.col("n")).alias("n"))
    groups = df.select("page_id", "n", "digest", F.octet_length("html").alias("size")).filter(F.col("size") >= least).groupBy("digest").agg(F.max(own).alias("top"), F.count("*").alias("pages")).filter("pages > 1")
    # rows of a hot payload stand alone in this join but for one small row of the other side, so skewed partitions can be split
    df = df.join(groups.select("digest", "top"), "digest", "left")
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x["page_id"].cast("string"), F.lit("null")), F.lit(":"), x["n"].cast("string"), F.lit(":"))
    df = df.withColumn("own", own).withColumn("revisit", F.coalesce(F.col("top") != F.col("own"), F.lit(False)) & (F.octet_length("html") >= least))
    me, uri = F.concat(urn(F.col("own")), F.lit("response>")), F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(BREAK))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{BREAK}"))
    told = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-bytes: "), size, F.lit(CRLF))
    length = lambda b: F.octet_length(b).cast("string")
    request = F.concat_ws(BREAK, header(("WARC-Type", "request"), ("WARC-Record-ID", F.concat(urn(F.col("own")), F.lit("request>"))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", me), ("Content-Type", "application/http; msgtype=request"), ("Content-Length", length(ask))), ask)
    response = F.concat_ws(BREAK, header(
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", me), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Profile", F.when(F.col("revisit"), PROFILE)), ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(urn(F.col("top")), F.lit("response>")))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", length(block)),
    ), block)
    metadata = F.concat_ws(BREAK, header(("WARC-Type", "metadata"), ("WARC-Record-ID", F.concat(urn(F.col("own")), F.lit("metadata>"))), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", me), ("Content-Type", "application/warc-fields"), ("Content-Length", length(told))), told)
    lines = df.select(F.concat_ws(BREAK, request, response, metadata).alias("value"))
    # a record ends with two line ends, which the writer puts after each row
    lines.write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", PAGES_A_FILE).text(path)


def records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an archive, one after another.

    Bytes that belong to none - after a wrong length, say - are told as a
    record of type DAMAGED with their number; reading goes on at the next line
    that begins a record. A record without a length, or cut short by the end of
    the archive, is told as DAMAGED too.
    """
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        lost = 0
        while line and not line.startswith(b"WARC/"):
            lost += len(line)
            line = stream.readline(1 << 20)
        if lost:
            yield record({"warc-type": DAMAGED}, b"") | {"block_bytes": lost}
        if not line:
            return
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = head.get("content-length", "")
        block = stream.read(int(size)) if size.isdigit() else b""
        if not size.isdigit() or len(block) < int(size):
            yield record({"warc-type": DAMAGED}, b"") | {"block_bytes": len(block)}
        else:
            yield record(head, block)


def whole(stream: io.BufferedIOBase) -> Iterator[dict]:
    try:
        yield from records(stream)
    except (OSError, EOFError, zlib.error):
        yield record({"warc-type": DAMAGED}, b"")


def record(head: dict[str, str], block: bytes) -> dict:
    kind, media = head.get("warc-type", ""), head.get("content-type", "")
    row = {"record_id": head.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "digest": head.get("warc-payload-digest"), "block_bytes": len(block), "payload_bytes": None, "payload_digest": None, "fields": None, "payload": None}
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2] if media.startswith("application/http") else block
        row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
    elif media == "application/warc-fields":
        pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines())
        row["fields"] = [{"name": n.strip().lower(), "value": v.strip()} for n, c, v in pairs if c]
    return row


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of all archives below path, plain or gzipped (one member or many); a gzip member that is broken ends its archive with a DAMAGED row.

    A task reads the archives of its partition, which Spark fills up to
    spark.sql.files.maxPartitionBytes (an archive larger than that is read by
    itself), and unpacks them as a stream.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "refers_to", "uri", "date", "digest")] + [("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                stream = io.BytesIO(raw)
                if raw[:2] == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
                rows, size = [], 0
                for row in whole(stream):
                    rows.append(row)
                    size += row["block_bytes"]
                    if size >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD)


def assemble(found: DataFrame, payload: bool = True) -> DataFrame:
    """transaction, response, request, metadata: one row per capture, its parts nested.

    A record belongs to the transaction it names in WARC-Concurrent-To, or else
    to its own. Of several records of one kind in a transaction the one with
    the least id is taken; a part that is missing is null, and so is the
    response of records that name none in the archives. Records that have
    neither name, the DAMAGED among them, make no capture. Without payload the
    payloads are not shuffled.
    """
    cols = [c for c in found.columns if payload or c != "payload"]
    df = found.select(F.coalesce("concurrent_to", "record_id").alias("transaction"), F.struct(*cols).alias("r")).filter("transaction IS NOT NULL")
    part = lambda *kinds: F.min(F.when(F.col("r.type").isin(*kinds), F.col("r")))
    return df.groupBy("transaction").agg(part("response", "revisit").alias("response"), part("request").alias("request"), part("metadata").alias("metadata"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    df = assemble(read_warc(spark, path), payload=False)
    field = lambda name: F.filter("metadata.fields", lambda f: f["name"] == name)[0]["value"]
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1).try_cast("long")
    return df.select(
        field("page-id").try_cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", field("payload-bytes").cast("long")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", F.replace(F.col("response.digest"), F.lit("sha1:"), F.lit(""))).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page(F.col("response.refers_to")).alias("refers_to"),
    )


#: Base32 of 160 bits: eight groups of 20 bits, each four letters.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, html, h, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 1 + 5 * CAST(floor(i / 4) AS INTEGER), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1), '' ORDER BY i) FROM range(32) t(i)) AS digest
  FROM p
), t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS n FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN top END AS refers_to
FROM t
"""
