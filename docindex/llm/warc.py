"""WARC archives with revisit records.

Only headers (id, digest, length, address) are shuffled by payload digest to
find each payload's original; payloads move once, to the archive they go to.
Archives are written by Spark's text writer, whose line separator is what ends
a WARC record, and read back through ``binaryFile``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, join_by_key, load, new_path

#: The alphabet of Spark's conv() in base 32, and that of base32.
_CONV, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EOL = "\r\n"
#: Bytes of payload that an archive gets on average.
ARCHIVE_BYTES = 8_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """Bare base32 of the SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.translate(F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0"), _CONV, _BASE32) for k in range(8)]
    return F.concat(*parts)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to`` and ``refers_url`` to headers (page_id, url, payload_digest,
    payload_bytes): the smallest page_id with that payload, null for that one
    itself and for payloads under ``min_bytes``. Repeats of the row with the smallest
    page_id are responses all; a null page_id is never what others refer to."""
    able = headers.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    first = able.groupBy("payload_digest").agg(F.count("*").alias("_n"), F.min_by(F.struct("page_id", "url"), F.struct("page_id", "url")).alias("_first")).where("_n > 1")
    joined = join_by_key(headers, first, "payload_digest", "_n", "left")
    later = (F.col("payload_bytes") >= min_bytes) & ~F.col("_first.page_id").eqNullSafe(F.col("page_id"))
    return joined.select(*headers.columns, F.when(later, F.col("_first.page_id")).alias("refers_to"), F.when(later, F.col("_first.url")).alias("refers_url"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))


def record(date: str) -> Column:
    """The record of a row: WARC header, HTTP header, payload unless it is a revisit.
    Fresh headers: lengths and digests are those of what is written."""
    one_line = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK" + _EOL), _field("Content-Type", F.lit("text/html; charset=utf-8")), _field("Content-Length", F.col("payload_bytes").cast("string")), F.lit(_EOL))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))

    def urn(page_id: str) -> Column:
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", F.coalesce(F.col(page_id).cast("string"), F.lit("")), "payload_digest")), r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))

    return F.concat(
        F.lit("WARC/1.1" + _EOL),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", urn("page_id")),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", one_line(F.col("url"))),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(_field("X-Page-Id", F.col("page_id").cast("string"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", urn("refers_to")), _field("WARC-Refers-To-Target-URI", one_line(F.col("refers_url"))), _field("X-Refers-To-Page-Id", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_EOL),
        block,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; null html is an
    empty payload) into gzipped archives under ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", payload_digest(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("_id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    total = rows.agg(F.sum("payload_bytes")).first()[0]
    parts = max(1, -(-(total or 0) // ARCHIVE_BYTES))
    heads = resolve_revisits(rows.drop("payload"), min_bytes).where("refers_to is not null").select("_id", "payload_digest", "refers_to", "refers_url").distinct()
    # Payloads move once: the partitions that they are joined in are the archives.
    found = rows.repartition(parts, "_id", "payload_digest").join(heads, ["_id", "payload_digest"], "left")
    out = found.select(record(date).alias("value"))
    out.write.option("lineSep", _EOL * 2).option("compression", "gzip").text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (lower-cased header fields, block) of an archive without compression."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(_EOL)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield head, block
        at = end + 8 + n


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, html string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``. Digests and lengths of responses
    are those of the payload as read, of revisits those that their headers state."""
    attach(spark)
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in parse_archive(gzip.decompress(content.as_py())):
                    number = lambda x: int(x) if x else None
                    fields, _, payload = block.partition(b"\r\n\r\n")
                    http = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in fields.decode().split(_EOL)[1:])}
                    said, size = head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    if head["warc-type"] == "response":
                        digest, size_read = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    else:
                        digest, size_read = said, size
                    rows.append((number(head.get("x-page-id")), head.get("warc-target-uri"), size_read, digest, head["warc-type"], number(head.get("x-refers-to-page-id")), digest == said and size_read == size, payload.decode() if head["warc-type"] == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(load(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> CAST(5 * (3 - k % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS digest,
  min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, TRUE AS digest_ok FROM d
"""
