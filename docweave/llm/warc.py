"""Web archives with revisit resolution.

``resolve_revisits`` works on headers only (id, payload digest, length): one
grouped aggregation by payload finds the original of each payload, and one join
gives every other record its original (``join_unique`` keeps hot payloads from
meeting in one task). ``write_archive`` builds WARC/1.1 records with fresh
headers as column expressions and writes them through Spark's text sink, whose
separator is exactly the blank line pair that ends a record, so each file is a
valid gzip-compressed archive in any store that Spark can write.
``read_archive`` reads the files back through Spark, parses records by their
Content-Length and joins each revisit with its original response.

Defined cases: null payload is empty; a row without id is a record without
row id and is never an original while another row has one; rows that share the
smallest id of a payload are all responses; rows below ``min_bytes`` are
responses.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import col, join_unique

# fixed values: base-32 digits of conv() and of RFC 4648
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FILE_BYTES = 16 << 20


def payload_digest(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of the bytes: each 10 hex digits are 8 base-32
    digits."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _CONV32, _RFC32)


def with_payload(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None = None) -> DataFrame:
    """``id, url, payload, digest, bytes, payload_key`` of each row."""
    payload = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    url = col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    base = pages.select(col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    return (base.withColumn("digest", payload_digest(F.col("payload")))
            .withColumn("bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_key", F.concat_ws(":", "digest", "bytes", F.xxhash64("payload"))))


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: null for a response, else the smallest id among the
    records of the same payload. Needs ``id, digest, bytes, payload_key``."""
    headers = records.select("id", "bytes", "payload_key")
    originals = (headers.filter(F.col("bytes") >= min_bytes).groupBy("payload_key")
                 .agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    found = join_unique(records, originals, "payload_key", "n")
    other = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("id"))
    return found.withColumn("refers_to", F.when(other & (F.col("bytes") >= min_bytes), F.col("original"))).select(
        *records.columns, "refers_to")


def _urn(row_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", row_id.cast("string"), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def archive_records(resolved: DataFrame, date: str) -> DataFrame:
    """One text column ``value``: a whole record without its final blank lines."""
    revisit = F.col("refers_to").isNotNull()

    def line(name: str, value: Column) -> Column:  # a null value gives no line
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))

    url = F.regexp_replace("url", r"[\r\n]+", " ")
    block_bytes = F.lit(len(_HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("id"), F.col("digest"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to"), F.col("digest")))),
        line("X-Row-Id", F.col("id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit("\r\n" + _HTTP))
    return resolved.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archive(resolved: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes the records of ``resolved`` (payload columns and ``refers_to``)
    as ``path/*.gz``; the number of records in a file is set so that an average
    file holds ``FILE_BYTES``."""
    size = resolved.agg(F.avg(F.coalesce("bytes", F.lit(0)))).first()[0] or 0
    (archive_records(resolved, date).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, int(FILE_BYTES / (size + 500)))).text(path))


def parse_records(data: bytes):
    """``(headers, block)`` of each record; names are lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(headers["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, data[end + 4:stop]
        at = stop + 4


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``id, url, type, digest, bytes, refers_to`` with
    digest and length of the full payload. Payloads are hashed again and must
    match the digest in the header; a damaged record raises an error."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string()),
                        ("own_bytes", pa.int64()), ("record", pa.string()), ("refers", pa.string())])

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse_records(zlib.decompress(content.as_py(), 31)):
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = h["warc-payload-digest"].partition(":")[2]
                    if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
                    row_id = h.get("x-row-id")
                    rows.append((None if row_id is None else int(row_id), h.get("warc-target-uri"), h["warc-type"], digest,
                                 len(payload), h["warc-record-id"], h.get("warc-refers-to")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    records = files.mapInArrow(parse, "id long, url string, type string, digest string, own_bytes long, record string, refers string")
    uses = records.filter("refers is not null").groupBy("refers").agg(F.count(F.lit(1)).alias("n"))
    responses = (records.filter("type = 'response'").groupBy("record")
                 .agg(F.min("id").alias("original"), F.max("own_bytes").alias("original_bytes")))
    originals = responses.join(uses, responses["record"] == uses["refers"]).select("refers", "original", "original_bytes", "n")
    joined = join_unique(records.withColumn("refers", F.coalesce("refers", F.concat(F.lit("\u0002"), "record"))),
                         originals, "refers", "n")
    return joined.select("id", "url", "type", "digest",
                         F.when(F.col("type") == "revisit", F.col("original_bytes")).otherwise(F.col("own_bytes")).alias("bytes"),
                         F.col("original").alias("refers_to"))
