"""A content-addressed WARC archive.

``write_archive`` makes a WARC/1.1 record of each page, but stores a payload's
bytes once: table ``payloads`` has one row a SHA-256 digest, checked for
collisions by length and a second hash; table ``headers`` has every record's
exact header block.  ``read_archive`` joins both into the original records and
verifies each payload against its digest.  ``export_records`` and
``read_records`` are the same as plain .warc files.

Of records with equal payloads of at least ``min_revisit`` bytes that with the
smallest page_id is the response, the others revisit it (identical-payload
revisits: headers only).  Smaller payloads are all responses.

Nulls: null html is an empty payload; a null url is written as an empty target;
null page_ids come last.  Repeated rows get records of their own (the first
alone is the response; rows equal in page_id and payload are told apart by a
row number).  An empty table gives an empty archive.  Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

EPOCH = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _uid(*cols):
    """A UUID-shaped record id made from the page and its digest."""
    h = F.md5(F.concat_ws("|", *cols))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-"))][:-1], F.lit(">"))


def write_archive(pages: DataFrame, folder: str, min_revisit: int = 100) -> None:
    """Writes ``folder``/payloads and ``folder``/headers."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))

    # one payload a digest, combined on the map side
    per = rows.groupBy("digest").agg(F.min("bytes").alias("bytes"), F.max("bytes").alias("_most"), F.min(F.xxhash64("payload")).alias("_lo"), F.max(F.xxhash64("payload")).alias("_hi"), F.min("page_id").alias("first_page"), F.first("payload").alias("payload"))
    same = (F.col("bytes") == F.col("_most")) & (F.col("_lo") == F.col("_hi"))
    per = per.select("digest", F.when(same, F.col("bytes")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("long")).alias("bytes"), "first_page", "payload")
    per.write.parquet(f"{folder}/payloads")
    spark = pages.sparkSession
    firsts = spark.read.schema(per.schema).parquet(f"{folder}/payloads").select("digest", "first_page")

    heads = rows.select("page_id", "url", "digest", "bytes").join(firsts, "digest")
    # repeated rows of the first page: only one of them is the response
    tie = F.col("page_id").eqNullSafe(F.col("first_page"))
    mine = heads.where(tie)
    mine = mine.withColumn("copy", F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")))
    others = heads.where(~tie).withColumn("copy", F.lit(2))
    heads = mine.unionByName(others)
    revisit = (F.col("bytes") >= min_revisit) & (F.col("copy") > 1)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.coalesce(F.col("first_page").cast("string"), F.lit(""))
    block = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _uid(page, F.col("digest"), F.col("url")),
        F.lit(f"{CRLF}WARC-Date: {EPOCH}{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To-Page: "), target)).otherwise(F.lit("")),
        F.lit(f"{CRLF}WARC-Page-ID: "), page,
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string"),
        F.lit(CRLF + CRLF),
    )
    heads.select("page_id", "digest", block.cast("binary").alias("header")).write.parquet(f"{folder}/headers")


def _field(name: str):
    return F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, folder: str, with_record: bool = False) -> DataFrame:
    """Every record from its header and the stored payload; a payload that fails its digest raises.

    page_id, payload_bytes, payload_digest, record_type, refers_to, content_length (and the record's bytes).
    """
    payloads = spark.read.schema("digest string, bytes long, first_page long, payload binary").parquet(f"{folder}/payloads")
    found = F.sha2("payload", 256)
    checked = payloads.select("digest", F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.lit("a payload fails its digest"))).alias("verified"), F.octet_length("payload").cast("long").alias("payload_bytes"), *(["payload"] if with_record else []))
    heads = spark.read.schema("page_id long, digest string, header binary").parquet(f"{folder}/headers")
    rows = heads.join(checked, "digest").withColumn("head", F.col("header").cast("string"))
    out = [
        _field("WARC-Page-ID").cast("long").alias("page_id"),
        "payload_bytes",
        F.col("verified").alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To-Page").cast("long").alias("refers_to"),
        _field("Content-Length").cast("long").alias("content_length"),
    ]
    if with_record:
        body = F.when(F.col("content_length") > 0, F.col("payload")).otherwise(F.lit(b""))
        rows = rows.withColumn("content_length", _field("Content-Length").cast("long"))
        out.append(F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))
    return rows.select(*out)


def export_records(spark: SparkSession, folder: str, out: str, compression: str = "gzip") -> None:
    """Reconstructed records as .warc text files (a record ends in two CRLF, the writer's line separator)."""
    rows = read_archive(spark, folder, with_record=True)
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    rows.select(body.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of each record of .warc or .warc.gz files, cut by Content-Length."""

    def parse(it):
        import gzip
        import re

        for b in it:
            for raw in b.column(0):
                data = raw.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                heads, bodies, at = [], [], 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    n = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", data[at:end])[1])
                    heads.append(data[at:end])
                    bodies.append(data[end : end + n])
                    at = end + n + 4
                yield pa.RecordBatch.from_pydict({"header": pa.array(heads, pa.binary()), "payload": pa.array(bodies, pa.binary())})

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(parse, "header binary, payload binary")


def from_records(rows: DataFrame) -> DataFrame:
    """The columns of read_archive from the bytes of rebuilt records; a payload unlike its header raises.

    A revisit's record has no payload: its digest and length are those of the page it refers to.
    """
    cut = rows.select("record", "payload_bytes", F.substring_index(F.col("record").cast("string"), CRLF + CRLF, 1).alias("h"))
    # lengths in bytes: a URL may have letters beyond ASCII
    cut = cut.select("payload_bytes", F.concat("h", F.lit(CRLF)).alias("head"), F.expr("substring(record, octet_length(h) + 5, octet_length(record) - octet_length(h) - 8)").alias("body"))
    revisit = _field("WARC-Type") == "revisit"
    digest = F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1)
    length = F.octet_length("body").cast("long")
    whole = (length == _field("Content-Length").cast("long")) & F.when(revisit, length == 0).otherwise(F.sha2("body", 256) == digest)
    return cut.select(
        _field("WARC-Page-ID").cast("long").alias("page_id"),
        F.when(revisit, F.col("payload_bytes")).otherwise(length).alias("payload_bytes"),
        F.when(whole, F.when(revisit, digest).otherwise(F.sha2("body", 256))).otherwise(F.raise_error(F.lit("a record is unlike its header"))).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To-Page").cast("long").alias("refers_to"),
        length.alias("content_length"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _shared.new_folder(spark, "warc")
    write_archive(_shared.read(spark, sf_dir, "pages"), folder)
    return from_records(read_archive(spark, folder, with_record=True))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 0 ELSE payload_bytes END::BIGINT AS content_length
FROM f
"""
