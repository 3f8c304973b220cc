"""Content-addressed web archive.

A record has an exact header block and a payload. Payload bytes are stored once per SHA-256
digest, header blocks are stored apart, and records are put together again by a join on the
digest. Both tables are Parquet below a folder that all executors share.

Defined results: a null html is an empty payload; a null url leaves its header line out; line
ends in a url are percent-encoded; a null page_id is kept, never named by a revisit, and is a
response. Rows that repeat the smallest page_id of a payload are all responses. Columns other
than page_id, url and html are ignored, whatever their names. An empty table gives an empty archive.
Very long pages are one payload row each, written whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuesheet.plans.session import stage

#: Shorter payloads are never replaced by a reference.
MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"


def _captures(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"),
    )


def payload_store(pages: DataFrame) -> DataFrame:
    """One row per digest. Copies are merged before the shuffle, so a page that is copied a million
    times sends one row per map task. A second hash and the length prove that equal digests had equal bytes."""
    check = F.xxhash64("payload", F.octet_length("payload"))
    return (
        _captures(pages).groupBy("payload_digest")
        .agg(F.first("payload").alias("payload"), F.min(check).alias("low"), F.max(check).alias("high"))
        .select(
            "payload_digest",
            F.when(F.col("low") == F.col("high"), F.col("payload"))
            .otherwise(F.raise_error(F.lit("two payloads share one SHA-256 digest")).cast("binary")).alias("payload"),
        )
    )


def record_index(pages: DataFrame) -> DataFrame:
    """Identity of each capture, without its payload."""
    return _captures(pages).select(
        "page_id", "url", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")
    )


def record_headers(index: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The header block of each record as the bytes that an archive file would hold."""
    # stored, so that the join can split a digest that very many pages share
    first = stage(index.groupBy("payload_digest").agg(F.min("page_id").alias("first_id")), "first")
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & (F.col("page_id") != F.col("first_id"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = F.concat_ws(
        BREAK,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(BREAK),
    )
    return index.join(first, "payload_digest").select(lines.cast("binary").alias("header"))


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``payloads``, ``index`` and ``headers`` below ``folder``."""
    spark = pages.sparkSession
    payload_store(pages).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    record_index(pages).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    record_headers(index, min_revisit_bytes).write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, header, payload, record).

    Everything comes from the stored bytes: the fields from the header blocks, digest and length
    from the payloads as read. ``record`` is the original record: header block and, for a response,
    the payload. Columns that are not used are pruned before the join, payloads included."""
    text = F.col("header").cast("string")

    def field(pattern: str):
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", found)

    headers = spark.read.parquet(f"{folder}/headers").select(
        "header",
        field(r"(?dm)^WARC-Record-ID: <urn:page:(-?\d+)>\r$").cast("long").alias("page_id"),
        field(r"(?dm)^WARC-Target-URI: (.*?)\r$").alias("url"),
        field(r"(?dm)^WARC-Type: (\w+)\r$").alias("record_type"),
        field(r"(?dm)^WARC-Refers-To: <urn:page:(-?\d+)>\r$").cast("long").alias("refers_to"),
        field(r"(?dm)^WARC-Payload-Digest: sha256:([0-9a-f]{64})\r$").alias("named_digest"),
    )
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        F.col("payload_digest").alias("named_digest"), "payload",
        F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    payloads = payloads.withColumn(
        "payload_digest",
        F.when(F.col("payload_digest") == F.col("named_digest"), F.col("payload_digest"))
        .otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))),
    )
    record = F.when(F.col("record_type") == "response", F.concat("header", "payload")).otherwise(F.col("header"))
    return headers.join(payloads, "named_digest", "left").select(
        "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "header", "payload",
        record.alias("record"),
    )
