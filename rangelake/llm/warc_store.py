"""Content-addressed WARC archive: payload bytes once by verified digest, exact record headers apart, joined on reading.

An archive is a folder with two Parquet tables: ``payloads`` (address, payload), one row for each distinct payload, and
``records`` (the header bytes of each record and the address of its payload). The address is the SHA-256; it is computed
again from the stored bytes on reading, and a difference ends the job. Only functions of the JVM are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.llm.packs import work_folder

#: Smaller payloads are never replaced by a revisit.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, its size, address (SHA-256) and SHA-1; a null html is an empty payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"),
    )


def headers(digests: DataFrame, date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One record header per page. Of equal payloads of ``revisit_bytes`` or more the largest page_id is the response."""
    light = digests.select("page_id", "url", "size", "address", "sha1")
    # sums on the reading side first: a payload that a third of all pages share is one row per task
    first = light.where(F.col("size") >= revisit_bytes).groupBy("address").agg(F.max("page_id").alias("response_id"))
    joined = light.join(first, "address", "left")
    revisit = (F.col("size") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    url = F.translate(F.coalesce("url", F.lit("urn:none")), "\r\n", "")
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _page_urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _page_urn(F.col("response_id"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, 0).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.encode(text, "UTF-8").alias("header"), "address")


def write_archive(pages: DataFrame, folder: str | None = None) -> str:
    """Write the archive of pages (page_id, url, html) and return its folder.

    Null urls are written as ``urn:none``, null ids as ``none``; repeated rows get a record each; an empty table
    makes an empty archive. Further columns are left out.
    """
    folder = folder or work_folder(pages.sparkSession)
    digests = with_digests(pages)
    digests.groupBy("address").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    headers(digests).write.option("compression", "zstd").parquet(f"{folder}/records")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """header, payload of every record, payloads restored by a join on the address and checked against it."""
    records = spark.read.schema("header binary, address string").parquet(f"{folder}/records")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{folder}/payloads")
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), "address")).cast("binary")))
    return records.join(checked, "address").select("header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """Each record as it stands in a WARC file: header, block (revisits have none) and two line ends."""
    text = F.decode("header", "UTF-8")
    revisit = F.contains(text, F.lit("\r\nWARC-Type: revisit\r\n")) | F.startswith(text, F.lit("WARC/1.1\r\nWARC-Type: revisit\r\n"))
    return records.select(F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")).alias("record"))


def parse_headers(records: DataFrame) -> DataFrame:
    """The fields of the header of each record, beside its payload."""
    text = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {pattern}\r\n", 1), F.lit(""))
    page = lambda name: F.when(field(name, "<urn:page:(-?[0-9]+)>").isNotNull(), field(name, "<urn:page:(-?[0-9]+)>").cast("long"))
    return records.select(
        page("WARC-Record-ID").alias("page_id"), field("WARC-Type", r"(\w+)").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})").alias("payload_digest"), field("WARC-Target-URI", r"([^\r]*)").alias("url"),
        field("Content-Length", "([0-9]+)").cast("long").alias("content_length"), "payload",
    )
