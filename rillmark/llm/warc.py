"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder: `payloads` keeps the bytes of each distinct payload
once under its SHA-256, `records` keeps the exact header block of each record and the digest that
leads to its payload. `read_records` joins the two, checks the digest of what it read and gives back
the original records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm._base import shared_dir

#: Fixed values of the formats: RFC 4648 alphabet; the profile URI of the WARC 1.1 standard.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1. Five hex digits are four base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _headers(kind: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.coalesce(F.regexp_replace(F.col("_url"), r"[\r\n]+", " "), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.format_string("<urn:rillmark:page:%s>", F.coalesce(F.col("_id").cast("string"), F.lit("")))),
        line("WARC-Date", F.col("_date")),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        F.when(
            kind == "revisit",
            F.concat(line("WARC-Profile", F.lit(SAME_PAYLOAD)), line("WARC-Refers-To", F.format_string("<urn:rillmark:page:%s>", F.col("_first").cast("string")))),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(F.col("_bytes").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2020-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> str:
    """Writes the two tables below `path` and returns it.

    Of records with equal payloads of at least `min_revisit_bytes`, the one with the smallest id is a
    response and the others revisit it; rows that repeat its id, URL and payload are the same record
    and stay responses. Null payloads are empty; a null id sorts last; a null URL is an empty header.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary") if dict(pages.dtypes)[payload_col] != "binary" else F.coalesce(F.col(payload_col), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), body.alias("_payload"))
    keyed = rows.select("*", F.sha2("_payload", 256).alias("_sha256"), F.octet_length("_payload").cast("long").alias("_bytes"), F.xxhash64("_id", "_url").alias("_tie"))
    heads = keyed.select("_id", "_url", "_sha256", "_bytes", "_tie", base32_sha1(F.col("_payload")).alias("_sha1"))
    first = heads.groupBy("_sha256").agg(F.min("_id").alias("_first"), F.min_by("_tie", F.struct(F.col("_id").isNull(), "_id", "_tie")).alias("_first_tie"))
    own = first.withColumnRenamed("_sha256", "_key")
    chosen = keyed.join(own, (F.col("_sha256") == F.col("_key")) & (F.col("_tie") == F.col("_first_tie")))
    # rows that repeat id and URL of the chosen one carry the same bytes: one is kept, by the join's own partitioning
    chosen = chosen.dropDuplicates(["_sha256", "_tie"])
    chosen.select(F.col("_sha256").alias("sha256"), F.col("_bytes").alias("length"), F.col("_payload").alias("payload")).write.mode("overwrite").parquet(f"{path}/payloads")
    kind = F.when((F.col("_bytes") < min_revisit_bytes) | (F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_tie") == F.col("_first_tie"))), "response").otherwise("revisit")
    marked = heads.join(first, "_sha256").withColumn("_date", F.lit(date)).withColumn("_kind", kind)
    marked.select(F.col("_id").alias("record_key"), F.col("_sha256").alias("sha256"), _headers(F.col("_kind")).alias("header")).write.mode("overwrite").parquet(f"{path}/records")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and payload of an archive. A payload whose digest or length is not the stored one raises
    an error."""
    payloads = spark.read.parquet(f"{path}/payloads")
    good = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("length"))
    return payloads.select("sha256", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("stored payload does not match its digest"))).alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: record_key, header (exact text), payload (the full payload, also of
    a revisit), sha256. The join brings a payload's bytes to each of its records."""
    return spark.read.parquet(f"{path}/records").join(read_payloads(spark, path), "sha256", "left")


def record_bytes(records: DataFrame) -> DataFrame:
    """record_key and `record`: the bytes of each WARC record as a file would hold them."""
    body = F.when(header_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("record_key", F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record"))


def header_field(name: str) -> Column:
    """A field of the `header` column, null when the header has none."""
    found = F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("header").rlike(rf"(?m)^{name}: "), found)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", min_revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes an archive of `pages`, reads it back and describes each record from what was read. A
    payload's length and SHA-1 are taken once from its stored bytes, and only these join its records,
    so that a payload of very many records costs no more than its own bytes."""
    spark = pages.sparkSession
    path = write_archive(pages, path or shared_dir(spark), id_col=id_col, min_revisit_bytes=min_revisit_bytes)
    known = read_payloads(spark, path).select("sha256", F.octet_length("payload").cast("long").alias("_read_bytes"), base32_sha1(F.col("payload")).alias("_read_sha1"))
    records = spark.read.parquet(f"{path}/records").join(known, "sha256", "left")
    kind = dict(pages.dtypes)[id_col]
    stored = F.regexp_replace(header_field("WARC-Payload-Digest"), "^sha1:", "")
    read = F.col("_read_sha1")
    return records.select(
        F.col("record_key").alias(id_col),
        F.col("_read_bytes").alias("payload_bytes"),
        F.when(stored == read, read).otherwise(F.raise_error(F.lit("record header and payload disagree"))).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        F.regexp_extract(header_field("WARC-Refers-To"), "page:([^>]*)>", 1).cast(kind).alias("refers_to"),
        header_field("WARC-Target-URI").alias("target_uri"),
    )
