"""WARC: a content-addressed archive of page records.

Two tables make an archive. ``payloads`` has every distinct payload once, by its SHA-256. ``headers`` has for every
record the exact bytes that stand before the payload (WARC fields and HTTP header) and the payload's SHA-256. A join of
both gives back the records byte for byte. Digests are verified when payloads are stored (two payloads of one SHA-256
must also share SHA-1 and length) and again, over the stored bytes, when records are read; a difference stops the job.

Defined results: a null payload is empty; of rows that repeat both page and payload each is written as the first; a
null page id comes after all others; fields with line breaks get spaces instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.tables import written

#: The tables carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Base32 of 20 bytes given as 40 hexadecimal digits: five digits are four letters."""
    letters = []
    for k in range(8):
        part = F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(ALPHABET), F.shiftright(part, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def payload_digest(payload: Column) -> Column:
    return base32(F.sha1(payload))


def _field(name: str, value: Column) -> Column:
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write an archive of ``pages`` to ``path``. Equal payloads of at least ``min_bytes`` after the first become revisits.

    Payloads are reduced within each task before the shuffle, and only digests and ids are joined.
    """
    spark = pages.sparkSession
    given = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(html).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("sha256", F.sha2("payload", 256))
    sha1, size = F.sha1("payload"), F.length("payload")
    given.groupBy("sha256").agg(
        F.min("page_id").alias("first_id"), F.first("payload").alias("payload"),
        F.min(sha1).alias("sha1"), F.max(sha1).alias("other_sha1"),
        F.min(size).alias("n_bytes"), F.max(size).alias("other_n_bytes"),
    ).select(
        F.when((F.col("sha1") == F.col("other_sha1")) & (F.col("n_bytes") == F.col("other_n_bytes")), F.col("sha256"))
        .otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("sha256"),
        "first_id", "payload", base32(F.col("sha1")).alias("digest"), F.col("n_bytes").cast("long").alias("n_bytes"),
    ).write.option("compression", "zstd").parquet(f"{path}/payloads")

    stored = spark.read.parquet(f"{path}/payloads").select("sha256", "first_id", "digest", "n_bytes")
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes"), F.lit("\r\n\r\n")
    )
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))),
        _field("WARC-Target-URI", F.col("url")),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            _field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id"), F.lit(">"))), _field("WARC-Profile", F.lit(PROFILE))
        )).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")),
        F.lit("\r\n\r\n"), http,
    )
    given.drop("payload").join(stored, "sha256").select(
        "page_id", "sha256", F.encode(header, "UTF-8").alias("header"), (~revisit).alias("with_payload")
    ).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``sha256``, ``payload`` and ``digest`` and ``n_bytes`` measured from the stored bytes, which must fit their key."""
    stored = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))
    )
    return stored.select(
        checked.alias("sha256"), "payload", payload_digest(F.col("payload")).alias("digest"),
        F.length("payload").cast("long").alias("n_bytes"),
    )


def header_field(header: Column, name: str) -> Column:
    """A field of the WARC header, null where it is missing."""
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id`` and ``record``: the bytes of every record as a WARC file has them."""
    payloads = read_payloads(spark, path).select("sha256", "payload")
    headers = spark.read.parquet(f"{path}/headers")
    full = headers.filter("with_payload").join(payloads, "sha256").select("page_id", F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))
    return full.unionByName(headers.filter("NOT with_payload").select("page_id", F.concat("header", F.lit(b"\r\n\r\n")).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """What each of ``records(record)`` says and holds.

    ``page_id``, ``record_type``, ``refers_to``, ``said_digest``, ``said_bytes``, and of the bytes after both headers their
    ``digest`` and ``n_bytes``. Of a record whose block length is not the one stated, all of these stop the job.
    """
    text = F.col("record").cast("string")
    warc, both = F.substring_index(text, "\r\n\r\n", 1), F.substring_index(text, "\r\n\r\n", 2)
    split = records.select("record", warc.alias("warc"), F.octet_length(warc).alias("n_warc"), F.octet_length(both).alias("n_both"), both.alias("both"))
    # Two line ends stand after each header and after the block.
    stated = header_field(F.col("warc"), "Content-Length").cast("int")
    whole = F.length("record") == F.col("n_warc") + 8 + stated
    payload = F.substring("record", F.col("n_both") + 5, F.length("record") - F.col("n_both") - 8)
    page = lambda name: F.nullif(F.regexp_extract("warc", rf"(?m)^{name}: <urn:page:(-?\d+)>", 1), F.lit("")).cast("long")
    return split.select(
        page("WARC-Record-ID").alias("page_id"), header_field(F.col("warc"), "WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"), F.substring(header_field(F.col("warc"), "WARC-Payload-Digest"), 6, 32).alias("said_digest"),
        F.regexp_extract("both", r"\r\nContent-Length: (\d+)$", 1).cast("long").alias("said_bytes"),
        F.when(whole, payload).otherwise(F.raise_error(F.lit("a record is not as long as it says"))).alias("payload"),
    ).select(
        "page_id", "record_type", "refers_to", "said_digest", "said_bytes",
        payload_digest(F.col("payload")).alias("digest"), F.length("payload").cast("long").alias("n_bytes"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, rebuilt and parsed: every response is measured, every revisit has to fit its response.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``; a null id stays null.
    """
    parsed = written(parse_records(read_records(spark, path)), "parsed")
    responses = parsed.filter("record_type = 'response'")
    measured = responses.select("digest", "n_bytes", F.col("page_id").alias("held_by")).distinct()
    revisits = parsed.filter("record_type = 'revisit'").drop("digest", "n_bytes").join(
        measured, (F.col("refers_to") == F.col("held_by")) & (F.col("said_digest") == F.col("digest")), "left"
    ).drop("held_by")
    fits = (F.col("said_digest") == F.col("digest")) & (F.col("said_bytes") == F.col("n_bytes"))
    wrong = F.raise_error(F.lit("a record's digest does not fit its payload"))
    return responses.unionByName(revisits).select(
        "page_id", F.col("said_bytes").alias("payload_bytes"),
        F.when(F.coalesce(fits, F.lit(False)), F.col("said_digest")).otherwise(wrong).alias("payload_digest"),
        "record_type", "refers_to",
    )
