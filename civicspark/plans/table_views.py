"""The given star-schema tables seen as the shapes the operators work on.

Each view is a plain projection (two are small joins), so columns are pruned at the Parquet scan. Filters on columns
taken over unchanged (``event_type`` as the city) reach it too; those on derived ones (``dt_iso``) only as a test for null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.functions.dates import iso_text
from civicspark.functions.urls import netloc_of, url_hash
from civicspark.operators import links as L
from civicspark.sources.workbooks import NOT_AVAILABLE, PROPERTIES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as observations; the event type is the city."""
    k, number = _k(), F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("event_type").alias("city"),
        "event_id",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        iso_text(F.col("ts")).alias("dt_iso"),
        F.lit(0).alias("timezone"),
        F.struct(
            F.col("value").alias("temp"),
            F.when(number % 11 != 0, F.col("value") - 1).alias("temp_min"),
            (F.col("value") + 1).alias("temp_max"),
            k.cast("double").alias("feels_like"),
            (k + 1000).alias("pressure"),
            k.alias("humidity"),
            F.when(k % 13 != 0, k / 2).alias("dew_point"),
        ).alias("main"),
        F.when(number % 19 != 0, F.struct(k.alias("all"))).alias("clouds"),
        F.array(F.struct(
            k.alias("id"),
            F.col("event_type").alias("main"),
            F.col("props").alias("description"),
            F.when(number % 17 != 0, F.lit("01d")).alias("icon"),
        )).alias("weather"),
        F.when(number % 3 != 0, F.struct((k / 10.0).alias("1h"))).alias("rain"),
        F.struct((k / 4).alias("speed"), (k * 3).alias("deg")).alias("wind"),
        (F.col("user_id") / 2).alias("lat"),
        F.when(number % 23 != 0, F.col("user_id") / 4).alias("lon"),
        F.col("event_type").alias("city_name"),
    )


def key_values(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as key/value rows: a region is a file, a nation a sheet. Every fourth sheet is sparse."""
    number = F.col("c_custkey")
    sparse = F.col("n_nationkey") % 4 == 0
    return (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("file"),
            F.col("n_nationkey").alias("sheet_index"),
            F.col("n_name").alias("sheet"),
            number.alias("row"),
            F.when(F.when(sparse, number % 11 == 0).otherwise(number % 7 != 0), F.col("c_name")).alias("key"),
            F.when(F.when(sparse, number % 16 == 0).otherwise(number % 5 != 0), F.col("c_mktsegment")).alias("value"),
        )
    )


def sheet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sheets, three to a file: a line is a row, a sentence a cell."""
    number = F.col("doc_id")
    return (
        table(spark, folder, "documents")
        .select(
            F.concat(F.lit("f"), F.floor(number / 3)).alias("file_path"),
            (number % 3).cast("int").alias("sheet_index"),
            F.when(F.col("source") == "src7", "Contents").otherwise(F.col("source")).alias("sheet_name"),
            F.posexplode(F.split("text", "\n")).alias("row", "line"),
        )
        .select(
            "file_path", "sheet_index", "sheet_name", "row",
            F.transform(F.split("line", r"\. "), lambda s: F.nullif(s, F.lit(""))).alias("values"),
        )
    )


def typed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as rows of two typed cells."""
    number = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("c"), F.col("c_nationkey")).alias("file_path"),
        number.alias("row"),
        F.array(number.cast("string"), F.when(number % 7 != 0, F.col("c_mktsegment"))).alias("values"),
        F.array(F.when(number % 4 != 0, "int").otherwise("str"), F.lit("str")).alias("dtypes"),
    )


def header_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document as a header row, one name per word."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return lines.select("doc_id", "row", F.split("line", " ").alias("names"))


def properties(spark: SparkSession, folder: str) -> DataFrame:
    """Eleven properties per document, a quarter of them not available."""
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("property"),
            F.when((F.col("doc_id") + i) % 4 == 0, NOT_AVAILABLE).otherwise(F.col("lang")).alias("value"),
        )
        for i, (name, _) in enumerate(PROPERTIES)
    ])
    return table(spark, folder, "documents").select(F.col("doc_id").alias("file_path"), F.inline(entries))


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as revisions of sheets in ingest order ``(o_orderdate, o_orderkey)``."""
    return table(spark, folder, "orders").select(
        F.concat("o_orderpriority", F.lit("-"), F.col("o_custkey") % 50).alias("sheet_name"),
        "o_orderdate", "o_orderkey", "o_totalprice",
    )


def growing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as rows that are added to files; the time of the last row is that of the file."""
    moment = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86_400)
    return table(spark, folder, "orders").select(
        F.concat("o_orderpriority", F.lit("-"), "o_custkey", F.lit(".xlsx")).alias("path"), moment.alias("modificationTime"),
        "o_orderkey", "o_orderdate", "o_totalprice",
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as looks at files: a user is a path, the event type its content."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("path"), "ts", F.sha2("event_type", 256).alias("sha256"), "event_id"
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def crawled_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a status and a content type: every seventh is missing, some are no HTML."""
    number = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, ["text/html; charset=utf-8", "application/xhtml+xml", "text/plain", "image/png", "TEXT/HTML"])), (number % 5 + 1).cast("int"))
    return pages(spark, folder).withColumns({"status": F.when(number % 7 == 0, 404).otherwise(200), "content_type": kind})


def urls(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses with endings that bring in escapes, dots, extensions and query parts."""
    ending = (
        F.when(F.col("page_id") % 6 == 0, "")
        .when(F.col("page_id") % 6 == 1, "%3Fz=1&a=%C3%A9")
        .when(F.col("page_id") % 6 == 2, "/x%20y/")
        .when(F.col("page_id") % 6 == 3, "/Census.pdf")
        .when(F.col("page_id") % 6 == 4, "/Statistics/Score.XLSX/a.xlsx")
        .otherwise("?utm=b&a=+%zz&")
    )
    return pages(spark, folder).select("page_id", F.concat("url", ending).alias("url"))


def links(spark: SparkSession, folder: str) -> DataFrame:
    return L.with_hash(L.extract_links(pages(spark, folder)))


def table_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations, customers and orders as a site: each row is a page that links to the row below it, in every form of reference.

    A page with many links is stored as many rows of one address.
    """
    site = "http://city.example/statistics"

    def page(rows: DataFrame, url: Column, *hrefs: Column) -> DataFrame:
        links = F.concat(*[F.concat(F.lit('<p><a class="x" href="'), h, F.lit('">next</a>')) for h in hrefs])
        return rows.select(url.alias("url"), links.alias("html"))

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    r, n, c, o = (F.col(k) for k in ("n_regionkey", "n_nationkey", "c_custkey", "o_orderkey"))
    customer = text(f"{site}/customer/", c, "?a=1&b=2")
    return (
        page(table(spark, folder, "nation"), text(f"{site}/region/", r), text("../nation/", n, "/"))
        .unionByName(page(table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), text(f"{site}/nation/", n),
                          text("/x/../statistics/./customer/", c, "?b=2&amp;a=1#top")))
        .unionByName(page(table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey"), customer,
                          text("./../order/", o), text("//city.example/statistics/order/", o), text("?b=2&a=1"), F.lit("#top"), text("//other.example/statistics/", o)))
        .unionByName(page(table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey"), text(f"{site}/order/", o),
                          text("/statistics/customer/", c, "?a=1&b=2"), text("../../news/", F.col("o_orderstatus"))))
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as remote files; every fifth has no date."""
    day = F.date_add(F.lit("2022-01-01").cast("date"), (F.col("page_id") % 400).cast("int"))
    text = F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 06:00:00 GMT"))
    return pages(spark, folder).select("url", F.when(F.col("page_id") % 5 != 0, text).alias("last_modified"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Local copies of every second page."""
    number = F.col("page_id")
    sha = F.sha2("html", 256)
    day = F.date_add(F.lit("2022-01-01").cast("date"), ((number * 7) % 400).cast("int"))
    return pages(spark, folder).filter(number % 2 == 0).select(
        "url",
        sha.alias("sha256"),
        F.when(number % 3 == 0, sha).when(number % 3 == 1, url_hash(F.col("url"))).alias("stored_sha256"),
        day.cast("timestamp").alias("mtime"),
    )


def robots_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A few rules for the hosts of three quarters of the pages."""
    hosts = pages(spark, folder).filter(F.col("page_id") % 4 != 0).select(netloc_of(F.col("url")).alias("host"))
    rule = "array<struct<agent: string, prefix: string, allow: boolean>>"
    rules = F.from_json(
        F.lit(
            '[{"agent": "*", "prefix": "/fr", "allow": false}, {"agent": "*", "prefix": "/fr/5", "allow": true},'
            ' {"agent": "*", "prefix": "/en/4", "allow": false}, {"agent": "otherbot", "prefix": "/", "allow": false}]'
        ),
        rule,
    )
    return hosts.distinct().select("host", F.inline(rules))


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as workbook files with a modification time."""
    number = F.col("doc_id")
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n_chars"))
    return table(spark, folder, "documents").select(
        F.concat("source", F.lit("/"), number, F.lit(".xlsx")).alias("path"), moment.alias("modificationTime")
    )


def processed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Log of the files of two thirds of the documents; half of them were older then."""
    number = F.col("doc_id")
    older = F.when(number % 3 == 1, 60).otherwise(0)
    return table(spark, folder, "documents").filter(number % 3 != 2).select(
        F.concat("source", F.lit("/"), number, F.lit(".xlsx")).alias("path"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n_chars") - older).alias("modificationTime"),
    )
