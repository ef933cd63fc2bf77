"""Reach of a crawl over stored pages, hop by hop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark import storage
from civicspark.functions import html as H
from civicspark.functions import urls as U
from civicspark.operators import links as L
from civicspark.sources.web import load_state, save_state


def crawl(
    seeds: DataFrame,
    pages: DataFrame,
    visited: DataFrame | None = None,
    rules: DataFrame | None = None,
    agent: str = "*",
    extensions: Sequence[str] = U.DEFAULT_EXCLUDED_EXTENSIONS,
    directories: Sequence[str] = U.DEFAULT_EXCLUDED_DIRECTORIES,
    prefixes: Sequence[str] = U.DEFAULT_PATH_PREFIXES,
    max_hops: int | None = None,
    hosts: DataFrame | None = None,
    work: str | None = None,
    digits: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Reach from ``seeds(url)`` and the URLs left over when ``max_hops`` ends the crawl.

    The reach is ``url, url_hash, hop, allowed, crawled`` of every URL met,
    the rest is ``url, url_hash``.

    Every URL met is visited once, at its first hop. One that passes the
    policy (and, if ``rules`` are given, the robots rules) is looked up in
    ``pages(url, html[, content_type])``; an HTML page adds its links to the
    next hop as far as they are on the host of a seed (of ``hosts(url)`` if given). ``crawled`` marks URLs
    that were fetched: HTML pages, and pages that are missing from the store.
    ``visited(url_hash)`` of an earlier crawl is left out.

    Anchors, what is known of each page and the URLs met lie in folders by the first digits of their hashes (``digits``;
    by default so many that a folder has about ``PAGES_PER_FOLDER`` pages). Every hop looks up which folders its
    URLs fall into and reads those only, so a late hop costs what its frontier costs, not what the store holds. Hosts,
    robots rules and every hop are written, later hops read files instead of a growing plan, and a lost
    executor costs one stage. Only names of folders (4,096 at most) come to the driver. The result reads these files in
    ``work``, a new folder below the shared one by default; drop it (``storage.drop``) when done.

    Hashes are kept as bytes, the references of a stored row together, and a hop's links only until the hop is met; a write's shuffle
    files go with it.
    """
    spark = seeds.sparkSession
    home = work or storage.run_dir(spark, "reach")

    def written(frame: DataFrame, name: str, *by: str) -> DataFrame:
        with storage.brief_shuffles(spark):
            frame.write.partitionBy(*by).parquet(f"{home}/{name}", compression="zstd")
        return spark.read.schema(frame.schema).parquet(f"{home}/{name}")

    hosts = written((seeds if hosts is None else hosts).select(U.netloc_of(F.col("url")).alias("netloc")).distinct(), "hosts")
    rules = written(L.robots_table(rules, agent), "rules") if rules is not None else None
    visited = written(visited.select(_packed(F.col("url_hash")).alias("url_hash")).distinct(), "visited") if visited is not None else None

    if digits is None:
        digits = _digits(pages.count())
    is_html = F.lit(True)
    if "content_type" in pages.columns:
        is_html = H.mime_type(F.col("content_type")).isin(L.HTML_TYPES)
    stored = pages.select(U.url_hash(U.normalize_url(F.col("url"))).alias("page_hash"), "html", is_html.alias("html_page"))
    stored = stored.withColumns({"part": _part("page_hash", digits), "page_hash": F.unhex("page_hash")})
    known = written(_in_folders(stored.groupBy("part", "page_hash").agg(F.max("html_page").alias("html_page")), digits), "known", *_by(digits))
    anchors = stored.filter("html_page").select("part", "page_hash", F.array_distinct(H.hrefs(F.col("html"))).alias("hrefs"))
    anchors = written(_in_folders(anchors, digits), "anchors", *_by(digits))

    def placed(urls: DataFrame) -> DataFrame:
        page = U.url_hash(U.normalize_url(F.col("url")))
        hashed = L.with_hash(urls).withColumn("page_hash", page).withColumns(
            {"part": _part("page_hash", digits), "met_part": _part("url_hash", digits)}
        )
        same = F.col("page_hash") == F.col("url_hash")
        return hashed.withColumns({"url_hash": F.unhex("url_hash"), "page_hash": F.when(same, F.lit(_SAME)).otherwise(F.unhex("page_hash"))})

    page_hash = F.when(F.col("page_hash") == F.lit(_SAME), F.col("url_hash")).otherwise(F.col("page_hash")).alias("page_hash")

    found = written(placed(L.seed_urls(seeds)), "found/hop=0")
    hop = 0
    while True:
        fresh = found
        if hop:
            near = of_parts(seen.select("url_hash", "met_part"), "met_part", parts_of(found, "met_part"))  # noqa: F821
            fresh = L.unvisited(fresh, near)
        if visited is not None:
            fresh = L.unvisited(fresh, visited)
        met = fresh.withColumn("allowed", L.url_allowed(F.col("url"), extensions, directories, prefixes))
        if rules is not None:
            passed = L.robots_filter(met.filter("allowed"), rules, agent).select("url_hash", F.lit(True).alias("_pass"))
            met = met.join(passed, "url_hash", "left").withColumn(
                "allowed", F.coalesce("_pass", F.lit(False))
            ).drop("_pass")
        pages_near = of_parts(known, "part", parts_of(found, "part")).select("page_hash", "html_page")
        pages_near = pages_near.withColumnRenamed("page_hash", "known_hash")
        met = met.join(pages_near, page_hash == F.col("known_hash"), "left").select(
            "url", "url_hash", "page_hash", "allowed",
            (F.col("allowed") & F.coalesce("html_page", F.lit(True))).alias("crawled"),
            (F.col("allowed") & F.coalesce("html_page", F.lit(False))).alias("expands"),
            "part", "met_part",
        )
        with storage.brief_shuffles(spark):
            _in_folders(met, digits, "met_part").write.mode("overwrite").partitionBy("met_part").parquet(f"{home}/met/hop={hop}", compression="zstd")
        storage.drop(spark, f"{home}/found/hop={hop}")
        seen = spark.read.schema(_MET).parquet(f"{home}/met")
        latest = seen.filter((F.col("hop") == hop) & F.col("expands"))
        parts = parts_of(latest, "part")
        # Equal links of one hop are dropped before and after the shuffle; a
        # page that very many others link to arrives once per task.
        links = (
            latest.select("part", page_hash, F.col("url").alias("base_url"), U.split_url(F.col("url")).as_struct().alias("base_parts"))
            .join(of_parts(anchors, "part", parts), ["part", "page_hash"])
            .select(F.inline(U.resolve_links(F.col("base_url"), F.col("hrefs"), F.col("base_parts"))))
            .withColumn("netloc", U.netloc_of(F.col("url")))
            .join(hosts, "netloc", "left_semi")
            .select("url").distinct()
        )
        if not parts or (max_hops is not None and hop >= max_hops):
            break
        found = written(placed(links), f"found/hop={hop + 1}")
        if found.isEmpty():
            storage.drop(spark, f"{home}/found")
            break
        hop += 1
    left = L.unvisited(links.select("url", F.unhex(U.url_hash(F.col("url"))).alias("url_hash")), seen)
    left = (left if visited is None else L.unvisited(left, visited)).select("url", _unpacked("url_hash"))
    met = seen.filter(F.col("hop") <= hop)
    reach = met.select("url", _unpacked("url_hash"), F.col("hop").cast("int").alias("hop"), "allowed", "crawled")
    return reach, left if parts else left.limit(0)


_MET = (
    "url string, url_hash binary, page_hash binary, allowed boolean, crawled boolean, expands boolean, part string, "
    "hop int, met_part string"
)

#: Stands for the hash of a page that is that of the URL.
_SAME = bytearray()

#: Pages of a folder, about; and digits of a hash that name one, at most.
PAGES_PER_FOLDER = 50_000
MOST_DIGITS = 3


def _digits(pages: int) -> int:
    digits = 0
    while digits < MOST_DIGITS and pages > PAGES_PER_FOLDER * 16**digits:
        digits += 1
    return digits


def _packed(url_hash: Column) -> Column:
    """A hash as bytes; text that is no hash, which no URL has, becomes null."""
    return F.when(url_hash.rlike("^[0-9a-f]{64}$"), F.unhex(url_hash))


def _unpacked(column: str) -> Column:
    return F.lower(F.hex(column)).alias(column)


def _part(column: str, digits: int) -> Column:
    return F.concat(F.lit("x"), F.substring(column, 1, digits))


def _by(digits: int) -> list[str]:
    return ["part"] if digits else []


def _in_folders(rows: DataFrame, digits: int, column: str = "part") -> DataFrame:
    """Rows of a folder come together, so that it gets few files, and a large one as many as it needs."""
    return rows.hint("rebalance", column) if digits else rows


def parts_of(rows: DataFrame, column: str) -> list[str]:
    """The folders that ``rows`` fall into."""
    return [r[0] for r in rows.select(column).distinct().collect()]


def of_parts(rows: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """Rows of some folders; the others are not read."""
    return rows.filter(F.col(column).isin(parts)) if parts else rows.limit(0)


def crawl_reach(seeds: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """The reach of :func:`crawl`, which takes the same ``options``."""
    return crawl(seeds, pages, **options)[0]


def resume_crawl(
    seeds: DataFrame, pages: DataFrame, state: str, max_hops: int | None = None, **options
) -> DataFrame:
    """Go on from the latest snapshot at ``state`` and write the next one; gives the new part of the reach.

    URLs visited before are skipped, those pending are taken up. Without a
    snapshot that verifies the crawl begins anew.
    """
    saved = load_state(seeds.sparkSession, state)
    before = saved[0] if saved else None
    start = seeds.select("url").union(saved[1].select("url")).distinct() if saved else seeds
    hosts = options.pop("hosts", seeds)
    reach, left = crawl(start, pages, visited=before, max_hops=max_hops, hosts=hosts, **options)
    save_state(reach.select("url_hash"), left.select("url"), state, only_new=True)
    return reach
