"""Link graph of stored pages: extraction, policy, domains, robots rules, frontier and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions import html as H
from civicspark.functions import urls as U

HTML_TYPES = ["text/html", "application/xhtml+xml"]  # fixed values


def ok_only(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("status") == 200)


def html_only(pages: DataFrame) -> DataFrame:
    """Pages whose content type, up to a semicolon, is HTML."""
    return pages.filter(H.mime_type(F.col("content_type")).isin(HTML_TYPES))


def page_hrefs(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and each different ``href`` of each page."""
    return pages.select(*keep, F.explode(F.array_distinct(H.hrefs(F.col("html")))).alias("href"))


def absolute_links(hrefs: DataFrame, base: str = "base_url", parts: str | None = None) -> DataFrame:
    """Add ``absolute`` and its canonical ``url`` to references found on the page ``base``; ``parts`` names a column with its parts."""
    kept = [c for c in hrefs.columns if c not in ("href", parts)]
    return hrefs.select(*kept, F.inline(U.resolve_links(F.col(base), F.array("href"), parts and F.col(parts))))


def extract_links(pages: DataFrame, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep, base_url, href, absolute, url``: every link of every page, repeats included."""
    links = U.resolve_links(F.col("url"), H.hrefs(F.col("html")))
    return pages.select(*keep, F.col("url").alias("base_url"), F.inline(links))


def links_by_suffix(
    pages: DataFrame, suffix: str = ".xlsx", keep: Sequence[str] = ("page_id",), rules: DataFrame | None = None, agent: str = "*"
) -> DataFrame:
    """Absolute links, not normalised, of the references that end with ``suffix``; with ``rules`` only those robots may fetch."""
    matching = F.filter(H.hrefs(F.col("html")), lambda href: href.endswith(suffix))
    found = pages.select(*keep, F.col("url").alias("base_url"), F.explode(matching).alias("href")).withColumn(
        "absolute", U.url_join(F.col("base_url"), F.col("href"))
    )
    if rules is None:
        return found
    return robots_filter(found.withColumn("url", F.col("absolute")), rules, agent).drop("url")


def with_hash(links: DataFrame, url: str = "url") -> DataFrame:
    return links.withColumn("url_hash", U.url_hash(F.col(url)))


def url_allowed(
    url: Column,
    extensions: Sequence[str] = U.DEFAULT_EXCLUDED_EXTENSIONS,
    directories: Sequence[str] = U.DEFAULT_EXCLUDED_DIRECTORIES,
    prefixes: Sequence[str] = U.DEFAULT_PATH_PREFIXES,
) -> Column:
    """The three rules a queued URL has to pass: extension, path prefix, deny words."""
    return (
        U.not_excluded_ext(url, extensions) & U.allowed_path(url, prefixes) & U.not_excluded_dir(url, directories)
    )


def suffix_policy(
    url: Column,
    extensions: Sequence[str] = U.DEFAULT_EXCLUDED_EXTENSIONS,
    directories: Sequence[str] = U.DEFAULT_EXCLUDED_DIRECTORIES,
) -> Column:
    """The older link rule: deny words, and deny extensions at the end of the whole URL."""
    return U.not_excluded_dir(url, directories) & U.not_excluded_suffix(url, extensions)


def same_domain(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Links on the host of any seed. Spark broadcasts the hosts if they are few enough."""
    hosts = seeds.select(U.netloc_of(F.col("url")).alias("_netloc")).distinct()
    return links.withColumn("_netloc", U.netloc_of(F.col("url"))).join(hosts, "_netloc", "left_semi").drop("_netloc")


def unvisited(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links whose ``url_hash`` is not in ``visited``."""
    return links.join(visited.select("url_hash"), "url_hash", "left_anti")


def frontier_union(*sources: DataFrame) -> DataFrame:
    """``url, url_hash`` of all ``sources(url)`` without repeats; one row per hash."""
    urls = sources[0].select("url")
    for source in sources[1:]:
        urls = urls.union(source.select("url"))
    return with_hash(urls.distinct())


def seed_urls(seeds: DataFrame) -> DataFrame:
    """What a crawl starts from: each seed percent-decoded, and its canonical form."""
    decoded = seeds.select(U.percent_decode(F.col("url")).alias("url"))
    both = F.array("url", U.normalize_url(F.col("url")))
    return decoded.select(F.explode(both).alias("url")).distinct()


def robots_table(rules: DataFrame, agent: str) -> DataFrame:
    """``host, rules``: of each host of ``rules(host, agent, prefix, allow)`` the prefixes that bind ``agent``.

    Rules for a named agent come before those for ``*``. A row is as large as the rules file of one host.
    """
    named = F.coalesce((F.col("agent") != "*") & F.lit(agent.lower()).contains(F.lower("agent")), F.lit(False))
    rule = F.struct("prefix", "allow")
    binds = F.col("prefix") != ""
    own = rules.groupBy("host").agg(
        F.max(named).alias("_has_named"),
        F.collect_set(F.when(named & binds, rule)).alias("_named"),
        F.collect_set(F.when((F.col("agent") == "*") & binds, rule)).alias("_any"),
    )
    return own.select("host", F.when(F.col("_has_named"), F.col("_named")).otherwise(F.col("_any")).alias("rules"))


def robots_filter(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """URLs that the robots rules of their host allow for ``agent``.

    ``rules``: ``host, agent, prefix, allow``, or a :func:`robots_table`. The longest matching path prefix decides,
    and "allow" wins a tie. Without a match the URL is allowed, but a host without any rules is denied. One join.
    """
    table = (rules if "rules" in rules.columns else robots_table(rules, agent)).select(
        F.col("host").alias("_host"), F.col("rules").alias("_rules")
    )
    target = F.regexp_extract(F.col("url"), r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^#]*)", 1)
    path = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    hits = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["prefix"]))
    longest = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["prefix"]).alias("n"), r["allow"].alias("allow"))))
    placed = urls.withColumn("_host", U.netloc_of(F.col("url"))).withColumn("_path", path).join(table, "_host")
    return placed.filter(F.coalesce(longest["allow"], F.lit(True))).select(*urls.columns)


def crawl_totals(crawled: DataFrame, visited: DataFrame, downloaded: DataFrame) -> DataFrame:
    """One row ``pages_crawled, visited_links, downloaded_files``: rows, distinct hashes, distinct targets."""
    pages = crawled.agg(F.count(F.lit(1)).alias("pages_crawled"))
    links = visited.agg(F.count_distinct("url_hash").alias("visited_links"))
    files = downloaded.agg(F.count_distinct("target").alias("downloaded_files"))
    rows = pages.unionByName(links, allowMissingColumns=True).unionByName(files, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def crawl_eta(log: DataFrame, queued: int | Column, total: int = 0, ts: str = "ts") -> DataFrame:
    """``pages, total, elapsed_seconds, remaining_seconds`` of a crawl log with one row per page.

    ``total`` is raised to pages plus ``queued`` if that is more. No page gives 0.
    """
    moment = F.col(ts).cast("timestamp")
    span = (F.unix_micros(F.max(moment)) - F.unix_micros(F.min(moment))) / 1_000_000
    seen = log.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(span, F.lit(0.0)).alias("elapsed_seconds"))
    queued = queued if isinstance(queued, Column) else F.lit(queued)
    whole = seen.withColumn("total", F.greatest(F.lit(total).cast("long"), (queued + F.col("pages")).cast("long")))
    rest = F.col("elapsed_seconds") / F.nullif("pages", F.lit(0)) * (F.col("total") - F.col("pages"))
    return whole.select("pages", "total", "elapsed_seconds", F.coalesce(rest, F.lit(0.0)).alias("remaining_seconds"))
