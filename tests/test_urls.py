import os
import random
from urllib.parse import unquote, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from civicspark.functions import urls as U

PIECES = [
    "http:", "https:", "//", "/", "a.Net", "b.net:80", "x", "Y", "..", ".", "?", "&", "=", "a=1", "b=2", "#", "top",
    ";", "%20", "%zz", "%C3%A9", "%3F", "+", "é", " ", "mailto:", "HTTP:", ".pdf", ".tar.gz", "javascript:", "user@",
    "\t", "%", "%E9",
]
BASES = [
    "https://a.net/p/q/r?x=1#f", "http://B.net", "https://a.net/", "https://a.net/p/", "https://a.net/p;z",
    "http://a.net/a//b/c", "",
]


def _normal(url, decode=True):
    parts = urlparse(unquote(url) if decode else url)
    query = "&".join(sorted(parts.query.split("&")))
    return urlunparse((parts.scheme, parts.netloc, parts.path, parts.params, query, "")).rstrip("/").lower()


@pytest.fixture(scope="module")
def generated(spark):
    chance = random.Random(11)

    def text():
        return "".join(chance.choice(PIECES) for _ in range(chance.randint(0, 9)))

    pairs = [(chance.choice(BASES) if chance.random() < 0.8 else text(), text()) for _ in range(2500)]
    url = F.col("href")
    return spark.createDataFrame(pairs, "base string, href string").select(
        "base", "href",
        U.normalize_url(url).alias("normal"),
        U.normalize_url(url, decode=False).alias("raw"),
        U.url_join(F.col("base"), url).alias("joined"),
        U.percent_decode(url).alias("decoded"),
        U.split_url(url).as_struct().alias("parts"),
        U.path_ext(url).alias("ext"),
    ).collect()


def test_equal_to_the_standard_library(generated):
    for row in generated:
        assert row.normal == _normal(row.href), row.href
        assert row.raw == _normal(row.href, decode=False), row.href
        assert row.decoded == unquote(row.href), row.href
        assert tuple(row.parts) == tuple(urlparse(row.href)), row.href
        assert row.joined == urljoin(row.base, row.href), (row.base, row.href)
        assert row.ext == os.path.splitext(urlparse(row.href).path)[1], row.href


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "u string").select(expression(F.col("u"))).first()[0]


@pytest.mark.parametrize("url, normal", [
    ("https://A.net/X%20y/?b=2&a=1#t", "https://a.net/x y/?a=1&b=2"),
    ("https://a.net/?", "https://a.net"),
    ("https://a.net/p?q=/", "https://a.net/p?q="),
    ("https://a.net/a%3Fb=1&a=2", "https://a.net/a?a=2&b=1"),
    ("http://a.net/en/25/#top", "http://a.net/en/25"),
    ("https://a.net/x+y%zz", "https://a.net/x+y%zz"),
    ("https://a.net/x%zz%20y", "https://a.net/x%zz y"),
    (None, None),
])
def test_normalize(spark, url, normal):
    assert _one(spark, url, U.normalize_url) == normal


@pytest.mark.parametrize("url, ext, path, word, allowed", [
    ("https://a.net/statistics/x", True, True, True, True),
    ("https://a.net/census/y", True, True, True, True),
    ("https://a.net/", True, True, True, True),
    ("https://a.net", True, True, True, True),
    ("https://a.net/news", True, False, True, False),
    ("https://a.net/statistics/x.pdf", False, True, True, False),
    ("https://a.net/statistics/x.PDF", True, True, True, True),
    ("https://a.net/statistics/x.zip", False, True, True, False),
    ("https://a.net/statistics/.zip", True, True, True, True),
    ("https://a.net/statistics/score", True, True, False, False),
    ("https://a.net/statistics?f=.pdf", True, True, True, True),
])
def test_policy(spark, url, ext, path, word, allowed):
    from civicspark.operators.links import url_allowed

    assert _one(spark, url, U.not_excluded_ext) is ext
    assert _one(spark, url, U.allowed_path) is path
    assert _one(spark, url, U.not_excluded_dir) is word
    assert _one(spark, url, url_allowed) is allowed


def test_older_policy_looks_at_the_end_of_the_url(spark):
    from civicspark.operators.links import suffix_policy

    assert _one(spark, "https://a.net/q?f=.pdf", suffix_policy) is False
    assert _one(spark, "https://a.net/x.pdf?q", suffix_policy) is True
    assert _one(spark, "https://a.net/about", suffix_policy) is False


def test_empty_policy_lets_all_pass(spark):
    assert _one(spark, "https://a.net/x.pdf", lambda u: U.not_excluded_ext(u, [])) is True
    assert _one(spark, "https://a.net/core", lambda u: U.not_excluded_dir(u, [])) is True


@pytest.mark.parametrize("url, current, older", [
    ("https://a.net/d/f.xlsx", "files/.xlsx/f.xlsx", "files/f.xlsx"),
    ("https://a.net/d/f", "files/f", "files/f"),
    ("https://a.net/d/", "files/", "files/"),
])
def test_local_target(spark, url, current, older):
    assert _one(spark, url, lambda u: U.local_target(u, "files")) == current
    assert _one(spark, url, lambda u: U.local_target(u, "files", by_extension=False)) == older


def test_downloadable_is_a_substring_test(spark):
    assert _one(spark, "https://a.net/x.xlsx?v=1", U.downloadable) is True
    assert _one(spark, "https://a.net/x.zipped", U.downloadable) is True
    assert _one(spark, "https://a.net/x.xls", U.downloadable) is False


def test_references_with_the_parts_of_their_page_given(spark):
    """Of many references of one page, the page is split once, outside of their rows."""
    from civicspark.operators.links import absolute_links

    refs = ["x", "/x", "../x", "./../x/.", "/a/../x", "?q", "#f", "?q#f", "//h.net/x", "//h.net?q", "http://h.net/y#f", "x;p", "?", "x?#", "//", " x", "mailto:m"]
    pages = [b for b in BASES if b]
    rows = spark.createDataFrame([(b, r) for b in pages for r in refs], "base_url string, href string")
    rows = rows.withColumn("parts", U.split_url(F.col("base_url")).as_struct())
    found = absolute_links(rows, parts="parts")
    assert found.columns == ["base_url", "href", "absolute", "url"]
    for row in found.collect():
        assert row.absolute == urljoin(row.base_url, row.href), (row.base_url, row.href)
        assert row.url == _normal(row.absolute)
