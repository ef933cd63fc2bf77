import json
import random
import time
from glob import glob
from hashlib import sha256
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from civicspark.functions import html as H
from civicspark.operators import links as L
from civicspark.operators import quality as Q
from civicspark.plans import crawl as C
from civicspark.plans.crawl import crawl_reach, resume_crawl
from civicspark.sources import web


def _hrefs(spark, html):
    return spark.createDataFrame([(html,)], "html string").select(H.hrefs(F.col("html"))).first()[0]


@pytest.mark.parametrize("html, expected", [
    ('<a href="/a">x</a><A HREF=\'/b\'>y</A><a href=/c>z</a>', ["/a", "/b", "/c"]),
    ('<a class="k" data-href="/no" href = "/a?x=1&amp;y=2" id=q>', ["/a?x=1&y=2"]),
    ('<a title="a > b" href="/t">', ["/t"]),
    ('<!-- <a href="/hidden"> --><script>var s = \'<a href="/js">\';</script><a href="/seen">', ["/seen"]),
    ('<style>a{}</style><a href="">', [""]),
    ('<abbr href="/x"><link href="/y"><a name="n">', []),
    ('<a\nhref="/line">', ["/line"]),
    ('<a href="/one" href="/two">', ["/one"]),
    ("no markup", []),
])
def test_hrefs(spark, html, expected):
    assert _hrefs(spark, html) == expected


@pytest.mark.parametrize("html, url, slug", [
    ("<title> Two  words\nhere </title>", "https://a.net/x/page.html?q", "Two_words_here_page.html"),
    ("<title>A &amp; B</title>", "https://a.net/x/", "A_&_B_index"),
    ("<p>none</p>", "https://a.net", "webpage_index"),
    ("<title>" + " ".join(str(i) for i in range(60)) + "</title>", "https://a.net/z",
     "_".join(str(i) for i in range(50)) + "_z"),
])
def test_title_slug(spark, html, url, slug):
    frame = spark.createDataFrame([(html, url)], "html string, url string")
    assert frame.select(H.page_title_slug(F.col("html"), F.col("url"))).first()[0] == slug


def test_title_file_name(spark):
    frame = spark.sql("SELECT '<title>A b</title>' AS html, 'https://a.net/z' AS url, TIMESTAMP'2024-01-02 03:04:05' AS t")
    name = frame.select(H.page_title_slug(F.col("html"), F.col("url"), stamp=F.col("t"))).first()[0]
    assert name == "A_b_z_20240102030405.html"


@pytest.fixture
def pages(spark):
    html = '<a href="../up"></a><a href="?b=2&amp;a=1#f"></a><a href="//B.org/x/"></a><a href="book.xlsx"></a><a href="../up"></a>'
    return spark.createDataFrame([(1, "https://a.net/d/e/page", html)], "page_id long, url string, html string")


def test_extract_links(pages, rows_of):
    assert rows_of(L.extract_links(pages), "absolute", "url") == sorted([
        ("https://a.net/d/up", "https://a.net/d/up"),
        ("https://a.net/d/up", "https://a.net/d/up"),
        ("https://a.net/d/e/page?b=2&a=1#f", "https://a.net/d/e/page?a=1&b=2"),
        ("https://B.org/x/", "https://b.org/x"),
        ("https://a.net/d/e/book.xlsx", "https://a.net/d/e/book.xlsx"),
    ], key=repr)
    assert rows_of(L.links_by_suffix(pages), "href", "absolute") == [("book.xlsx", "https://a.net/d/e/book.xlsx")]


def test_same_domain_compares_hosts_exactly(spark, pages, rows_of):
    links = L.extract_links(pages)
    lower = spark.createDataFrame([("https://b.org/any",), ("http://b.org",)], "url string")
    assert rows_of(L.same_domain(links, lower), "url") == [("https://b.org/x",)]
    upper = spark.createDataFrame([("https://B.org",)], "url string")
    assert L.same_domain(links, upper).count() == 0


def test_mime_and_status(spark, rows_of):
    frame = spark.createDataFrame(
        [(1, 200, "text/html; charset=utf-8"), (2, 200, "application/xhtml+xml"), (3, 404, "text/html"),
         (4, 200, "application/pdf"), (5, 200, None), (6, None, "text/html")],
        "id int, status int, content_type string",
    )
    assert rows_of(L.html_only(frame), "id") == [(1,), (2,), (3,), (6,)]
    assert rows_of(L.ok_only(frame), "id") == [(1,), (2,), (4,), (5,)]


def test_frontier_and_unvisited(spark, rows_of):
    seeds = spark.createDataFrame([("https://A.net/x%20y/",)], "url string")
    start = L.seed_urls(seeds)
    assert rows_of(start) == [("https://A.net/x y/",), ("https://a.net/x y",)]
    frontier = L.frontier_union(start, start, spark.createDataFrame([("https://a.net/z",)], "url string"))
    assert frontier.count() == 3
    visited = frontier.filter(F.col("url").endswith("z"))
    assert L.unvisited(frontier, visited).count() == 2


def test_robots(spark, rows_of):
    urls = spark.createDataFrame([(u,) for u in (
        "https://a.net", "https://a.net/private/x", "https://a.net/private/open/y", "https://a.net/tie",
        "https://b.net/x", "https://none.net/x", "https://c.net/x?q=1",
    )], "url string")
    rules = spark.createDataFrame([
        ("a.net", "*", "/private", False), ("a.net", "*", "/private/open", True),
        ("a.net", "*", "/tie", False), ("a.net", "*", "/tie", True), ("a.net", "*", "", False),
        ("b.net", "*", "/", True), ("b.net", "CityBot", "/", False),
        ("c.net", "*", "/x?q", False),
    ], "host string, agent string, prefix string, allow boolean")
    kept = L.robots_filter(urls, rules, "Mozilla citybot/2.0")
    assert rows_of(kept) == [("https://a.net",), ("https://a.net/private/open/y",), ("https://a.net/tie",)]
    assert ("https://b.net/x",) in rows_of(L.robots_filter(urls, rules, "other"))


def test_totals_and_eta(spark):
    log = spark.sql("SELECT timestamp_seconds(id * 10) AS ts FROM range(5)")
    assert tuple(L.crawl_eta(log, queued=3).first()) == (5, 8, 40.0, 24.0)
    assert tuple(L.crawl_eta(log, queued=3, total=10).first()) == (5, 10, 40.0, 40.0)
    assert tuple(L.crawl_eta(log.limit(0), queued=3).first()) == (0, 3, 0.0, 0.0)
    hashes = spark.createDataFrame([("a",), ("b",), ("a",)], "url_hash string")
    targets = spark.createDataFrame([("t",)], "target string")
    assert tuple(L.crawl_totals(log, hashes, targets).first()) == (5, 2, 1)


def test_state_check(spark):
    def state(*hashes):
        return spark.createDataFrame([(h,) for h in hashes], "url_hash string")

    assert tuple(Q.verify_visited(state("a", "b")).first()) == (True, "ok", 2, 2)
    assert tuple(Q.verify_visited(state("a", "a")).first()) == (False, "duplicates", 2, 1)
    assert tuple(Q.verify_visited(state()).first()) == (False, "empty", 0, 0)
    with pytest.raises(ValueError):
        Q.verify_visited(None)


def test_saved_state(spark, tmp_path, rows_of):
    home = str(tmp_path / "state")
    assert web.load_state(spark, home) is None
    first = spark.createDataFrame([("a",)], "url_hash string")
    pending = spark.createDataFrame([("https://a.net/p",)], "url string")
    assert web.save_state(first, pending, home) == 1
    second = first.union(spark.createDataFrame([("b",)], "url_hash string"))
    assert web.save_state(second, pending.limit(0), home) == 2
    visited, left = web.load_state(spark, home)
    assert rows_of(visited) == [("a",), ("b",)] and left.count() == 0
    web.save_state(first.union(first), pending, home)
    assert web.load_state(spark, home) is None


def test_seed_and_policy_files(spark, tmp_path, rows_of):
    (tmp_path / "seeds.json").write_text('[\n "https://a.net",\n "https://b.net"\n]')
    assert rows_of(web.read_seeds(spark, str(tmp_path / "seeds.json"))) == [("https://a.net",), ("https://b.net",)]
    (tmp_path / "bad.json").write_text("[not json")
    with pytest.raises(Exception):
        web.read_seeds(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception):
        web.read_seeds(spark, str(tmp_path / "missing.json")).collect()
    (tmp_path / "policy.json").write_text(json.dumps({"excluded_directories": ["x", "y", "x"]}))
    assert web.read_policy(spark, str(tmp_path / "policy.json")) == (["x", "y"], [])


def _page(url, *hrefs):
    return (url, "".join(f'<a href="{h}">l</a>' for h in hrefs), "text/html")


def test_reach_on_a_small_site(spark, rows_of):
    site = "https://s.net/census"
    pages = spark.createDataFrame([
        _page(f"{site}/a", "b", "d", "/news", "doc.pdf", "https://other.net/census/f"),
        _page(f"{site}/b", "c"),
        _page(f"{site}/c", "a"),
        _page(f"{site}/e", "a"),
        (f"{site}/d", '<a href="g">', "application/pdf"),
        _page("https://other.net/census/f", "https://s.net/census/h"),
    ], "url string, html string, content_type string")
    seeds = spark.createDataFrame([(f"{site}/a",)], "url string")
    reach = crawl_reach(seeds, pages)
    assert rows_of(reach, "url", "hop", "allowed", "crawled") == sorted([
        (f"{site}/a", 0, True, True),
        (f"{site}/b", 1, True, True),
        (f"{site}/d", 1, True, False),
        ("https://s.net/news", 1, False, False),
        (f"{site}/doc.pdf", 1, False, False),
        (f"{site}/c", 2, True, True),
    ], key=repr)
    assert crawl_reach(seeds, pages, max_hops=1).agg(F.max("hop")).first()[0] == 1

    seen = L.with_hash(spark.createDataFrame([(f"{site}/b",)], "url string"))
    assert (f"{site}/c",) not in rows_of(crawl_reach(seeds, pages, visited=seen), "url")

    rules = spark.createDataFrame([("s.net", "*", "/census/b", False)], "host string, agent string, prefix string, allow boolean")
    ruled = crawl_reach(seeds, pages, rules=rules, agent="bot")
    assert (f"{site}/b", False) in rows_of(ruled, "url", "allowed")
    assert (f"{site}/c",) not in rows_of(ruled, "url")


def test_missing_pages_count_as_failed_fetches(spark, rows_of):
    pages = spark.createDataFrame([_page("https://s.net", "/census/gone")], "url string, html string, content_type string")
    seeds = spark.createDataFrame([("https://s.net/",)], "url string")
    assert rows_of(crawl_reach(seeds, pages), "url", "hop", "crawled") == [
        ("https://s.net", 0, True), ("https://s.net/", 0, True), ("https://s.net/census/gone", 1, True)
    ]


@pytest.mark.parametrize("digits", [0, 1])
def test_reach_equals_breadth_first_search(spark, rows_of, digits):
    chance = random.Random(3)
    names = [f"census/n{i}" if i % 5 else f"other/n{i}" for i in range(40)]
    # A hub that nearly all pages link to, and random other links.
    out = {n: {"census/n1", *(chance.choice(names) for _ in range(2))} for n in names}
    stored = {n for n in names if chance.random() < 0.9}
    pages = spark.createDataFrame(
        [_page(f"https://s.net/{n}", *[f"/{t}" for t in out[n]]) for n in names if n in stored],
        "url string, html string, content_type string",
    )
    start = "census/n2"
    hops, queue = {start: 0}, [start]
    for name in queue:
        if name.startswith("census") and name in stored:
            for target in sorted(out[name]):
                if target not in hops:
                    hops[target] = hops[name] + 1
                    queue.append(target)
    reach = crawl_reach(spark.createDataFrame([(f"https://s.net/{start}",)], "url string"), pages, digits=digits)
    assert rows_of(reach, "url", "hop", "crawled") == sorted(
        ((f"https://s.net/{n}", h, n.startswith("census")) for n, h in hops.items()), key=repr
    )
    assert {urlparse(r.url).netloc for r in reach.collect()} == {"s.net"}


def test_a_crawl_in_parts_reaches_the_same(spark, rows_of, tmp_path):
    names = [f"census/n{i}" for i in range(8)]
    pages = spark.createDataFrame(
        [_page(f"https://s.net/{n}", *[f"/{t}" for t in names[i + 1:i + 3]]) for i, n in enumerate(names)],
        "url string, html string, content_type string",
    )
    seeds = spark.createDataFrame([("https://s.net/census/n0",)], "url string")
    whole = rows_of(crawl_reach(seeds, pages), "url")
    state, parts = str(tmp_path / "state"), []
    for _ in range(4):
        parts.extend(rows_of(resume_crawl(seeds, pages, state, max_hops=1), "url"))
    assert sorted(parts, key=repr) == whole
    visited, pending = web.load_state(spark, state)
    assert visited.count() == len(whole) and pending.count() == 0


def _files_read(frame):
    frame.collect()
    scan = frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numFiles").value()


def test_a_hop_reads_the_folders_of_its_frontier(spark, tmp_path):
    names = [f"census/n{i}" for i in range(200)]
    pages = spark.createDataFrame([_page(f"https://s.net/{n}", f"/{m}") for n, m in zip(names, [*names[1:], names[0]])], "url string, html string, content_type string")
    seeds = spark.createDataFrame([(f"https://s.net/{names[0]}",)], "url string")
    work = str(tmp_path / "work")
    reach = crawl_reach(seeds, pages, digits=1, max_hops=3, work=work)
    assert reach.count() == 4
    for name in ("anchors", "known"):
        stored = spark.read.parquet(f"{work}/{name}")
        assert 10 <= len({f.split("part=")[1].split("/")[0] for f in stored.inputFiles()}) <= 16
        hop = spark.read.parquet(f"{work}/met").filter("hop = 2")
        parts = C.parts_of(hop, "part")
        near = C.of_parts(stored, "part", parts)
        assert len(parts) == 1 and 0 < _files_read(near) < _files_read(stored) / 5
    assert C.of_parts(stored, "part", []).count() == 0
    assert [C._digits(n) for n in (0, 50_000, 50_001, 10**9, 10**12)] == [0, 0, 1, 3, 3]


def test_a_crawl_keeps_little_on_disk(spark, tmp_path):
    """Hashes as bytes, the references of a page in one row, no links of a hop that was met, no shuffle files of a write that is done."""
    names = [f"census/n{i}" for i in range(40)]
    pages = spark.createDataFrame([_page(f"https://s.net/{n}", *[f"/{m}" for m in names]) for n in names], "url string, html string, content_type string")
    seeds = spark.createDataFrame([(f"https://s.net/{names[0]}",)], "url string")
    visited = spark.createDataFrame([(sha256(f"https://s.net/{names[3]}".encode()).hexdigest(),), ("no hash",), (None,)], "url_hash string")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(f.getName().startswith("shuffle_") for f in _in_java(blocks.getAllFiles()))
    work, before = str(tmp_path / "work"), shuffled()
    reach, left = C.crawl(seeds, pages, visited=visited, digits=1, work=work)
    until = time.time() + 20
    while shuffled() > before and time.time() < until:
        time.sleep(0.5)
    assert shuffled() <= before
    found = {r.url: r.url_hash for r in reach.collect()}
    assert found == {f"https://s.net/{n}": sha256(f"https://s.net/{n}".encode()).hexdigest() for n in names if n != names[3]} and left.count() == 0
    assert dict(spark.read.parquet(f"{work}/met").dtypes)["url_hash"] == dict(spark.read.parquet(f"{work}/anchors").dtypes)["page_hash"] == "binary"
    assert spark.read.parquet(f"{work}/anchors").count() == len(names) and not glob(f"{work}/found/*")


def _in_java(rows):
    each = rows.iterator()
    while each.hasNext():
        yield each.next()


def test_snapshots_hold_new_rows_only(spark, tmp_path, rows_of):
    home = str(tmp_path / "state")
    hashes = lambda *h: spark.createDataFrame([(x,) for x in h], "url_hash string")
    pending = spark.createDataFrame([("https://a.net/p",)], "url string")
    web.save_state(hashes("a", "b"), pending, home)
    web.save_state(hashes("a", "b", "c"), pending, home)
    web.save_state(hashes("d"), pending, home, only_new=True)
    assert [rows_of(spark.read.parquet(f"{home}/visited/version={v}")) for v in (1, 2, 3)] == [[("a",), ("b",)], [("c",)], [("d",)]]
    assert rows_of(web.load_state(spark, home)[0]) == [("a",), ("b",), ("c",), ("d",)]
    web.save_state(hashes("e", "e"), pending, home, only_new=True)
    assert web.load_state(spark, home) is None
