from pyspark.sql import functions as F

from civicspark.llm import url_filters as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow")]


def judged(spark, urls, outcomes=(), rules=RULES):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    good = spark.createDataFrame(list(outcomes), "page_id long, good int")
    return {r.page_id: r for r in U.judge_urls(pages, good, rules).collect()}


def test_parts_and_rules(spark):
    urls = [
        "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://example.org", "x://b.com/fr/", "//no/scheme", None, "",
        "http://badexample.org/es/", "http://É.com/FR/", "u://h?a://b/c", "http://example.org/es/x?next=http://other/",
    ]
    found = judged(spark, urls)
    assert [(found[k].host, found[k].path, found[k].rule, found[k].verdict) for k in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "", None, "allow"), ("b.com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("badexample.org", "/es/", "org/", "allow"), ("É.com", "/FR/", None, "allow"), ("h", "", None, "allow"),
        ("example.org", "/es/x", "example.org/es/", "block"),
    ]


def test_bad_hosts_are_blocked_and_unknown_ones_pass(spark):
    urls, outcomes = [], []
    for host, n, good in [("bad.a.com", 40, 0.05), ("fine.a.com", 40, 0.9), ("c.net", 300, 0.95), ("new.a.com", 3, None), ("few.c.net", 2, 0.0)]:
        for k in range(n):
            if good is not None:
                outcomes.append((len(urls), int(k < good * n)))
            urls.append(f"http://{host}/{k}")
    outcomes += [(0, 0), (1, None), (10_000, 1)]
    found = judged(spark, urls, outcomes, [])
    by = {}
    for r in found.values():
        by.setdefault(r.host, set()).add(r.verdict)
    assert by == {"bad.a.com": {"block"}, "fine.a.com": {"allow"}, "c.net": {"allow"}, "new.a.com": {"allow"}, "few.c.net": {"allow"}}


def test_domains(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.com",), ("com",), ("",), ("1.2.3.4",)], "host string")
    suffix = U.suffix_of(F.col("host"))
    found = {r.host: (r.s, r.d) for r in rows.select("host", suffix.alias("s"), U.domain_of(F.col("host"), suffix).alias("d")).collect()}
    assert found == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("uk", "co.uk"), "x.y.com": ("com", "y.com"), "com": ("com", "com"), "": ("", ""),
        "1.2.3.4": ("4", "3.4"),
    }


def test_prior_strength(spark):
    alike = spark.createDataFrame([(100, 50 + k % 3) for k in range(30)], "n long, k long")
    unlike = spark.createDataFrame([(100, 95 if k % 2 else 5) for k in range(30)], "n long, k long")
    assert U.prior_strength(alike) == U.STRONGEST and U.prior_strength(unlike) < 2
    assert U.prior_strength(alike.limit(0)) == U.STRONGEST


def test_empty_tables(spark):
    assert judged(spark, []) == {}


def test_equal_rules(spark):
    rules = [("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("b.org", "/", "allow"), ("b.org", "/", "block"), ("org", "/xy/z", "block"), ("c.org", "/xyz", "allow")]
    frame = spark.createDataFrame([("a.org", "/x"), ("b.org", "/q"), ("s.c.org", "/xyz")], "host string, path string")
    for given in (rules, rules[::-1]):
        fit = U.matching_rule(frame.host, frame.path, given)
        assert [tuple(r[0]) for r in frame.select(fit).collect()] == [("a.org/x", "allow"), ("b.org/", "allow"), ("c.org/xyz", "allow")]
