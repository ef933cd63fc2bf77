"""URL filters: host reputation from labelled page outcomes, shrunk by beta-binomial priors, and explicit rules.

Outcomes are counted by host. The prior of a suffix is the mean of all pages, that of a registered domain its suffix's
posterior mean, that of a host its domain's; how strongly each level pulls is estimated from how far its groups
differ beyond chance (empirical Bayes, by moments). A host is blocked when even the upper posterior bound of its share
of good pages stays below a floor, so unknown hosts pass.

Defined results: an address of null or without ``://`` has an empty host and path and is judged as the host ``''``;
repeated rows are judged one by one; without any outcome every address is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.tables import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second labels that belong to the suffix under a country's two-letter label.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Bounds of a prior's strength, as a number of pages.
WEAKEST, STRONGEST = 1.0, 10_000.0
#: Good pages counted for the mean of all when nothing else is known.
FLOOR, SIGMAS = 0.5, 1.645


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    long = (n >= 3) & (F.length(last) == 2) & second.isin(SECOND_LEVEL)
    return F.when(long, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    labels = F.split(host, r"\.")
    own = F.size(labels) - F.size(F.split(suffix, r"\."))
    return F.when(own >= 1, F.concat_ws(".", F.element_at(labels, own), suffix)).otherwise(host)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (host, path, verdict) that fits, as a struct of ``rule`` and ``verdict``, or null.

    A rule fits its host and all subdomains when the path begins with the rule's. Of equally long ones the first by host, path and
    verdict decides, so of two verdicts for one host and path it is to allow.
    """
    fitting = [
        F.when(
            ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule: string, verdict: string>"))


def prior_strength(groups: DataFrame) -> float:
    """Strength of the beta prior of ``groups`` (n, k) by moments: pages that the prior counts for.

    With rho the share of variance between groups, the strength is 1 / rho - 1.
    """
    s = groups.filter("n > 0").agg(
        F.count(F.lit(1)).cast("double").alias("g"), F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    if not s.n or s.g < 2:
        return STRONGEST
    p = s.k / s.n
    between, room = s.kk - p * p * s.n, s.n - s.nn / s.n - (s.g - 1)
    if p in (0.0, 1.0) or room <= 0:
        return STRONGEST
    rho = (between / (p * (1 - p)) - (s.g - 1)) / room
    return STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, 1 / rho - 1))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``host``, ``mean`` and ``upper`` from rows of (``host``, ``good``); ``good`` is 0, 1 or null where unknown.

    Groups are hosts, domains and suffixes; pages are summed before anything is shuffled.
    """
    suffix = suffix_of(F.col("host"))
    hosts = written(
        outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k"))
        .withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))),
        "hosts",
    )
    total = F.sum("n").alias("n"), F.sum("k").alias("k")
    domains = written(hosts.groupBy("domain", "suffix").agg(*total), "domains")
    suffixes = domains.groupBy("suffix").agg(*total)
    everything = hosts.agg(*total).first()
    mean = everything.k / everything.n if everything.n else 1.0

    def shrunk(level: DataFrame, prior: Column) -> DataFrame:
        strength = F.lit(prior_strength(level))
        return level.withColumn("a", F.col("k") + strength * prior).withColumn("b", F.col("n") - F.col("k") + strength * (1 - prior))

    posterior = F.col("a") / (F.col("a") + F.col("b"))
    of_suffix = shrunk(suffixes, F.lit(mean)).select("suffix", posterior.alias("suffix_mean"))
    of_domain = shrunk(domains.join(of_suffix, "suffix"), F.col("suffix_mean")).select("domain", posterior.alias("domain_mean"))
    size = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return shrunk(hosts.join(of_domain, "domain"), F.col("domain_mean")).select(
        "host", posterior.alias("mean"), (posterior + SIGMAS * deviation).alias("upper")
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url",
    floor: float = FLOOR,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the host's ``upper`` bound for every row of ``pages``.

    ``outcomes`` has ``page_id`` and ``good``. A rule's verdict goes before the host's.
    """
    known = outcomes.groupBy(F.col("page_id").alias(page_id)).agg(F.max("good").alias("good"))
    named = pages.select(page_id, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    reputation = written(host_reputation(named.join(known, page_id, "left").select("host", "good")), "reputation")
    fit = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        named.join(reputation, "host", "left").withColumn("fit", fit)
        .select(
            page_id, "host", "path", F.col("fit.rule").alias("rule"),
            F.coalesce(F.col("fit.verdict"), F.when(F.col("upper") < floor, "block").otherwise("allow")).alias("verdict"),
            "upper",
        )
    )
