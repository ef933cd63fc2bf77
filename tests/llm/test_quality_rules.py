import collections
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from civicspark.llm import quality_rules as R

from .conftest import words_of

TEXTS = [
    None, "", "\n\n", "a b c a b c", "x\nx\n\nx \n#*$ %&|<> x\n", "é é é é", "one two", "Ab ab Ab ab Ab ab", "long " * 30_000,
    "\n".join(["same line here"] * 40), " ".join(f"w{k}" for k in range(60)),
]


def brute(text):
    text = text or ""
    words = words_of(text, lower=False)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often, covered = collections.Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered |= {k, k + 1, k + 2}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_counts_equal_brute_force():
    counts, features = R.statistics(pa.array(TEXTS, type=pa.string()))
    assert counts.tolist() == [brute(t) for t in TEXTS]
    assert features.shape == (len(TEXTS), len(R.FEATURES)) and np.isfinite(features).all()


def test_forest_equals_walking_each_row():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 3))
    forest = R.grow(rows, trees=9, tree_rows=64)
    rows = np.vstack([rows[:20], [[50, 50, 50]]])
    expected = []
    for row in rows:
        total = 0
        for feature, cut in zip(forest.feature, forest.cut, strict=True):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + (row[feature[node]] >= cut[node])
            total += cut[node]
        expected.append(2 ** (-total / 9 / forest.usual))
    assert np.allclose(forest.scores(rows), expected)
    assert forest.scores(rows)[-1] == forest.scores(rows).max()


def test_judge_and_filter_agree(spark, documents, tables):
    given = spark.read.parquet(f"{tables}/documents.parquet")
    rules = R.fit(given, spark.read.parquet(f"{tables}/labels.parquet"))
    judged = {r.doc_id: r for r in R.judge(given, rules).collect()}
    assert {r.doc_id for r in R.keep_good(given, rules).collect()} == {i for i, r in judged.items() if r.kept}
    labels = spark.read.parquet(f"{tables}/labels.parquet").collect()
    good = [judged[r.doc_id].kept for r in labels if r.quality == 1 and not judged[r.doc_id].base_failed]
    bad = [judged[r.doc_id].kept for r in labels if r.quality == 0 and not judged[r.doc_id].base_failed]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3

    odd = documents([(k, t) for k, t in enumerate(TEXTS)] + [(None, "a"), (3, TEXTS[3])])
    assert R.judge(odd, rules).count() == odd.count()
    kept = R.keep_good(odd, rules)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {10}


def test_threshold_and_verdicts_recomputed(spark, tables):
    """From the counts and scores of single rows, in plain Python: every threshold is tried."""
    given, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    rules = R.fit(given, labels)
    judged = {r.doc_id: r for r in R.judge(given, rules).collect()}
    texts = {r.doc_id: r.text for r in given.collect()}
    failed = {}
    for i, text in texts.items():
        n, _, _, _, repeated = brute(text)
        failed[i] = n < 50 or 100 * repeated > 50 * n
        assert judged[i].base_failed == failed[i]
    quality = {}
    for r in labels.collect():
        if r.quality is not None and r.doc_id in texts and not failed[r.doc_id]:
            quality[r.doc_id] = max(quality.get(r.doc_id, 0), r.quality)
    place = {i: int(judged[i].score * R.BINS) for i in texts}
    good, bad = ([place[i] for i, q in quality.items() if (q > 0) == want] for want in (True, False))
    cost = [4.0 * sum(p >= t for p in good) / len(good) - sum(p >= t for p in bad) / len(bad) for t in range(R.BINS + 1)]
    threshold = min(range(R.BINS + 1), key=lambda t: (cost[t], t))
    assert cost[round(rules.threshold * R.BINS)] == cost[threshold]
    assert all(judged[i].kept == (not failed[i] and place[i] / R.BINS < rules.threshold) for i in texts)


def test_without_labels_only_base_rules_count(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    given = documents([(k, t) for k, t in enumerate(TEXTS)])
    rules = R.fit(given, labels)
    assert rules.forest is None
    assert [r.doc_id for r in R.judge(given, rules).filter("kept").collect()] == [10]
    assert R.judge(documents([]), rules).count() == 0 and R.keep_good(documents([]), rules).count() == 0


def test_least_hashes_are_the_same_however_found(spark):
    from civicspark.llm.tables import least_hashes

    frame = spark.range(5000).withColumnRenamed("id", "doc_id")
    expected = [r.doc_id for r in frame.orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()]
    assert [r.doc_id for r in least_hashes(frame, "doc_id", 300).collect()] == expected
    one = spark.range(5000).selectExpr("5L AS doc_id")
    assert least_hashes(one, "doc_id", 300).count() == 300
