import math
from collections import Counter

import numpy as np

from civicspark.llm import language_id as G


def test_shares_reach_the_best_likelihood():
    rng = np.random.default_rng(4)
    p = rng.random((2, 50))
    p /= p.sum(axis=1, keepdims=True)
    weight = 40 * (0.3 * p[0] + 0.7 * p[1]) + 0.1
    shares, value = G._shares(p, weight)
    tried = [float(weight @ np.log(a * p[0] + (1 - a) * p[1])) for a in np.linspace(0.001, 0.999, 999)]
    assert abs(value - max(tried)) < 1e-2 and abs(shares.sum() - 1) < 1e-9


def test_languages_and_mixtures(spark, tables):
    folder = tables.replace("0.001", "0.01")
    given = spark.read.parquet(f"{folder}/documents.parquet")
    model = G.fit(given.filter("crc32(string(doc_id)) % 4 <> 2"))
    assert model.languages == ["de", "en", "es", "fr"]
    asked = given.filter("crc32(string(doc_id)) % 4 = 2")
    found = {r.doc_id: r for r in G.identify(asked, model).collect()}
    right = [found[r.doc_id].lang_pred == r.lang for r in asked.collect()]
    assert np.mean(right) > 0.95
    by = {r.lang: r.text for r in given.filter("n_chars between 1500 and 4000 and crc32(string(doc_id)) % 4 = 2").collect()}
    mixed = spark.createDataFrame([(1, by["de"] + "\n" + by["es"])], "doc_id long, text string")
    (row,) = G.identify(mixed, model).collect()
    assert set(row.languages) == {"de", "es"} and abs(sum(row.shares) - 1) < 1e-6


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, "12 34!"), (4, "Ünder"), (4, "Ünder"), (None, "word"), (6, "ab " * 60_000), (7, "日本")]
    given = documents(rows)
    nothing = G.fit(given)
    assert nothing.languages == [] and {r.lang_pred for r in G.identify(given, nothing).collect()} == {"und"}
    model = G.fit(given.selectExpr("doc_id", "text", "if(doc_id = 6, 'xx', if(doc_id = 4, 'yy', null)) as lang"))
    assert model.languages == ["xx", "yy"]
    found = [(r.doc_id, r.lang_pred, r.score) for r in G.identify(given, model).collect()]
    assert len(found) == len(rows)
    assert {p for i, p, _ in found if i in (1, 2, 3)} == {"und"}
    assert {p for i, p, _ in found if i == 6} == {"xx"} and {p for i, p, _ in found if i == 4} == {"yy"}
    assert all(0 <= s <= 1 for *_, s in found)
    assert G.identify(documents([]), model).count() == 0


def _buckets(text):
    """Trigrams of letters, gaps between them as one; in plain Python."""
    letters = [b | 0x20 if 0x41 <= b <= 0x5A else b for b in text.encode()]
    letters = [b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in letters]
    kept = [b for k, b in enumerate(letters) if k == 0 or b or letters[k - 1]]
    return [(((a << 16 | b << 8 | c) * 2654435761) % 2**32) >> 19 for a, b, c in zip(kept, kept[1:], kept[2:], strict=False)]


def _plain(rows, labelled):
    """Counts, likelihoods, mixtures and the choice of the languages, without the module."""
    names = sorted({lang for _, lang in labelled})
    counts = {n: Counter() for n in names}
    for text, lang in labelled:
        counts[lang].update(_buckets(text))
    total = {n: sum(c.values()) for n, c in counts.items()}
    like = {n: lambda b, n=n: (counts[n][b] + 0.5) / (total[n] + 0.5 * 8192) for n in names}

    def mixture(chosen, weight):
        shares = {n: 1 / len(chosen) for n in chosen}
        for _ in range(25):
            after = dict.fromkeys(chosen, 0.0)
            for b, w in weight.items():
                mixed = sum(shares[n] * like[n](b) for n in chosen)
                for n in chosen:
                    after[n] += shares[n] * like[n](b) * w / mixed / sum(weight.values())
            moved, shares = max(abs(after[n] - shares[n]) for n in chosen), after
            if moved < 1e-3:
                break
        return shares, sum(w * math.log(sum(shares[n] * like[n](b) for n in chosen)) for b, w in weight.items())

    for i, text in rows:
        weight = {b: n / 3 for b, n in Counter(_buckets(text)).items()}
        single = {n: sum(w * math.log(like[n](b)) for b, w in weight.items()) for n in names}
        best = max(names, key=lambda n: single[n])
        shares, _ = mixture(names, weight)
        order = sorted(names, key=lambda n: -shares[n])
        found, value, cost = {best: 1.0}, single[best], 4.0 * math.log(max(sum(weight.values()), 2.0))
        for k in range(2, len(names) + 1):
            own, reached = mixture(sorted(order[:k]), weight)
            if reached - (k - 1) * cost <= value:
                break
            found, value = own, reached - (k - 1) * cost
        top = max(sorted(found), key=lambda n: found[n])
        yield i, top, found[top], set(found)


def test_equals_plain_python(spark, tables):
    given = spark.read.parquet(f"{tables}/documents.parquet").filter("length(text) < 1500")
    model = G.fit(given.filter("crc32(string(doc_id)) % 4 <> 2"))
    labelled = [(r.text, r.lang) for r in given.filter("crc32(string(doc_id)) % 4 <> 2 AND lang IS NOT NULL").collect()]
    rows = [(r.doc_id, r.text) for r in given.collect() if len(_buckets(r.text)) > 0]
    by = {r.lang: r.text for r in given.collect() if len(r.text) > 400}
    mixed = [(10_000 + k, by[a] + "\n" + by[b]) for k, (a, b) in enumerate([("de", "es"), ("en", "fr"), ("fr", "de")])]
    asked = spark.createDataFrame(rows + mixed, "doc_id long, text string")
    found = {r.doc_id: r for r in G.identify(asked, model).collect()}
    several = 0
    for i, top, score, languages in _plain(rows + mixed, labelled):
        assert found[i].lang_pred == top and set(found[i].languages) == languages
        assert abs(found[i].score - score) < 1e-6
        several += len(languages) > 1
    assert several >= 2


def test_letters_without_a_trigram(spark, documents):
    model = G.fit(spark.createDataFrame([("aaaa aaaa", "xx"), ("bbb", "yy")], "text string, lang string"))
    found = {r.doc_id: (r.lang_pred, r.score, r.languages) for r in G.identify(documents([(1, "a"), (2, "é"), (3, "b!")]), model).collect()}
    assert {f[0] for f in found.values()} == {"xx"} and all(0.5 < f[1] < 1 and f[2] == ["xx"] for f in found.values())
