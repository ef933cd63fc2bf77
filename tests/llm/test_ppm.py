import collections
import math

import numpy as np
import pytest

from civicspark.llm import ppm

from .conftest import words_of

TEXTS = [
    None, "", "The cat sat on the mat.\nThe cat sat.", "the dog sat on the log, the end", "zebra \x00 quartz", "été à la mer",
    "the cat and the dog", "THE CAT", "the " * 30_000, "q" * 50,
]


def brute(trained, asked):
    counts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    for text in trained:
        x = [ppm.EDGE] * ppm.ORDER + list((text or "").encode()) + [ppm.EDGE]
        for p in range(ppm.ORDER, len(x)):
            for k in range(ppm.ORDER + 1):
                counts[k][tuple(x[p - k : p])][x[p]] += 1

    def symbol(x, p):
        out, excluded = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            own = counts[k].get(tuple(x[p - k : p]))
            if not own:
                continue
            live = {s: n for s, n in own.items() if s not in excluded}
            size = sum(live.values()) + len(live)
            if x[p] in live:
                return out + math.log10(live[x[p]] / size)
            if live:
                out += math.log10(len(live) / size)
            excluded |= set(own)
        return out - math.log10(ppm.SYMBOLS - len(excluded))

    x = [ppm.EDGE] * ppm.ORDER + list((asked or "").encode()) + [ppm.EDGE]
    return sum(symbol(x, p) for p in range(ppm.ORDER, len(x)))


def base(trained, asked):
    counts = collections.Counter(w for t in trained for w in words_of(t))
    n, v = sum(counts.values()) + len(trained), len(counts) + bool(trained)
    each = math.log10(n + 0.1 * (v + 1))
    words = words_of(asked)
    score = sum(math.log10(counts[w] + 0.1) - each for w in words) + math.log10(len(trained) + 0.1) - each
    return len(words) + 1, sum(counts[w] > 0 for w in words) + bool(trained), n, score


@pytest.mark.parametrize(("grams", "frequent"), [(1 << 22, 1 << 21), (40, 8)])
def test_scores_equal_brute_force(spark, documents, grams, frequent, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_GRAMS", grams)
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    trained = TEXTS[:5] + [TEXTS[8]]
    given = documents(list(enumerate(TEXTS)) + [(2, TEXTS[2]), (None, "cat")])
    found = ppm.score_texts(given, documents(list(enumerate(trained)))).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = "cat" if r.doc_id is None else TEXTS[r.doc_id]
        tokens, known, n, score = base(trained, text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score == pytest.approx(brute(trained, text), rel=1e-9)


def test_blocks_of_rows_that_come_in_another_order_each_time(spark, documents, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_GRAMS", 40)
    texts = [f"{'ab' * k} {k} the cat" for k in range(40)]
    rows = documents(list(enumerate(texts)))
    given = rows.coalesce(1).mapInPandas(lambda parts: (p.sample(frac=1) for p in parts), rows.schema)
    found = {r.doc_id: r.score for r in ppm.score_texts(given, documents(list(enumerate(texts[:9])))).collect()}
    assert found == {k: pytest.approx(brute(texts[:9], text), rel=1e-9) for k, text in enumerate(texts)}


def test_probabilities_sum_to_one():
    import pyarrow as pa

    from civicspark.llm.words import chunks

    ((_, _, data, offsets),) = chunks(pa.array(TEXTS[2:7]))
    keys, counts = np.unique(ppm.grams(data, offsets)[0], return_counts=True)
    lower = ppm.summed(keys % ppm.SYMBOLS**3, counts)
    model = ppm.Model(lower, keys, counts)
    for context in [*np.unique(keys // ppm.SYMBOLS)[:40], 0, 5 * ppm.SYMBOLS + 101]:
        assert np.sum(10 ** model.logs(context * ppm.SYMBOLS + np.arange(ppm.SYMBOLS))) == pytest.approx(1)


def test_without_training_texts(spark, documents):
    found = ppm.score_texts(documents([(1, "ab"), (2, None)]), documents([])).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in found} == {(1, 2, 0, 0), (2, 1, 0, 0)}
    assert all(r.base_score == pytest.approx(0) for r in found)
    assert {r.doc_id: r.score for r in found}[1] == pytest.approx(-3 * math.log10(257))
    assert ppm.score_texts(documents([]), documents([(1, "a")])).count() == 0
