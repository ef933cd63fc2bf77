import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from civicspark.llm import lexical_search as L

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute(rows, items, k):
    """Every document scored for every item."""
    held = [(i, Counter(terms(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total if c else 0
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture
def asked(spark):
    return lambda items: spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, item string, score int")


def found(frame, items, k=10):
    return sorted((tuple(r) for r in L.search(L.build_index(frame), items, k).collect()), key=repr)


def corpus(seed, count):
    rng = random.Random(seed)
    stock = [f"w{k}" for k in range(60)] + ["Äpfel", "日本", "x-y", "A1"]
    weights = [1 / (k + 1) for k in range(len(stock))]
    rows = [(k, " ".join(rng.choices(stock, weights, k=rng.choice([1, 3, 5, 8, 8, 8, 40])))) for k in range(count)]
    items = [(k, " ".join(rng.choices(stock, weights, k=rng.randint(1, 12)))) for k in range(15)]
    return rows, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("k", [1, 4, 500])
def test_equals_brute_force(spark, documents, asked, seed, k):
    rows, items = corpus(seed, 150)
    assert found(documents(rows), asked(items), k) == brute(rows, items, k)


def test_small_bounds_change_nothing(documents, asked, monkeypatch):
    """Shards of a few documents, groups of a few strata, pieces and blocks of a few entries."""
    rows, items = corpus(7, 120)
    expected = brute(rows, items, 5)
    for name, value in {"SHARD_DOCS": 7, "GROUP_STRATA": 3, "PIECE": 5, "CELLS": 20, "BLOCK_TERMS": 16}.items():
        monkeypatch.setattr(L, name, value)
        assert found(documents(rows), asked(items), 5) == expected


def test_strata_below_the_best_are_left_out(documents, asked, monkeypatch):
    """A copy of the item in a short document beats what long documents without its rare terms can reach."""
    rows = [(k, f"common filler{k} " + "pad " * (50 + k)) for k in range(60)] + [(100, "rare odd common")]
    visited = []
    real = L._Block._visit

    def seen(self, part, bound, *rest):
        active = (bound[part] >= self.least) & (bound[part] > 0)
        visited.append(int(active.sum()))
        real(self, part, bound, *rest)

    index = L.build_index(documents(rows))
    block_rows = index.strata.toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(L._Block, "_visit", seen)
    block = L._Block(pa.array(["common", "odd", "rare"]), np.arange(4), np.zeros(3, dtype=np.int64), np.array([10, 4000, 4000]), 1, 1)
    block.start()
    block.search(block_rows)
    assert block.ids[0] == [100] and sum(visited) < block_rows.num_rows // 4


def test_nulls_ties_and_repeats(documents, asked):
    rows = [
        (3, "alpha beta"), (1, "alpha beta"), (1, "alpha beta"), (None, "ALPHA beta"), (2, None), (4, ""), (5, "., !"), (6, "gamma " * 3000), (7, "delta"),
    ]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, "nowhere"), (None, "Gamma, gamma!"), (5, "?")]
    got = found(documents(rows), asked(items))
    assert got == brute(rows, items, 10)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 1] == [1, 1, 1, 1, 3, 3, None, None]
    assert sorted(r[1] for r in got if r[0] == 1) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_empty_tables(documents, asked):
    assert found(documents([]), asked([(1, "a")])) == []
    assert found(documents([(1, "a b")]), asked([])) == []
    assert found(documents([(1, None)]), asked([(1, "a")])) == []
    frame = L.search(L.build_index(documents([])), asked([]))
    assert dict(frame.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_very_long_text_and_numbers(documents, asked):
    rows = [(1, "word " * 200_000 + "needle"), (2, "needle"), (3, "word")]
    assert found(documents(rows), asked([(1, "needle word")])) == brute(rows, [(1, "needle word")], 10)
    assert L.normaliser(np.array([10**6]), 10**12, 10**15).tolist() == [10 + 90 * 10**18 // 10**15]
