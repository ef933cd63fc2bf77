import random

import numpy as np
import pytest

from civicspark.llm import jaccard_join as J

from .conftest import words_of


def gram_set(text, n):
    words = words_of(text)
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def brute(rows, n, percent):
    sets = [(i, gram_set(t, n)) for i, t in rows]
    near = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                near[a].add(b), near[b].add(a)
    out = []
    for k in range(len(rows)):
        reached, todo = {k}, [k]
        while todo:
            for other in near[todo.pop()] - reached:
                reached.add(other), todo.append(other)
        out.append((sets[k][0], len(sets[k][1]), min(sets[r][0] for r in reached), len(near[k])))
    return sorted(out)


def corpus(seed, groups=6, copies=9, length=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    shared = " ".join(word() for _ in range(20))
    rows, at = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(length // 3, length))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append((at, " ".join(own) if rng.random() < 0.7 else shared + "\n" + " ".join(own).upper()))
            at += 1
    return rows + [(at, None), (at + 1, ""), (at + 2, "one two"), (at + 3, "ONE\ttwo"), (at + 4, "  ")]


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 1 << 20), (5, 80, 300), (2, 60, 200), (3, 100, 1 << 20)])
def test_join_equals_all_pairs(spark, documents, n, percent, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TOKENS", block)
    rows = corpus(n * 100 + percent)
    found = J.join_alike(documents(rows), n, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found.collect()) == brute(rows, n, percent)


def test_shuffled_members_instead_of_broadcast(spark, documents, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_SETS", 0)
    rows = corpus(8, groups=3)
    found = J.join_alike(documents(rows), 4, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found.collect()) == brute(rows, 4, 85)


def test_a_chain_of_chance_n_grams_meets_its_neighbours_only(spark, documents, monkeypatch):
    """Documents that share a line with the next one each are compared with few others, however long the chain is."""

    def rows_compared(percent):
        return lambda group: group.assign(a=group["set"], b=group["set"], links=1)[["a", "b", "links"]]

    lines = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(301)]
    rows = [(k, f"{lines[k]}\n{lines[k + 1]}") for k in range(300)]
    monkeypatch.setattr(J, "BLOCK_TOKENS", 210)
    assert [r.n_links for r in J.join_alike(documents(rows), 4, 50).collect()] == [0] * 300
    monkeypatch.setattr(J, "_find_links", rows_compared)
    sent = [r.n_links for r in J.join_alike(documents(rows), 4, 50).collect()]
    assert min(sent) > 0 and max(sent) <= 8


def test_homes_of_many_blocks_equal_all_pairs(spark, documents, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(J, "STEP_LABELS", 7)
    monkeypatch.setattr(J, "STEP_MARKS", 500)
    rows = [(3 * k + j, t) for k, (_, t) in enumerate(corpus(11, groups=3, copies=14)) for j in range(1 + k % 2)]
    found = J.join_alike(documents(rows), 4, 60)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found.collect()) == brute(rows, 4, 60)


def test_trie_finds_what_comparison_finds():
    rng = np.random.default_rng(6)
    for percent in (50, 80, 95):
        base = rng.choice(200, 40, replace=False)
        sets = []
        while len(sets) < 40:
            own = np.unique(np.where(rng.random(40) < rng.choice([0, 0.05, 0.2, 1]), rng.integers(0, 200, 40), base)[: rng.integers(5, 41)])
            if not any(np.array_equal(own, s) for s in sets):
                sets.append(own)
        places = np.arange(len(sets))
        for k, near in J.links_between([s.astype(np.int64) for s in sets], places, places, percent):
            expected = {
                o for o in places if o != k
                and 100 * len(np.intersect1d(sets[k], sets[o])) >= percent * len(np.union1d(sets[k], sets[o]))
            }
            assert set(near.tolist()) == expected


def test_repeats_and_empty_tables(spark, documents):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (7, long), (8, long + " x"), (3, None)]
    found = sorted((r.doc_id, r.component_id, r.n_links) for r in J.join_alike(documents(rows)).collect())
    assert found == [(2, 2, 2), (3, 3, 0), (5, 2, 2), (5, 2, 2), (7, 7, 1), (8, 7, 1)]
    kept = J.keep_first(documents(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7] and kept.columns == documents(rows).columns
    assert J.join_alike(documents([])).count() == 0
    with pytest.raises(ValueError):
        J.join_alike(documents(rows), percent=30)


def test_ids_that_are_null_or_shared(spark, documents):
    text = {k: " ".join(f"{k}{j}" for j in range(40)) for k in "abcdef"}
    rows = [
        (None, text["a"]), (None, text["b"]), (None, text["b"] + " more"), (1, text["c"]), (1, text["d"]), (2, text["c"]),
        (3, text["a"] + " more"), (None, text["e"]), (None, text["e"]), (4, None), (4, ""), (None, None), (None, None),
    ]
    kept = sorted(((r.doc_id, r.text) for r in J.keep_first(documents(rows)).collect()), key=repr)
    b = [r for r in kept if (r[1] or "").startswith("b0")]
    assert len(b) == 1 and b[0] in rows
    assert kept == sorted([
        *b, (1, text["c"]), (1, text["d"]), (3, text["a"] + " more"), (None, text["e"]), (4, None), (4, ""), (None, None),
    ], key=repr)
    links = sorted(r.n_links for r in J.join_alike(documents(rows)).collect() if r.doc_id is None)
    assert links == [0, 0, 1, 1, 1, 1, 1]
