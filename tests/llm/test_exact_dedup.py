import hashlib
import random
import re

import numpy as np
import pytest

from civicspark.llm import exact_dedup as X


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    """(id, keep id, size, digest) of each row; the ids of winners, one for each group."""
    of = {}
    for i, t in rows:
        of.setdefault(normal(t), []).append((-len(t or ""), i is None, i or 0, i))
    best = {k: min(v)[3] for k, v in of.items()}
    out = [(i, best[normal(t)], len(of[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows]
    return sorted(out, key=repr), len(of)


def found(documents, old, new):
    rows = X.dedup(X.build_history(documents(old)), documents(new)).collect()
    table = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr)
    return table, rows


@pytest.mark.parametrize("count", [0, 1, 2, 50, 20_000])
def test_the_hash_is_minimal_and_perfect(count):
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(count)]
    sizes, bits, slots = X.build(X.words(digests))
    assert sorted(slots.tolist()) == list(range(count)) and bits.sum() == count and sum(sizes) <= 4 * count + 8
    assert (X.look_up(X.words(digests), sizes, bits) == slots).all()
    others = X.words([hashlib.sha256(f"x{k}".encode()).digest() for k in range(100)])
    assert (X.look_up(others, sizes, bits) < max(count, 1)).all()


def test_digests_alike_in_part_are_told_apart():
    keys = np.zeros((4, 4), dtype=np.uint64)
    keys[1, 3], keys[2, 0], keys[3, 1] = 1, 1, 1
    sizes, bits, slots = X.build(keys)
    assert sorted(slots.tolist()) == [0, 1, 2, 3] and (X.look_up(keys, sizes, bits) == slots).all()


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("segment", [4, 1 << 14])
def test_equals_brute_force(documents, seed, segment, monkeypatch):
    monkeypatch.setattr(X, "SEGMENT_KEYS", segment)
    rng = random.Random(seed)
    stock = ["a b c", "abc", "a\tb c ", "x", " x", "", None, " \n", "Ä日 ", "Ä日", " x", "long " * 500]
    rows = [(rng.choice([k, k, None, 5]), rng.choice([*stock, f"own {k}"])) for k in range(80)]
    cut = rng.randint(0, 80)
    table, found_rows = found(documents, rows[:cut], rows[cut:])
    expected, n_groups = brute(rows)
    assert table == expected
    kept = [r for r in found_rows if r.kept]
    assert len(kept) == n_groups and all(r.doc_id == r.keep_id for r in kept)
    assert len({r.text_sha256 for r in kept}) == n_groups
    before = {normal(t) for _, t in rows[:cut]}
    repeats = sum(normal(t) in before for _, t in rows[cut:])
    assert sum(r.repeat for r in found_rows) == repeats and sum(r.historical for r in found_rows) == cut


def test_new_winner_of_an_old_text(documents):
    table, rows = found(documents, [(1, "ab"), (2, "q")], [(7, "a  b"), (3, "a b "), (9, "ab")])
    assert {r[1] for r in table if r[2] == 4} == {3}
    assert [(r.doc_id, r.repeat) for r in rows if r.kept and r.group_size == 4] == [(3, True)]


def test_empty_tables(documents):
    for old, new in (([], []), ([(1, "a")], []), ([], [(1, "a"), (2, "a ")])):
        assert found(documents, old, new)[0] == brute(old + new)[0]


def test_a_hot_text(documents):
    rows = [(k, "same text") for k in range(3000)] + [(k, f"t{k}") for k in range(3000, 3300)]
    random.Random(1).shuffle(rows)
    table, found_rows = found(documents, rows[:1500], rows[1500:])
    assert table == brute(rows)[0] and sum(r.kept for r in found_rows) == 301
