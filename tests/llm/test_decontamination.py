import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicspark.llm import decontamination as D


def brute_score(passage, segment):
    best, before = 0, [0] * (len(segment) + 1)
    for p in passage:
        row = [0]
        for k, s in enumerate(segment):
            row.append(max(0, before[k] + (2 if p == s else -1), before[k + 1] - 1, row[k] - 1))
        best, before = max(best, *row), row
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 20))
        assert D.align(a, b)[0] == brute_score(a.tolist(), b.tolist())


@pytest.fixture
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(rng.choice(["the", "of", "and", word(), word(), word(), word()]) for _ in range(n))
    items = [(k, text(30)) for k in range(6)] + [(6, text(400)), (7, "the of and"), (8, None), (9, "")]
    clean = [(k, text(200)) for k in range(20)]
    edited = items[1][1].split()
    edited[5], edited[17] = "changed", "also"
    del edited[23]
    leaks = [
        (100, f"{text(50)} {items[0][1]} {text(40)}", 0),
        (101, f"{text(20)} {' '.join(edited)} {text(300)}", 1),
        (102, items[2][1].upper().replace(" ", "!! "), 2),
        (103, f"{text(9)} {' '.join(items[6][1].split()[90:190])}", 6),
        (104, f"{items[3][1]}\n{text(400)}\n{items[3][1]}", 3),
    ]
    return items, clean, leaks


@pytest.mark.parametrize("size", [64, 1 << 22])
def test_copies_are_found_and_clean_documents_left(spark, documents, corpus, size, monkeypatch):
    monkeypatch.setattr(D, "FILTER_BYTES", size)  # a full filter lets nearly everything through
    items, clean, leaks = corpus
    given = documents(clean + [(i, t) for i, t, _ in leaks] + [(200, None), (201, ""), (102, leaks[2][1])])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_copies(given, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, item) for i, _, item in leaks}
    assert len([r for r in found if r.doc_id == 102]) == 2 and len([r for r in found if r.doc_id == 104]) == 2
    left = D.drop_copies(given, benchmark)
    assert left.columns == given.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([i for i, _ in clean] + [200, 201])


def hashed(text):
    return next(D._words(pa.array([text])))[2]


def brute(rows, items):
    """Every document against every segment, without seeds."""
    out = set()
    for item, text in items:
        own = hashed(text or "")
        if len(own) < D.LEAST_WORDS:
            continue
        for begin in range(0, max(1, len(own) - D.SEGMENT // 2), D.SEGMENT // 2):
            segment = own[begin : begin + D.SEGMENT]
            out |= {(doc, item) for doc, said in rows if D.align(hashed(said or ""), segment)[0] >= D.SIMILARITY * 2 * len(segment)}
    return out


def test_brute_force_over_all_documents(spark, documents, corpus):
    items, clean, leaks = corpus
    rows = clean + [(i, t) for i, t, _ in leaks]
    found = D.find_copies(documents(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(rows, items)


def test_copies_with_an_edit_every_three_words(spark, documents, corpus):
    items, clean, _ = corpus
    edited = []
    for k, (_, text) in enumerate(items[:6]):
        words = text.split()
        for place in range(k % 3, len(words), 4 if k % 2 else 3):
            words[place] = f"changed{place}"
        edited.append((300 + k, f"{clean[k][1]} {' '.join(words)} {clean[k + 1][1]}"))
    rows = clean + edited
    # In so few texts every word is a ten-thousandth of all.
    found = D.find_copies(documents(rows), spark.createDataFrame(items, "item_id long, text string"), chance=1e-3)
    expected = brute(rows, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    assert len(expected) >= 3


def test_scripts_without_spaces(spark, documents):
    rng = random.Random(8)
    text = lambda n: "".join(chr(rng.randint(0x4E00, 0x5200)) for _ in range(n))
    items = [(1, text(20) + "。" + text(20)), (2, text(6))]
    rows = [(k, text(100)) for k in range(10)] + [(50, text(30) + items[0][1] + text(30)), (51, text(9) + items[1][1])]
    found = D.find_copies(documents(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(rows, items) == {(50, 1)}


def test_items_of_one_id_and_clashing_names(spark, documents, corpus):
    items, clean, leaks = corpus
    same = [(9, items[0][1]), (9, items[0][1]), (9, items[1][1]), (None, items[2][1])]
    rows = clean + [(i, t) for i, t, _ in leaks]
    found = D.find_copies(documents(rows), spark.createDataFrame(same, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(100, 9), (101, 9), (102, None)}
    with pytest.raises(ValueError):
        D.find_copies(documents(rows), spark.createDataFrame(same, "doc_id long, text string"), item_id="doc_id")
    clashing = documents(rows).withColumns({"doc": F.lit(1), "said": F.lit(2), "own": F.lit("o"), "gone": F.lit("g")})
    left = D.drop_copies(clashing, spark.createDataFrame(same, "item_id long, text string"))
    assert left.columns == clashing.columns and left.count() == len(clean) + 2


def test_the_filter_holds_what_was_put_in(spark):
    rng = np.random.default_rng(6)
    inside, outside = (rng.integers(-(2**63), 2**63 - 1, 1000, dtype=np.int64) for _ in range(2))
    held = D.bloom(spark.createDataFrame([(int(x),) for x in inside], "h long"), 1 << 14)
    assert D.lets_through(held, inside.view(np.uint64)).all()
    assert D.lets_through(held, outside.view(np.uint64)).mean() < 0.02


def test_empty_tables(spark, documents, corpus):
    items, clean, _ = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert D.find_copies(documents([]), benchmark).count() == 0
    assert D.find_copies(documents(clean), benchmark.limit(0)).count() == 0
    assert D.drop_copies(documents(clean), benchmark.limit(0)).count() == len(clean)


def test_every_segment_keeps_seeds():
    for text in ("the of and the of and the of and the", "one two three four five six seven eight"):
        words = hashed(text)
        seeds, places = D.seeds_of(words, np.full(len(words), 500.0), 4, 500.0, 1000.0, 1e-4)
        assert 2 * len(seeds) >= len(words) - 3 and places.max() <= len(words) - 4
    rare, places = D.seeds_of(words, np.full(len(words), 1.0), 4, 500.0, 1e9, 1e-4)
    assert len(rare) == 7 + 6 + 5
