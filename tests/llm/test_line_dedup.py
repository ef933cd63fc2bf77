import random

import pytest

from civicspark.llm import line_dedup as L


def line(name, n=12):
    return " ".join(f"{name}{k}" for k in range(n))


def cleaned(frame, min_words=20):
    found = L.dedup_lines(frame, min_words)
    return found, {r.doc_id: (r.text, list(r.removed_lines)) for r in found.collect()}


def test_runs_of_lines(spark, documents):
    a, b, c, d = (line(x) for x in "abcd")
    long = line("L", 60)
    rows = [
        (1, "\n".join([a, b, c])), (2, "\n".join([d, a, b, "", line("e")])), (3, "\n".join([line("f"), a])), (4, f"{line('g')}\n{long}"),
        (5, f"{long}\n{line('h')}"), (6, "\n".join([line("i"), line("j"), line("k"), line("i"), line("j")])), (7, None), (8, ""), (9, "\n \n"),
    ]
    frame, found = cleaned(documents(rows))
    assert sorted(frame.columns) == sorted(documents(rows).columns)
    assert found[1] == (rows[0][1], [])
    assert found[2] == ("\n".join([d, "", line("e")]), [1, 2])  # a and b together reach 20 words
    assert found[3] == (rows[2][1], [])  # a alone does not
    assert found[4][1] == [] and found[5] == (line("h"), [0])
    assert found[6] == ("\n".join([line("i"), line("j"), line("k")]), [3, 4])
    assert found[7] == (None, []) and found[8] == ("", []) and found[9] == ("\n \n", [])


def test_stretches_of_one_line_and_repeated_rows(spark, documents):
    same = "\n".join(["one two three"] * 3000)
    rows = [(1, same), (2, "x " * 30 + "\n" + same), (3, line("q", 40)), (3, line("q", 40)), (None, line("q", 40))]
    _, found = cleaned(documents(rows))
    assert found[1] == ("one two three", list(range(1, 3000)))
    assert found[2][0] == "x " * 30
    assert found[None] == (line("q", 40), []) and found[3] == ("", [0])


@pytest.mark.parametrize("seed", range(3))
def test_properties_on_random_texts(spark, documents, seed):
    """What is deleted was there before; every passage of enough words that came before in one piece is gone."""
    rng = random.Random(seed)
    stock = [line(f"s{k}_", rng.randint(3, 30)) for k in range(12)]
    rows = []
    for k in range(30):
        own = [line(f"d{k}_{j}_", rng.randint(2, 9)) for j in range(rng.randint(1, 6))]
        at = rng.randrange(len(stock))
        cut = rng.randint(0, len(own))
        rows.append((k, "\n".join(own[:cut] + stock[at : at + rng.randint(1, 4)] + own[cut:])))
    _, found = cleaned(documents(rows))
    before = set()
    for k, text in rows:
        lines = text.split("\n")
        assert all(lines[p] in before for p in found[k][1])
        before |= set(lines)
    first = {}
    for k, text in rows:
        lines = text.split("\n")
        for p, said in enumerate(lines):
            if len(said.split()) >= 20:
                assert (p in found[k][1]) == (said in first)
                first.setdefault(said, k)


def brute(rows, min_words):
    """Lines of every run of enough words that begins at an earlier place too."""
    seen, out = {}, {}
    texts = {i: [(p, said) for p, said in enumerate(text.split("\n")) if said.split()] for i, text in rows}
    for i, lines in sorted(texts.items()):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(said.split()) for _, said in lines[a:b]) >= min_words:
                    seen.setdefault(tuple(said for _, said in lines[a:b]), (i, a))
    for i, lines in texts.items():
        out[i] = sorted({
            p for a in range(len(lines)) for b in range(a + 1, len(lines) + 1)
            if seen.get(tuple(said for _, said in lines[a:b]), (i, a)) != (i, a) for p, _ in lines[a:b]
        })
    return out


def test_a_passage_whose_lines_came_before_in_another_order(spark, documents):
    passage = [line(f"p{k}_", 6) for k in range(12)]
    shuffled = random.Random(601).sample(passage, 12)
    rows = [(1, "\n".join(shuffled)), (2, "\n".join(passage)), (3, "\n".join([line("own"), *passage, line("end")]))]
    _, found = cleaned(documents(rows))
    assert found[1][1] == [] and found[2] == (rows[1][1], [])
    assert found[3] == ("\n".join([line("own"), line("end")]), list(range(1, 13)))


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    stock = [line(f"s{k}_", n) for k, n in enumerate([1, 2, 3, 5, 6, 6, 7, 9, 10, 19, 20, 30])] + [""]
    passages = [[rng.choice(stock) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    rows = []
    for k in range(30):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [rng.choice(stock), line(f"d{k}_", 2)] for _ in range(rng.randint(1, 5))]
        rows.append((k, "\n".join(said for part in parts for said in part)))
    _, found = cleaned(documents(rows))
    assert {k: f[1] for k, f in found.items()} == brute(rows, 20)


def test_empty_table_and_no_python(spark, documents):
    frame = L.dedup_lines(documents([]))
    assert frame.count() == 0
    assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()


def test_very_many_lines_in_one_text(spark, documents):
    same = "\n".join(["one two three"] * 100_000)
    other = "\n".join(f"line number {k % 35_000} of many" for k in range(70_000))
    _, found = cleaned(documents([(1, same), (2, other)]))
    # Short messages: a comparison of the texts would be worked out for minutes.
    good = found[1] == ("one two three", list(range(1, 100_000)))
    assert good
    good = found[2] == ("\n".join(other.split("\n")[:35_000]), list(range(35_000, 70_000)))
    assert good


def test_fingerprints_are_least_lines_of_windows(spark, documents):
    rng = random.Random(5)
    rows = [(k, "\n".join(line(f"d{k}_{j}_", rng.randint(1, 15)) for j in range(rng.randint(1, 12)))) for k in range(10)]
    lines = L.worded_lines(documents(rows), "doc_id", "text")
    known = {(r.doc.id, r.line): r.h for r in lines.collect()}
    found = {(r.doc.id, tuple(r.lines), r.lines[r.at]): r.print for r in L.fingerprints(lines, 20).collect()}
    windows = set()
    for i, text in rows:
        words = [len(x.split()) for x in text.split("\n")]
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                if sum(words[a:b]) >= 20 and (sum(words[a : b - 1]) < 20 or sum(words[a + 1 : b]) < 20):
                    windows.add((i, tuple(range(a, b))))
    assert {(i, own) for i, own, _ in found} == windows
    for (i, own, at), least in found.items():
        assert least == min(known[i, p] for p in own) == known[i, at]
