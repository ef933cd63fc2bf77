import numpy as np
import pyarrow as pa

from civicspark.llm.words import chunks, find_words, shingles

from .conftest import words_of

TEXTS = [None, "", "  ", "One  two\tTHREE\nfour", "é\x0bü", "x" * 5000, "a b", " b\r\nC ", "b c"]


def _all(texts, most=64):
    for low, high, data, offsets in chunks(pa.array(texts, type=pa.string()), most):
        yield low, high, find_words(data, offsets)


def test_words_and_hashes():
    seen = {}
    for low, high, words in _all(TEXTS):
        hashes = words.hashes()
        for k in range(low, high):
            own = range(words.first[k - low], words.first[k - low + 1])
            assert [bytes(words.data[words.starts[w] : words.ends[w]]).decode() for w in own] == words_of(TEXTS[k], lower=False)
            for w, text in zip(own, words_of(TEXTS[k]), strict=True):
                assert seen.setdefault(text, hashes[w]) == hashes[w]
    assert len(set(seen.values())) == len(seen)


def test_shingles_stay_within_documents():
    for n in (1, 3, 4):
        made = {}
        for low, high, words in _all(TEXTS, 1 << 20):
            values, begin = shingles(words.hashes(), words.first, n)
            for k in range(low, high):
                text = words_of(TEXTS[k])
                expected = [tuple(text[i : i + n]) for i in range(len(text) - n + 1)] if len(text) >= n else [tuple(text)] if text else []
                own = values[begin[k - low] : begin[k - low + 1]]
                assert len(own) == len(expected)
                for gram, value in zip(expected, own, strict=True):
                    assert made.setdefault(gram, value) == value
        assert len(set(made.values())) == len(made)


def test_sliced_arrays():
    column = pa.array(["aa", "bb cc", "dd"]).slice(1)
    (_, _, data, offsets), = chunks(column)
    assert bytes(data) == b"bb ccdd" and offsets.tolist() == [0, 5, 7]
    assert list(chunks(pa.array([], type=pa.string()))) == []
    assert isinstance(offsets, np.ndarray)
