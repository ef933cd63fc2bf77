import hashlib
import random

import pytest
import sentencepiece

from civicspark.llm import sentencepiece_codec as S

MODEL = S.tokenizer_path("piece_bpe_32k.model")
LETTERS = " \n\t\r▁aAbeéñ一あ😀\x00​.,<>s/01�"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(1)
    odd = ["", " ", "▁", "  a", "\n", " \n", "<s>", "</s>", "<0x0A>", "<unk>", " " * 100, "▁" * 33 + "x", "a" * 3000, "\n\n\n", "The cat sat."]
    return odd + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(800)]


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))


def test_ids_and_texts_equal_the_library(library):
    codec = S.Codec(MODEL)
    for text in texts():
        ids = codec.encode(text)
        assert ids == library.encode(text, add_eos=True), repr(text)
        assert codec.decode(ids) == library.decode(ids), repr(text)
    assert codec.digests(texts()) == [expected(library, t) for t in texts()]
    assert codec.digests([]) == []


def test_arrays_equal_the_heap():
    codec, rng = S.Codec(MODEL), random.Random(2)
    parts = ["▁" * rng.randint(0, 3) + "".join(rng.choice("aeinrstxé") for _ in range(rng.randint(1, 70))) for _ in range(600)]
    assert codec.encode_parts(parts) == [codec.encode_part(p) for p in parts]


def test_few_remembered_parts(library, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 40)
    codec = S.Codec(MODEL)
    for low in range(0, 200, 20):
        some = texts()[low : low + 20]
        assert codec.digests(some) == [expected(library, t) for t in some]
    assert len(codec.known) <= 40


def test_bytes_that_are_no_text(library):
    codec = S.Codec(MODEL)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([*range(3, 259), 300, 29871, 2]) for _ in range(rng.randint(1, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_a_difference_stops_the_job():
    codec = S.Codec(MODEL)
    codec.encode_part = lambda part: [5]
    with pytest.raises(ValueError):
        codec.digests(["ÿ" * 80])


def test_documents(spark, documents, library):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (4, "long text\n" * 30_000), (5, "one")]
    found = S.encode_documents(documents(rows), "piece_bpe_32k.model").collect()
    by_id = {i: expected(library, t) for i, t in rows}
    assert len(found) == len(rows)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == by_id[r.doc_id] for r in found)
    assert S.encode_documents(documents([]), MODEL).count() == 0


def test_parts_are_remembered_beyond_150_000(monkeypatch):
    own = S.Codec(S.tokenizer_path("piece_bpe_32k.model"))
    texts = [" ".join(f"w{k}" for k in range(low, low + 8000)) for low in range(0, 160_000, 8000)]
    first = [row for low in range(0, len(texts), 4) for row in own.digests(texts[low : low + 4])]
    monkeypatch.setattr(own, "learn", lambda parts: pytest.fail(f"{len(parts)} parts encoded again"))
    assert own.digests(texts) == first
