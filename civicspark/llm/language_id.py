"""Language ID: each text is a mixture of languages, whose shares expectation-maximisation finds.

Every language has a likelihood of hashed byte trigrams of lower-cased letters, learned from all labelled texts.
The languages of a text are the set whose penalised likelihood is best; the sets tried are nested, in the order of
the shares in the mixture of all.

Defined results: ``und`` with score 0 for a null text, one without letters, or when nothing was learned; a text with
letters but without a trigram says nothing, so its shares are those of the learned texts' trigrams, the score is the greatest
of them, and that language is the only one found; repeated rows are judged one by one; equal languages come in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.words import chunks

BUCKETS = 1 << 13
#: The likelihoods are broadcast: this many languages take 64 MB. More are an error, never a silent cut.
MOST_LANGUAGES = 1024
STEPS = 25
SMOOTHING = 0.5
#: Trigrams overlap, so three of them count as one observation.
OVERLAP = 3.0
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams and their documents. Whatever is no letter is one kind of gap, and gaps have no trigram."""
    letters = _CLASS[data].astype(np.uint32)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    shown = np.ones(len(letters), dtype=bool)
    shown[1:] = (letters[1:] > 0) | (letters[:-1] > 0) | (owner[1:] != owner[:-1])
    letters, owner = letters[shown], owner[shown]
    if len(letters) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    gram = (letters[:-2] << np.uint32(16)) | (letters[1:-1] << np.uint32(8)) | letters[2:]
    whole = owner[:-2] == owner[2:]
    return ((gram[whole] * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64), owner[:-2][whole]


@dataclass
class Model:
    languages: list[str]
    likelihood: np.ndarray  # languages by buckets
    learned: np.ndarray  # share of each language among the trigrams learned
    penalty: float = 4.0

    def mixture(self, buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chosen languages (places, largest share first) and their shares."""
        if not len(buckets):
            best = int(np.argmax(self.learned))
            return np.array([best]), self.learned[[best]]
        p, weight = self.likelihood[:, buckets], counts / OVERLAP
        single = np.log(p) @ weight
        best = [int(np.argmax(single))]
        if len(self.languages) == 1:
            return np.array(best), np.ones(1)
        shares, _ = _shares(p, weight)
        order = np.argsort(-shares, kind="stable")
        found, value = (np.array(best), np.ones(1)), single[best[0]]
        cost = self.penalty * np.log(max(weight.sum(), 2.0))
        for k in range(2, len(order) + 1):
            part = np.sort(order[:k])
            own, total = _shares(p[part], weight)
            if total - (k - 1) * cost <= value:
                break
            by = np.argsort(-own, kind="stable")
            found, value = (part[by], own[by]), total - (k - 1) * cost
        return found


def _shares(p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the shares; also the log likelihood they reach."""
    shares, n = np.full(len(p), 1 / len(p)), max(weight.sum(), 1e-9)
    for _ in range(STEPS):
        mixed = shares @ p
        after = shares * (p @ (weight / mixed)) / n
        moved, shares = np.abs(after - shares).max(), after
        if moved < 1e-3:
            break
    return shares, float(weight @ np.log(np.maximum(shares @ p, 1e-300)))


def fit(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Likelihoods from all ``documents`` whose ``lang`` is not null."""

    def counted(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            codes = batch.column(1).dictionary_encode()
            place, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            for low, high, data, offsets in chunks(batch.column(0)):
                bucket, owner = trigrams(data, offsets)
                for k in np.unique(place[low:high]):
                    own = bucket[place[low:high][owner] == k]
                    total[names[k]] = total.get(names[k], 0) + np.bincount(own, minlength=BUCKETS)
        for name, counts in total.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(full), type=pa.string()), pa.array(full), pa.array(counts[full].astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    labelled = documents.filter(F.col(lang).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string").alias("lang"))
    found = (
        labelled.mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    # At most languages x buckets rows, whatever the number of documents.
    known = sorted(r[0] for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(known), BUCKETS))
    rows = found.toPandas()
    place = {name: k for k, name in enumerate(known)}
    counts[rows["lang"].map(place).to_numpy(dtype=np.int64), rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    learned = counts.sum(axis=1)
    learned = learned / learned.sum() if learned.sum() else np.full(len(known), 1 / max(len(known), 1))
    counts += SMOOTHING
    return Model(known, counts / counts.sum(axis=1, keepdims=True), learned)


def identify(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, its share as ``score``, and ``languages``: name and share of each language found."""

    def judged(batches):
        for batch in batches:
            names, scores, all_names, all_shares = [], [], [], []
            has_letter = batch.column(2).to_pylist()
            for low, high, data, offsets in chunks(batch.column(1)):
                bucket, owner = trigrams(data, offsets)
                key, counts = np.unique(owner * BUCKETS + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(high - low + 1) * BUCKETS)
                for k in range(high - low):
                    if not has_letter[low + k] or not model.languages:
                        found, shares = [], []
                    else:
                        own = slice(cut[k], cut[k + 1])
                        places, shares = model.mixture(key[own] % BUCKETS, counts[own].astype(float))
                        found = [model.languages[i] for i in places]
                    names.append(found[0] if found else "und")
                    scores.append(min(1.0, float(shares[0])) if found else 0.0)
                    all_names.append(found)
                    all_shares.append(list(map(float, shares)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64()),
                 pa.array(all_names, type=pa.list_(pa.string())), pa.array(all_shares, type=pa.list_(pa.float64()))],
                names=[doc_id, "lang_pred", "score", "languages", "shares"],
            )

    kind = documents.schema[doc_id].dataType.simpleString()
    letters = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    return documents.select(doc_id, F.col(text).cast("string"), letters).mapInArrow(
        judged, f"`{doc_id}` {kind}, lang_pred string, score double, languages array<string>, shares array<double>"
    )
