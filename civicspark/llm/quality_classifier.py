"""Quality classifier: nearest labelled documents in a latent-semantic space vote on each document.

A text becomes counts of hashed byte trigrams and a few marks of repetition; a truncated singular value
decomposition of the labelled sample turns them into short vectors. All documents are compared with all labelled
vectors, block by block, so the nearest are exact.

Defined results: a null or empty text has no direction and gets the share of good labels; without labelled rows the
score is 0.5; repeated rows are scored one by one; rows of one id with several labels count with the highest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.tables import least_hashes, written
from civicspark.llm.words import chunks, find_words, repeated_in_document

#: Labelled documents in the model, at most; their vectors are all that is broadcast (4096 x 32 floats).
FIT_ROWS = 4096
BUCKETS = 1024
MARKS = 2
RANK = 32
NEIGHBOURS = 31
SHARPNESS = 8
#: Documents compared with the labelled vectors at once.
BLOCK = 256


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents by terms: hashed byte trigrams, then words met before in the text and words equal to the one before."""
    n, width = len(offsets) - 1, BUCKETS + MARKS
    out = np.zeros((n, width), dtype=np.float32)
    sizes = np.diff(offsets)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        gram = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
        bucket = ((gram * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)
        owner = np.repeat(np.arange(n), sizes)
        whole = owner[:-2] == owner[2:]
        out += np.bincount(owner[:-2][whole] * width + bucket[whole], minlength=n * width).reshape(n, width)
    words = find_words(data, offsets)
    hashes = words.hashes()
    word_owner = np.repeat(np.arange(n), np.diff(words.first))
    _, again = repeated_in_document(hashes, word_owner)
    out[:, BUCKETS] = np.bincount(word_owner[again], minlength=n)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
        out[:, BUCKETS + 1] = np.bincount(word_owner[1:][same], minlength=n)
    return out


def _blocks(column: pa.Array):
    for low, high, data, offsets in chunks(column):
        for k in range(0, high - low, BLOCK):
            part = offsets[k : k + BLOCK + 1]
            yield low + k, term_counts(data[part[0] : part[-1]], part - part[0])


def _directions(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Vectors of length 1; zero for a text without terms."""
        shares = np.sqrt(counts / np.maximum(counts[:, :BUCKETS].sum(axis=1, keepdims=True), 1))
        return _directions((shares * self.weight) @ self.axes).astype(np.float32)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of good labels among the nearest labelled documents, each weighted by its similarity."""
        if not len(self.labels):
            return np.full(len(counts), self.share)
        cosine = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** SHARPNESS
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), self.share).clip(0, 1)


def fit_model(counts: np.ndarray, labels: np.ndarray, seed: int = 3) -> Model:
    if not len(labels):
        return Model(np.zeros(BUCKETS + MARKS), np.zeros((BUCKETS + MARKS, RANK)), np.zeros((0, RANK)), labels, 0.5)
    shares = np.sqrt(counts / np.maximum(counts[:, :BUCKETS].sum(axis=1, keepdims=True), 1))
    weight = np.log1p(len(counts) / (1 + (counts > 0).sum(axis=0)))
    rows = shares * weight
    # Randomised range finder with power steps: the leading right singular vectors.
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rows.T @ rng.standard_normal((len(rows), 2 * RANK)))[0]
    for _ in range(4):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    axes = basis @ right[:RANK].T
    model = Model(weight, axes, np.zeros((0, axes.shape[1])), labels.astype(float), float(labels.mean()))
    model.vectors = model.latent(counts)
    return model


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Model of at most ``fit_rows`` of the ``documents`` that ``labels`` (doc_id, quality) covers."""
    named = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").alias(doc_id)).agg(F.max("quality").alias("_quality"))

    def counted(batches):
        for batch in batches:
            for low, counts in _blocks(batch.column(1)):
                part = batch.slice(low, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(list(counts), type=pa.list_(pa.float32()))],
                    names=[doc_id, "quality", "counts"],
                )

    # Ids are chosen first, so that only the texts of the sample move; of texts that repeat an id, the least counts.
    ids = least_hashes(written(documents.select(doc_id).distinct().join(named, doc_id), "labelled-ids"), doc_id, fit_rows)
    chosen = documents.select(doc_id, F.col(text).cast("string").alias("_text")).join(F.broadcast(ids), doc_id)
    chosen = chosen.groupBy(doc_id).agg(F.min("_text").alias("_text"), F.first("_quality").alias("_quality"))
    kind = documents.schema[doc_id].dataType.simpleString()
    rows = chosen.mapInArrow(counted, f"`{doc_id}` {kind}, quality int, counts array<float>").select("quality", "counts").toPandas()
    counts = np.vstack(rows["counts"].to_numpy()) if len(rows) else np.zeros((0, BUCKETS + MARKS))
    return fit_model(counts, (rows["quality"].to_numpy() > 0).astype(float))


def classify(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""

    def scored(batches):
        for batch in batches:
            scores = [model.scores(counts) for _, counts in _blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate([np.zeros(0), *scores]))], names=[doc_id, "score"]
            )

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, F.col(text).cast("string")).mapInArrow(scored, f"`{doc_id}` {kind}, score double")
