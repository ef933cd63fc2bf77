"""Quality rules: statistics of each text, base rules on them, and an isolation forest over them.

Defined results: a null or empty text has zeros everywhere and fails the base rules; repeated rows are judged
one by one; other columns are left alone; without labelled good rows no forest is grown and only base rules count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.tables import least_hashes, spare_name, written
from civicspark.llm.words import Words, chunks, find_words, mixed, repeated_in_document, span_hashes, sums

#: Labelled good rows that the forest is grown from, at most.
FIT_ROWS = 8192
TREES = 128
TREE_ROWS = 256
BINS = 1000

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!?\"'()[]{}-_=+/\\@^~`:;", dtype=np.uint8))
_LETTER = np.isin(np.arange(256), np.array([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "upper", "digits", "marks", "word_length", "dup_lines", "repeat_words", "letters"]
#: Least width of a feature's range when a split is drawn, so that a value that never varied can still be cut off.
_WIDTH = np.array([0.02, 0.05, 0.02, 0.02, 1.0, 0.05, 0.05, 0.05])


def _counts(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    n_words = np.diff(words.first)
    lead = (data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    word_chars = sums(total[words.ends] - total[words.starts], words.first)
    n_symbols = sums(_SYMBOLS[data], offsets)

    # Lines: cut after each newline and at the edges of documents.
    cuts = np.flatnonzero(data == 0x0A)
    owner = np.searchsorted(offsets, cuts, side="right") - 1
    documents = np.arange(len(offsets) - 1)
    starts = np.concatenate([offsets[:-1], cuts + 1])
    ends = np.concatenate([cuts, offsets[1:]])
    line_owner = np.sort(np.concatenate([documents, owner]), kind="stable")
    starts, ends = np.sort(starts, kind="stable"), np.sort(ends, kind="stable")
    with_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, line_owner = starts[with_word], ends[with_word], line_owner[with_word]
    _, again = repeated_in_document(span_hashes(data, starts, ends), line_owner)
    n_lines = np.bincount(line_owner, minlength=len(documents))
    n_dup_lines = np.bincount(line_owner[again], minlength=len(documents))

    # Three-word windows found twice or more in one text.
    hashes = words.hashes(lower=False)
    word_owner = np.repeat(documents, n_words)
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 2:
        same = word_owner[2:] == word_owner[:-2]
        window = mixed(mixed(mixed(hashes[:-2]) + hashes[1:-1]) + hashes[2:])[same]
        twice, _ = repeated_in_document(window, word_owner[:-2][same])
        at = np.flatnonzero(same)[twice]
        for k in range(3):
            covered[at + k] = True
    n_repeat = sums(covered, words.first)

    chars = np.maximum(word_chars, 1)
    n = np.maximum(n_words, 1)
    features = np.column_stack([
        n_symbols / n, sums(_UPPER[data], offsets) / chars, sums(_DIGIT[data], offsets) / chars,
        sums(_MARKS[data], offsets) / n, word_chars / n, n_dup_lines / np.maximum(n_lines, 1), n_repeat / n,
        sums(_LETTER[data] & lead, offsets) / chars,
    ])
    return np.column_stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat]).astype(np.int64), features


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (``COUNTS``) and features (``FEATURES``) of every text."""
    counts, features = [np.zeros((0, len(COUNTS)), dtype=np.int64)], [np.zeros((0, len(FEATURES)))]
    for _, _, data, offsets in chunks(column):
        made = _counts(data, offsets, find_words(data, offsets))
        counts.append(made[0])
        features.append(made[1])
    return np.concatenate(counts), np.concatenate(features)


def _usual_depth(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Trees as arrays: node ``i`` has children ``2i + 1`` and ``2i + 2``; a leaf has feature -1 and its path length in ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    usual: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; the shorter the paths, the higher."""
        depth = np.zeros(len(rows))
        for feature, cut in zip(self.feature, self.cut, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            inner = np.flatnonzero(feature[node] >= 0)
            while len(inner):
                at = node[inner]
                node[inner] = 2 * at + 1 + (rows[inner, feature[at]] >= cut[at])
                inner = inner[feature[node[inner]] >= 0]
            depth += cut[node]
        return np.exp2(-depth / len(self.feature) / self.usual)


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """Random splits; a split may also fall beside the rows' range, so that what lies outside is cut off early."""
    rng = np.random.default_rng(seed)
    tree_rows = min(tree_rows, len(rows))
    levels = max(1, int(np.ceil(np.log2(max(tree_rows, 2)))))
    nodes = 2 ** (levels + 1) - 1
    feature = np.full((trees, nodes), -1, dtype=np.int64)
    cut = np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: rows[rng.choice(len(rows), tree_rows, replace=False)]}
        for node in range(nodes):
            if node not in held:
                continue
            own, depth = held.pop(node), int(np.log2(node + 1))
            if depth == levels or len(own) <= 1:
                cut[t, node] = depth + _usual_depth(len(own))
                continue
            f = int(rng.integers(rows.shape[1]))
            low, high = own[:, f].min(), own[:, f].max()
            room = max(high - low, _WIDTH[f] if rows.shape[1] == len(_WIDTH) else 1e-9) / 2
            feature[t, node], cut[t, node] = f, rng.uniform(low - room, high + room)
            right = own[:, f] >= cut[t, node]
            held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    return Forest(feature, cut, float(max(_usual_depth(tree_rows), 1.0)))


def with_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, and ``features`` as an array; one row for each row of ``documents``."""

    def measured(batches):
        for batch in batches:
            counts, features = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[:, k]) for k in range(len(COUNTS))],
                 pa.array(list(features), type=pa.list_(pa.float64()))],
                names=[doc_id, *COUNTS, "features"],
            )

    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"
    return documents.select(doc_id, F.col(text).cast("string")).mapInArrow(measured, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Rules:
    forest: Forest | None
    threshold: float


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS,
    caution: float = 4.0,
) -> Rules:
    """Grow the forest on at most ``fit_rows`` rows labelled good, then set the threshold by all labelled rows.

    The threshold is the score from which on rejecting costs least, a good row lost counting ``caution`` times as
    much as a bad row kept, each as a share of its kind.
    """
    named = labels.groupBy(F.col("doc_id").alias(doc_id)).agg(F.max("quality").alias("_quality"))
    # Statistics first: they are short, the texts would be shuffled.
    labelled = written(with_statistics(documents, doc_id, text).filter(~base_failed()).join(named, doc_id), "rule-statistics")
    good = least_hashes(labelled.filter("_quality = 1"), doc_id, fit_rows).select("features").collect()
    if not good:
        return Rules(None, 2.0)
    forest = grow(np.array([r.features for r in good]))
    held = _scored(labelled, forest).groupBy(
        F.floor(F.col("score") * BINS).cast("int").alias("bin"), F.col("_quality").alias("quality")
    ).count().collect()
    found = np.zeros((2, BINS + 1))
    for r in held:
        if r.quality is not None:
            found[int(r.quality > 0), min(r.bin, BINS)] += r["count"]
    if not found[0].sum():
        return Rules(forest, 2.0)
    above = found[:, ::-1].cumsum(axis=1)[:, ::-1] / np.maximum(found.sum(axis=1), 1)[:, None]
    return Rules(forest, float(np.argmin(caution * above[1] - above[0])) / BINS)


def _scored(frame: DataFrame, forest: Forest) -> DataFrame:
    def scored(batches):
        for batch in batches:
            place = batch.schema.get_field_index("features")
            values = batch.column(place)
            rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(batch.num_columns) if k != place], pa.array(forest.scores(rows))],
                names=[*[n for n in batch.schema.names if n != "features"], "score"],
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "features"]
    return frame.mapInArrow(scored, ", ".join([*kept, "score double"]))


def judge(documents: DataFrame, rules: Rules, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score`` (null without a forest) and ``kept`` of every row."""
    found = with_statistics(documents, doc_id, text)
    found = _scored(found, rules.forest) if rules.forest else found.drop("features").withColumn("score", F.lit(None).cast("double"))
    return found.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.floor(F.col("score") * BINS) / BINS < rules.threshold, F.lit(True))
    )


def keep_good(documents: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns; judged in one pass without a join."""
    names, forest, threshold = documents.columns, rules.forest, rules.threshold

    def filtered(batches):
        for batch in batches:
            counts, features = statistics(batch.column(batch.num_columns - 1))
            kept = (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0])
            if forest:
                kept &= np.floor(forest.scores(features) * BINS) / BINS < threshold
            yield batch.filter(pa.array(kept)).select(range(batch.num_columns - 1))

    places = [F.col(f"`{n}`") for n in names]
    return documents.select(*places, F.col(text).cast("string").alias(spare_name(documents, "text"))).mapInArrow(filtered, documents.schema)
