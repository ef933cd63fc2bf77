"""LM scoring: prediction by partial matching over bytes, with pretrained counts, beside a word unigram base.

The model is a trie of contexts of up to three bytes. The probability of a byte is its count in the longest context
known, where escape gets as many counts as there are different bytes (method C); after an escape the shorter context
counts without the bytes of the longer one (symbol exclusion). Since the counts are fixed, everything that an escape changes depends
on the context alone and is worked out once. A text ends with an end symbol; before it stand start symbols.

Counts come from all training texts. The three-byte level goes to the executors in blocks of at most ``MOST_GRAMS``
entries, and every block adds its part of each code length; the texts are numbered and written once before, and all blocks
are scored from that table by the stored number. Word counts: those with at least 1 / ``FREQUENT`` of all words, so
at most ``FREQUENT`` of them, are sent along; the rest are joined by a shuffle.

Defined results: a null text is empty and has one token, its end; repeated rows are scored one by one; without training texts every
symbol has the same probability and the base score is 0; rows of a null id are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.tables import written
from civicspark.llm.words import chunks, find_words

#: Symbols: bytes, and 256 for the start and the end of a text.
SYMBOLS = 257
EDGE = 256
ORDER = 3
MOST_GRAMS = 1 << 22
FREQUENT = 1 << 21
#: Distinct keys that a task gathers before it sums them up.
GATHERED = 1 << 20
#: Stands for the end of a text among word hashes.
END = 0x5EED_E0D


def edged(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with ``ORDER`` edges before each text and after the last; and the place of each text's first byte."""
    n = len(offsets) - 1
    out = np.full(len(data) + ORDER * (n + 1), EDGE, dtype=np.int64)
    first = offsets[:-1] + ORDER * np.arange(1, n + 1)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, n + 1), np.diff(offsets))] = data
    return out, first


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every symbol, ends included, itself and the three before as one number; and where each text's begin."""
    symbols, first = edged(data, offsets)
    sizes = np.diff(offsets) + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes) + np.repeat(first, sizes)
    key = symbols[at - ORDER]
    for k in range(ORDER - 1, -1, -1):
        key = key * SYMBOLS + symbols[at - k]
    return key, begin


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


class Lookup:
    """Values by key: an open hash table, probed for all keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits)
        at, self.probes = self._home(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            set_now = free[one]
            self.keys[at[set_now]], self.values[at[set_now]] = keys[set_now], values[set_now]
            left = np.ones(len(keys), dtype=bool)
            left[set_now] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """nan where a key is missing."""
        out = np.full(len(keys), np.nan)
        at, rest = self._home(keys), np.arange(len(keys))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            go = ~hit & (held != -1)
            rest, at = rest[go], (at[go] + 1) & ((1 << self.bits) - 1)
            if not len(rest):
                break
        return out


@dataclass
class Level:
    """One context length: entries (context and symbol), and contexts with their totals."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    #: Of each context: counts in the context one shorter of the symbols seen here.
    below: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray) -> Level:
        contexts, first = np.unique(keys // SYMBOLS, return_index=True)
        total = np.add.reduceat(counts, first) if len(keys) else counts
        return Level(keys, counts, contexts, total, np.diff(np.append(first, len(keys))), np.zeros(len(contexts)))

    def place(self, contexts: np.ndarray) -> np.ndarray:
        """Place of each context, -1 if unknown."""
        at = np.minimum(np.searchsorted(self.contexts, contexts), max(len(self.contexts) - 1, 0))
        return np.where(self.contexts[at] == contexts, at, -1) if len(self.contexts) else np.full(len(contexts), -1)

    def count(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, self.counts[at], 0) if len(self.keys) else np.zeros(len(keys), dtype=np.int64)


class Model:
    """Levels of context lengths 0 to ``ORDER``; the highest may hold the contexts of one block only."""

    def __init__(self, lower: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray, block: int = 0, blocks: int = 1):
        """``lower``: all entries of two-byte contexts; ``keys``, ``counts``: the block's of three-byte contexts."""
        self.block, self.blocks = block, blocks
        self.levels = [Level.of(*lower), Level.of(keys, counts)]
        for length in range(ORDER - 1, 0, -1):
            self.levels.insert(0, Level.of(*summed(self.levels[0].keys % SYMBOLS**length, self.levels[0].counts)))
        for length in range(1, ORDER + 1):
            level, shorter = self.levels[length], self.levels[length - 1]
            held = shorter.count(level.keys % SYMBOLS**length)
            first = np.searchsorted(level.keys, level.contexts * SYMBOLS)
            level.below = np.add.reduceat(held, first) if len(first) else np.zeros(0)
        top = self.levels[ORDER]
        place = top.place(top.keys // SYMBOLS)
        self.direct = Lookup(top.keys, np.log10(top.counts / (top.total + top.kinds)[place]) if len(place) else np.zeros(0))

    def mine(self, keys: np.ndarray) -> np.ndarray:
        return block_of(keys, self.blocks) == self.block

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its context."""
        out = self.direct.get(keys)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            unseen, which = np.unique(keys[rest], return_inverse=True)
            out[rest] = self._escaped(unseen)[which]
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        open_rows = np.arange(len(keys))
        less, fewer = np.zeros(len(keys)), np.zeros(len(keys))  # excluded counts and kinds
        for length in range(ORDER, -1, -1):
            level = self.levels[length]
            own = keys[open_rows] % SYMBOLS ** (length + 1)
            place = level.place(own // SYMBOLS)
            known = place >= 0
            total, kinds = level.total[place] - less if len(level.total) else 0 * less, level.kinds[place] - fewer if len(level.kinds) else 0 * fewer
            total, kinds = np.where(known, total, 0.0), np.where(known, kinds, 0.0)
            count = level.count(own)
            seen = known & (count > 0)
            size = total + kinds
            out[open_rows[seen]] += np.log10(count[seen] / size[seen])
            escaped = known & ~seen & (kinds > 0)
            out[open_rows[escaped]] += np.log10(kinds[escaped] / size[escaped])
            less = np.where(known, level.below[place] if len(level.below) else 0, 0.0)[~seen]
            fewer = np.where(known, level.kinds[place] if len(level.kinds) else 0, 0)[~seen]
            open_rows = open_rows[~seen]
        out[open_rows] -= np.log10(SYMBOLS - fewer)
        return out


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Block of a three-byte context: all its entries are in one."""
    return (keys // SYMBOLS) % blocks


def _count(documents: DataFrame, text: str) -> DataFrame:
    """``kind`` (0 words, 1 grams), ``key`` and ``n`` over all texts."""

    def counted(batches):
        held = {0: [], 1: []}
        size = {0: 0, 1: 0}
        ends = 0

        def pack(kind):
            keys, counts = summed(np.concatenate([h[0] for h in held[kind]]), np.concatenate([h[1] for h in held[kind]]))
            held[kind], size[kind] = [(keys, counts)], 0
            return keys, counts

        def out(kind):
            keys, counts = pack(kind)
            held[kind] = []
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys), pa.array(counts)], names=["kind", "key", "n"]
            )

        for batch in batches:
            for low, high, data, offsets in chunks(batch.column(0)):
                ends += high - low
                for kind, keys in ((0, find_words(data, offsets).hashes().view(np.int64)), (1, grams(data, offsets)[0])):
                    held[kind].append(summed(keys, np.ones(len(keys), dtype=np.int64)))
                    size[kind] += len(held[kind][-1][0])
                    if size[kind] > GATHERED:
                        pack(kind)
                    if held[kind] and len(held[kind][0][0]) > 4 * GATHERED:  # too much to keep: the shuffle sums it up
                        yield out(kind)
        if ends:
            held[0].append((np.array([END]), np.array([ends])))
        for kind in (0, 1):
            if held[kind]:
                yield out(kind)

    return documents.select(F.col(text).cast("string")).mapInArrow(counted, "kind int, key long, n long").groupBy("kind", "key").agg(
        F.sum("n").alias("n")
    )


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    frame = rows.select("key", "n").toPandas()
    keys, counts = frame["key"].to_numpy(dtype=np.int64), frame["n"].to_numpy(dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def score_texts(documents: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text", smoothing: float = 0.1) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``documents``."""
    counts = written(_count(training, text), "counts")
    words = counts.filter("kind = 0").select("key", "n")
    # Of three-byte contexts, blocks by context; the shorter ones, at most 257**3 entries, are needed with each.
    entries = counts.filter("kind = 1").select("key", "n")
    lower = _collected(entries.groupBy((F.col("key") % SYMBOLS**ORDER).alias("key")).agg(F.sum("n").alias("n")))
    blocks = max(1, -(-entries.count() // MOST_GRAMS))

    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    frequent_keys, frequent_counts = _collected(words.filter(F.col("n") >= max(1.0, total.n / FREQUENT)))
    frequent = Lookup(frequent_keys, np.log10(frequent_counts + smoothing))
    unknown = float(np.log10(smoothing))
    each = float(np.log10(total.n + smoothing * (total.v + 1)))

    def scored(model: Model, with_words: bool):
        def score(batches):
            for batch in batches:
                tokens, known, base, rest, rest_sizes, codes = [], [], [], [np.zeros(0, dtype=np.int64)], [], []
                for low, high, data, offsets in chunks(batch.column(2)):
                    keys, begin = grams(data, offsets)
                    if model.blocks == 1:
                        logs = model.logs(keys)
                    else:
                        logs, own = np.zeros(len(keys)), model.mine(keys)
                        logs[own] = model.logs(keys[own])
                    codes.append(np.add.reduceat(logs, begin[:-1]))
                    if not with_words:
                        continue
                    found = find_words(data, offsets)
                    hashes = np.insert(found.hashes().view(np.int64), found.first[1:], END)
                    first = found.first + np.arange(high - low + 1)
                    value = frequent.get(hashes)
                    rare = np.isnan(value)
                    size = np.add.reduceat(rare.astype(np.int64), first[:-1])
                    tokens.append(np.diff(first))
                    known.append(np.diff(first) - size)
                    base.append(np.add.reduceat(np.where(rare, 0.0, value), first[:-1]))
                    rest.append(hashes[rare])
                    rest_sizes.append(size)
                if not batch.num_rows:
                    continue
                if with_words:
                    cut = np.concatenate([[0], np.cumsum(np.concatenate(rest_sizes))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(np.concatenate(codes)), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(known)),
                         pa.array(np.concatenate(base)), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(rest)))],
                        names=["row", "doc", "code", "tokens", "known", "base", "rest"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(codes))], names=["row", "code"])

        return score

    kind = documents.schema[doc_id].dataType.simpleString()
    given = written(
        documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")),
        "numbered",
    )
    rows = None
    more = []
    for block in range(blocks):
        own = entries.filter(F.pmod(F.floor(F.col("key") / SYMBOLS), F.lit(blocks)) == block) if blocks > 1 else entries
        model = Model(lower, *_collected(own), block, blocks)
        if block == 0:
            rows = written(
                given.mapInArrow(scored(model, True), f"row long, doc {kind}, code double, tokens long, known long, base double, rest array<long>"),
                "scores",
            )
        else:
            more.append(given.mapInArrow(scored(model, False), "row long, code double"))

    # The rarer words: joined with their counts, then summed up for each text.
    rare = rows.select("row", F.explode("rest").alias("key")).join(words, "key").groupBy("row").agg(
        F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + smoothing) - F.lit(unknown)).alias("more_base")
    )
    out = rows.withColumn("rest", F.size("rest")).join(rare, "row", "left")
    for part in more:
        out = out.join(part.withColumnRenamed("code", "_code"), "row").withColumn("code", F.col("code") + F.col("_code")).drop("_code")
    return out.select(
        F.col("doc").alias(doc_id), F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(unknown) * F.col("rest") + F.coalesce("more_base", F.lit(0.0)) - F.lit(each) * F.col("tokens")).alias("base_score"),
        F.col("code").alias("score"),
    )
