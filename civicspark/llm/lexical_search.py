"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its number of terms only. The index cuts documents into shards of bounded size; within a
shard those of equal m are one stratum, which is one row: its documents, its distinct terms and its postings by falling
tf. All documents of a stratum with the same tf of a term gain the same, so an impact is worked out once for each tf of a
stratum, not for each posting. The greatest tf of each term gives a bound on what any document of the stratum can score for an
item. Strata are visited by falling bound, and an item leaves out every stratum whose bound is below the score of its own
k-th document so far; a bound equal to it is visited, for the sake of ties. So the answer is that of scoring everything.

Nothing of the index is shuffled for a search: each task keeps the best k of every item, and one ranking by item joins them. Items
are searched in blocks of bounded vocabulary, whose weights go to the tasks.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z. N counts the documents with a term, L
all terms, df the documents with the term. Weight: floor(1000 * ln((2 * N + 2) / (2 * df + 1))); m: 10 + (90 * n * N) div L; score: the sum
over an item's distinct terms of weight * ((1000000000 * tf) div (1000 * tf + 8 * m)). Sums are exact: they are whole and
below 2^53 as long as an item has fewer than 300,000 distinct terms, and longer ones are added as 64-bit integers.

Defined results: a null text or one without terms holds nothing and finds nothing. Equal scores rank by ascending id, null last. Rows of
one id are documents of their own, and items of one id are items of their own. Texts are read whole. Columns other
than id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.tables import written
from civicspark.llm.words import chunks, find_words

#: Bytes of text and documents of a shard, at most; a longer document is a shard of its own.
SHARD_BYTES = 1 << 23
SHARD_DOCS = 1 << 13
#: Distinct terms of a block of items, on average over the blocks.
BLOCK_TERMS = 1 << 15
#: Strata of which bounds are compared, and contributions added up at once.
GROUP_STRATA = 1 << 7
PIECE = 1 << 19
#: Scores held at once.
CELLS = 1 << 21
#: Bytes of a row group of the index: readers hold one at a time.
ROW_GROUP = 1 << 24

_APART = np.ones(256, dtype=bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_STRATUM = (
    "m long, docs array<long>, terms array<string>, run_tf array<long>, run_first array<int>, post_term array<int>, post_doc array<int>"
)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts on end, and where each text's begin."""
    found = find_words(data, offsets, _APART)
    sizes = np.concatenate([[0], np.cumsum(found.ends - found.starts)])
    held = _LOWER[data[~_APART[data]]]
    buffers = [None, pa.py_buffer(sizes.astype(np.int64).tobytes()), pa.py_buffer(held.tobytes())]
    return pa.Array.from_buffers(pa.large_string(), len(found.starts), buffers), found.first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            sizes = np.diff(find_words(data, offsets, _APART).first)
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
    yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})


def normaliser(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    if 90 * int(sizes.max(initial=0)) * n < 1 << 63:
        return 10 + (90 * sizes * n) // total
    return np.array([10 + (90 * s * n) // total for s in sizes.tolist()], dtype=np.int64)


def _lists(values: np.ndarray | pa.Array, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values.cast(kind))


def _strata(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, n: int, total: int) -> pa.RecordBatch | None:
    """The strata of one shard."""
    terms, first = terms_of(data, offsets)
    sizes = np.diff(first)
    held = np.flatnonzero(sizes)
    if not len(held):
        return None
    m = normaliser(sizes[held], n, total)
    order = np.argsort(m, kind="stable")
    held, m = held[order], m[order]
    rank = np.full(len(sizes), -1, dtype=np.int64)
    rank[held] = np.arange(len(held))
    coded = terms.dictionary_encode()
    width = len(coded.dictionary)
    keys, tf = np.unique(np.repeat(rank, sizes) * width + coded.indices.to_numpy(), return_counts=True)
    doc, term = keys // width, keys % width
    marks = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    stratum = np.searchsorted(marks, doc, side="right") - 1
    # Distinct terms of each stratum, and the place of each posting's among them.
    pairs, which = np.unique(stratum * width + term, return_inverse=True)
    begin = np.searchsorted(pairs, np.arange(len(marks) + 1) * width)
    order = np.lexsort((which, -tf, stratum))
    stratum, tf, doc, which = stratum[order], tf[order], doc[order], which[order]
    runs = np.flatnonzero(np.concatenate([[True], (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])]))
    at = np.arange(len(marks) + 1)
    run_edges, post_edges = np.searchsorted(stratum[runs], at), np.searchsorted(stratum, at)
    return pa.RecordBatch.from_arrays([
        pa.array(m[marks]),
        _lists(ids.take(pa.array(held)), np.append(marks, len(held)), pa.int64()),
        _lists(coded.dictionary.take(pa.array(pairs % width)), begin, pa.string()),
        _lists(tf[runs], run_edges, pa.int64()),
        _lists(runs - post_edges[stratum[runs]], run_edges, pa.int32()),
        _lists(which - begin[stratum], post_edges, pa.int32()),
        _lists(doc - marks[stratum], post_edges, pa.int32()),
    ], names=["m", "docs", "terms", "run_tf", "run_first", "post_term", "post_doc"])


@dataclass(frozen=True)
class Index:
    """``strata`` and ``terms`` (``term``, ``df``) are written tables; ``n`` documents hold ``total`` terms."""

    strata: DataFrame
    terms: DataFrame
    n: int
    total: int


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counts = rows.select("text").mapInArrow(_counted, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = counts.n or 0, counts.total or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column(1), SHARD_BYTES):
                for k in range(0, high - low, SHARD_DOCS):
                    part = offsets[k : k + SHARD_DOCS + 1]
                    ids = batch.column(0).slice(low + k, len(part) - 1)
                    made = _strata(ids, data[part[0] : part[-1]], part - part[0], n, total)
                    if made is not None:
                        yield made

    strata = written(rows.mapInArrow(run, _STRATUM), "strata", **{"parquet.block.size": ROW_GROUP})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, post = batch.column("terms"), batch.column("post_term")
            at = _flat(post) + np.repeat(_begins(terms), pc.list_value_length(post).to_numpy())
            found = pc.value_counts(terms.flatten().take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["term", "df"])

    counted = strata.select("terms", "post_term").mapInArrow(frequencies, "term string, df long")
    return Index(strata, written(counted.groupBy("term").agg(F.sum("df").alias("df")), "terms"), n, total)


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _begins(column: pa.ListArray) -> np.ndarray:
    """Where each list begins among the flattened values."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.cumsum(sizes) - sizes


def _expanded(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries ``which`` of a table of ranges: the entry's number, and every place of its range."""
    count = first[which + 1] - first[which]
    owner = np.repeat(np.arange(len(which)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[which], count)


class _Block:
    """A block of items: ``vocabulary``, and for each of its terms the items that hold it; the best of each item so far."""

    def __init__(self, vocabulary: pa.Array, first: np.ndarray, items: np.ndarray, weights: np.ndarray, count: int, k: int):
        self.vocabulary, self.first, self.items, self.weights, self.count, self.k = vocabulary, first, items, weights, count, k
        self.whole = np.bincount(items, minlength=count).max(initial=0) >= 300_000

    def start(self) -> None:
        self.scores = [np.zeros(0, dtype=np.int64)] * self.count
        self.ids: list[list[int | None]] = [[]] * self.count
        self.least = np.zeros(self.count, dtype=np.int64)

    def added(self, key: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
        if self.whole:
            out = np.zeros(size, dtype=np.int64)
            np.add.at(out, key, value)
            return out
        return np.bincount(key, weights=value, minlength=size).astype(np.int64)

    def search(self, rows: pa.RecordBatch) -> None:
        """Score the documents of some strata, as far as they can be among the best."""
        m = rows.column("m").to_numpy()
        docs = rows.column("docs")
        doc_first = np.append(_begins(docs), len(docs.flatten()))
        terms, run_tf, post_term = rows.column("terms"), rows.column("run_tf"), rows.column("post_term")
        n_runs, n_posts = pc.list_value_length(run_tf).to_numpy(), pc.list_value_length(post_term).to_numpy()
        stratum_of_run = np.repeat(np.arange(len(m)), n_runs)
        tf = _flat(run_tf)
        impact_of_run = (1_000_000_000 * tf) // (1000 * tf + 8 * m[stratum_of_run])
        run_begin = _flat(rows.column("run_first")) + np.repeat(_begins(post_term), n_runs)
        impact = np.repeat(impact_of_run, np.diff(np.append(run_begin, n_posts.sum())))
        stratum = np.repeat(np.arange(len(m)), n_posts)
        known = pc.index_in(terms.flatten(), value_set=self.vocabulary).fill_null(-1).to_numpy()
        word = known[_flat(post_term) + _begins(terms)[stratum]]
        doc = _flat(rows.column("post_doc")) + doc_first[stratum]
        of_query = word >= 0
        word, doc, impact, stratum = word[of_query].astype(np.int64), doc[of_query], impact[of_query], stratum[of_query]
        # Postings come by falling tf, so the first of a term in a stratum has its greatest impact.
        pairs, at = np.unique(stratum * len(self.vocabulary) + word, return_index=True)
        owner, place = _expanded(self.first, pairs % max(len(self.vocabulary), 1))
        bound = self.added(
            (stratum[at])[owner] * self.count + self.items[place], self.weights[place] * impact[at][owner], len(m) * self.count
        ).reshape(len(m), self.count)
        post_edges = np.searchsorted(stratum, np.arange(len(m) + 1))
        order = np.argsort(-bound.max(axis=1, initial=0), kind="stable")
        ids = docs.flatten()
        upto = np.cumsum((doc_first[1:] - doc_first[:-1])[order]) * self.count
        low, step = 0, 1
        while low < len(order):
            # Twice as many strata each time, of CELLS scores together, or one larger one.
            room = int(np.searchsorted(upto, CELLS + (upto[low - 1] if low else 0), side="right")) - low
            step = max(1, min(step, room))
            self._visit(order[low : low + step], bound, post_edges, word, doc, impact, stratum, doc_first, ids)
            low, step = low + step, step * 2

    def _visit(self, part, bound, post_edges, word, doc, impact, stratum, doc_first, ids) -> None:
        active = (bound[part] >= self.least) & (bound[part] > 0)
        part, active = part[active.any(axis=1)], active[active.any(axis=1)]
        if not len(part):
            return
        n_docs = doc_first[part + 1] - doc_first[part]
        begin = np.cumsum(n_docs) - n_docs
        scores = np.zeros((int(n_docs.sum()), self.count), dtype=np.int64)
        flat = scores.reshape(-1)
        _, posts = _expanded(post_edges, part)
        row_of = np.full(int(part.max()) + 1, -1)
        row_of[part] = np.arange(len(part))
        sizes = self.first[word[posts] + 1] - self.first[word[posts]]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(PIECE, int(sizes.sum()) + PIECE, PIECE))
        low = 0
        for cut in cuts:
            some, low = posts[low : cut + 1], cut + 1
            if not len(some):
                continue
            owner, place = _expanded(self.first, word[some])
            row, item = row_of[stratum[some]][owner], self.items[place]
            wanted = active[row, item]
            owner, place, row, item = owner[wanted], place[wanted], row[wanted], item[wanted]
            at = doc[some][owner] - doc_first[stratum[some]][owner] + begin[row]
            if len(at):
                from_row, to_row = int(at.min()), int(at.max()) + 1
                key = (at - from_row) * self.count + item
                flat[from_row * self.count : to_row * self.count] += self.added(
                    key, self.weights[place] * impact[some][owner], (to_row - from_row) * self.count
                )
        _, places = _expanded(doc_first, part)
        for item in np.flatnonzero(active.any(axis=0)).tolist():
            self._keep(item, scores[:, item], places, ids)

    def _keep(self, item: int, found: np.ndarray, places: np.ndarray, ids) -> None:
        good = np.flatnonzero(found >= max(1, int(self.least[item])))
        if not len(good):
            return
        if len(good) > 4 * self.k:
            edge = np.partition(found[good], len(good) - self.k)[len(good) - self.k]
            good = good[found[good] >= edge]
        scores = np.concatenate([self.scores[item], found[good]])
        known = [*self.ids[item], *ids.take(pa.array(places[good])).to_pylist()]
        # Ids are compared as integers; null comes last.
        order = sorted(range(len(scores)), key=lambda x: (-scores[x], known[x] is None, known[x] or 0))[: self.k]
        self.scores[item], self.ids[item] = scores[order], [known[x] for x in order]
        if len(order) == self.k:
            self.least[item] = self.scores[item][-1]


def _best(index: Index, block: _Block, numbers: list[int], k: int) -> DataFrame:
    """The best ``k`` of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block.start()
        for batch in batches:
            for low in range(0, batch.num_rows, GROUP_STRATA):
                block.search(pa.RecordBatch.from_struct_array(batch.slice(low, GROUP_STRATA).to_struct_array()))
        out = [(numbers[x], d, int(s)) for x in range(block.count) for d, s in zip(block.ids[x], block.scores[x], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    return index.strata.mapInArrow(run, "item long, doc_id long, score long")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in chunks(batch.column("text")):
            terms, first = terms_of(data, offsets)
            owner = pa.array(np.repeat(np.arange(low, high), np.diff(first)))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(owner), terms.cast(pa.string())], names=["item", "term"])


def search(index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``."""
    named = written(items.select(
        F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")
    ), "items")
    weight = F.floor(1000 * F.log((2 * F.lit(index.n) + 2) / (2 * F.col("df") + 1))).cast("long")
    queries = written(
        named.select("item", "text").mapInArrow(_item_terms, "item long, term string").distinct().join(index.terms, "term")
        .select("item", "term", weight.alias("weight")).filter("weight > 0"),
        "query-terms",
    )
    blocks = -(-queries.count() // BLOCK_TERMS)
    best = None
    for number in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).orderBy("term", "item").toArrow()
        if not rows.num_rows:
            continue
        coded = rows.column("term").combine_chunks().dictionary_encode()
        numbers, which = np.unique(rows.column("item").to_numpy(), return_inverse=True)
        first = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary) + 1))
        block = _Block(coded.dictionary, first, which, rows.column("weight").to_numpy(), len(numbers), k)
        found = _best(index, block, numbers.tolist(), k)
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = queries.select("item", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
