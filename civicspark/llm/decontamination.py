"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment scores the copies.

1. Test items are cut into segments of at most ``SEGMENT`` words that overlap by half. Words are runs of letters and digits in
   lower case; in scripts written without spaces every character is a word.
2. Seeds are word n-grams of the segments, of ``n`` words and shorter ones down to two. Their chance to be in a random document goes
   by the counts of their words in all documents. An n-gram of ``n`` words is a seed if it is rare, and the rarer half of those of a
   segment always are, so every segment has seeds; a shorter one is a seed if it is ten times as rare.
3. One pass over the documents finds the n-grams that a Bloom filter of the seeds lets through. Those near each other make a
   passage: the words around them. Passages are few and short, texts are not moved.
4. The n-grams of the passages are joined with the seeds, which pairs passages with segments; the words of both meet in two more joins,
   and every pair is aligned: 2 for equal words, -1 for others, -1 for a gap. A passage is a copy when
   its score is at least ``similarity`` of the segment's score with itself.

Segments, word counts, seeds, passages and pairs are tables; of the benchmark only the filter, of ``FILTER_BYTES``, goes to the
executors, and the documents are read twice, whatever the size of the benchmark. (A benchmark of very many millions of
words fills the filter; then more n-grams pass it and the join does more of the work. The result is the same.)

A copy with an edit every three words still has rare pairs of words, unless all its words are common ones; a copy
without any seed is not found.

Defined results: null and empty texts match nothing; items of fewer than ``least_words`` words match nothing, as a copy
could not be told from chance; repeated rows are judged one by one; items of one id are items of their own; other columns are left
alone. ``doc_id`` and ``item_id`` may not bear one name in :func:`find_copies`, which is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.llm.tables import in_files, spare_name, written
from civicspark.llm.words import Words, chunks, find_words, mixed, shingles

N = 4
SEGMENT = 64
LEAST_WORDS = 8
SIMILARITY = 0.5
#: A seed of ``N`` words is rare if a random document has it with at most this probability; a shorter one, with a tenth of it.
CHANCE = 1e-4
#: Bloom filter of the seeds, and of the benchmark's words.
FILTER_BYTES = 1 << 22
ADDERS = 16
#: Hashes for which a task makes a filter; one for each of many small partitions would be far more to carry than the hashes.
FILTER_ROWS = 1 << 20

_APART = np.ones(256, dtype=bool)
_APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Scripts written without spaces between words.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def _words(column: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    """First document, words and their hashes, piece by piece."""
    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    if pc.any(pc.match_substring_regex(lowered, _UNSPACED)).as_py():
        lowered = pc.replace_substring_regex(lowered, _UNSPACED, r" \1 ")
    for low, _, data, offsets in chunks(lowered):
        words = find_words(data, offsets, _APART)
        yield low, words, words.hashes(lower=False)


# --- Bloom filter ---


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places among ``size`` bits, a power of two."""
    mask = np.uint64(size - 1)
    return hashes & mask, mixed(hashes) & mask


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for held in batch.column(0):
            one = np.frombuffer(held.as_py(), dtype=np.uint8)
            total = one if total is None else total | one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["bits"])


def bloom(hashes: DataFrame, size: int, most: int | None = None) -> np.ndarray:
    """Filter of the one column of ``hashes`` in ``size`` bytes: one of each task, united in two more steps.

    ``most``: rows that the last step of ``hashes`` works on, at most; if known, they decide how many tasks there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(8 * size, dtype=bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), 8 * size):
                found[at] = True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(found).tobytes()], pa.binary())], names=["bits"])

    if most is not None:
        hashes = in_files(hashes, most, FILTER_ROWS)
    parts = hashes.mapInArrow(run, "bits binary").repartition(ADDERS).mapInArrow(_united, "bits binary")
    row = parts.coalesce(1).mapInArrow(_united, "bits binary").first()
    return np.frombuffer(row.bits, dtype=np.uint8) if row else np.zeros(size, dtype=np.uint8)


def lets_through(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for at in _bits(hashes, 8 * len(held)):
        out &= (held[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return out


# --- segments and seeds ---


def segments(benchmark: DataFrame, item_id: str, item_text: str, n: int, least_words: int) -> DataFrame:
    """``segment``, ``item`` and ``words`` (hashes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words = [], []
            for low, found, hashes in _words(batch.column(1)):
                for k in range(len(found.first) - 1):
                    own = hashes[found.first[k] : found.first[k + 1]]
                    if len(own) >= max(least_words, n):
                        for begin in range(0, max(1, len(own) - SEGMENT // 2), SEGMENT // 2):
                            at.append(low + k)
                            words.append(own[begin : begin + SEGMENT].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"]
            )

    kind = benchmark.schema[item_id].dataType.simpleString()
    found = benchmark.select(F.col(item_id), F.col(item_text).cast("string")).mapInArrow(cut, f"item {kind}, words array<long>")
    return written(found.select(F.monotonically_increasing_id().alias("segment"), "item", "words"), "segments")


def _with_counts(documents: DataFrame, text: str, found: DataFrame) -> tuple[DataFrame, float, int]:
    """``segment``, ``words`` and ``counts`` of those words in all documents; words of a document, on average, and of all."""
    places = found.select("segment", F.posexplode("words").alias("place", "word"))
    most = found.agg(F.sum(F.size("words"))).first()[0] or 0
    vocabulary = bloom(places.select("word").distinct(), FILTER_BYTES, most)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents_n = words_n = 0
        for batch in batches:
            documents_n += batch.num_rows
            for _, _, hashes in _words(batch.column(0)):
                words_n += len(hashes)
                own, n = np.unique(hashes[lets_through(vocabulary, hashes)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), 1, dtype=np.int32)), pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "word", "n"]
                )
        yield pa.RecordBatch.from_pydict(
            {"kind": pa.array([2, 3], pa.int32()), "word": pa.array([0, 0], pa.int64()), "n": pa.array([documents_n, words_n], pa.int64())}
        )

    counts = written(
        documents.select(F.col(text).cast("string")).mapInArrow(counted, "kind int, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")),
        "word-counts",
    )
    sums = {r.kind: r.n for r in counts.filter("kind > 1").collect()}
    held = places.join(counts.filter("kind = 1").select("word", "n"), "word", "left").groupBy("segment").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "word", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("counts")
    )
    return found.select("segment", "words").join(held, "segment"), sums.get(3, 0) / max(1, sums.get(2, 0)), max(1, sums.get(3, 0))


def seeds_of(words: np.ndarray, counts: np.ndarray, n: int, document_words: float, total: float, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a segment and their places."""
    hashes, places = [], []
    share = counts / total
    for size in range(2, n + 1):
        made, _ = shingles(words, np.array([0, len(words)]), size)
        probability = document_words * np.prod([share[k : len(made) + k] for k in range(size)], axis=0)
        chosen = probability <= (chance if size == n else chance / 10)
        if size == n:
            chosen[np.argsort(probability, kind="stable")[: -(-len(made) // 2)]] = True
        hashes.append(made[chosen])
        places.append(np.flatnonzero(chosen))
    return np.concatenate(hashes), np.concatenate(places)


def rare_seeds(documents: DataFrame, text: str, found: DataFrame, n: int, chance: float) -> DataFrame:
    """``seed``, ``segment``, and the ``low`` and ``high`` place that the seed has in the segment."""
    counted, document_words, total = _with_counts(documents, text, found)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment, seed, place = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for k, words, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own, at = seeds_of(np.array(words, dtype=np.int64).view(np.uint64), np.array(counts, dtype=float), n, document_words, total, chance)
                segment.append(np.full(len(own), k)), seed.append(own), place.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(seed).view(np.int64)), pa.array(np.concatenate(segment)), pa.array(np.concatenate(place).astype(np.int32))],
                names=["seed", "segment", "place"],
            )

    made = counted.mapInArrow(chosen, "seed long, segment long, place int")
    most = found.agg(F.sum(F.size("words"))).first()[0] or 0
    return written(in_files(made.groupBy("seed", "segment").agg(F.min("place").alias("low"), F.max("place").alias("high")), most * (n - 1)), "seeds")


# --- passages ---


def passages(documents: DataFrame, doc_id: str, text: str, seeds: DataFrame, n: int) -> DataFrame:
    """``passage``, ``doc``, ``said`` (hash of the text), ``begin`` (place of its first word), ``words``, ``at`` and ``seed`` of its n-grams."""
    held = bloom(seeds.select("seed"), FILTER_BYTES, seeds.count())
    around = 2 * SEGMENT

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begins, words_out, ats, hits_out = [], [], [], [], []
            for low, words, hashes in _words(batch.column(2)):
                at, seed = [], []
                for size in range(2, n + 1):
                    made, first = shingles(hashes, words.first, size)
                    hit = np.flatnonzero(lets_through(held, made))
                    document = np.searchsorted(first, hit, side="right") - 1
                    at.append(hit - first[document] + words.first[document])
                    seed.append(made[hit])
                at, seed = np.concatenate(at), np.concatenate(seed)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                document = np.searchsorted(words.first, at, side="right") - 1
                starts = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (at[1:] - at[:-1] > around)]))
                for s, e in zip(starts, [*starts[1:], len(at)], strict=True):
                    d = document[s]
                    begin, end = max(words.first[d], at[s] - around), min(words.first[d + 1], at[e - 1] + around)
                    rows.append(low + int(d)), begins.append(int(begin - words.first[d]))
                    words_out.append(hashes[begin:end].view(np.int64))
                    ats.append((at[s:e] - begin).astype(np.int32))
                    hits_out.append(seed[s:e].view(np.int64))
            which = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(which), batch.column(1).take(which), pa.array(begins, pa.int32()), pa.array(words_out, pa.list_(pa.int64())),
                 pa.array(ats, pa.list_(pa.int32())), pa.array(hits_out, pa.list_(pa.int64()))],
                names=["doc", "said", "begin", "words", "at", "seed"],
            )

    kind = documents.schema[doc_id].dataType.simpleString()
    named = documents.select(F.col(doc_id), _said(text), F.col(text).cast("string"))
    found = named.mapInArrow(search, f"doc {kind}, said long, begin int, words array<long>, at array<int>, seed array<long>")
    return written(found.select(F.monotonically_increasing_id().alias("passage"), "*"), "passages")


def _said(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


# --- alignment ---


def align(passage: np.ndarray, segment: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the place in ``passage`` after its end."""
    steps = np.arange(1, len(segment) + 1)
    row, best, end = np.zeros(len(segment) + 1, dtype=np.int64), 0, 0
    for k, word in enumerate(passage):
        open_end = np.maximum(np.maximum(row[:-1] + np.where(segment == word, 2, -1), row[1:] - 1), 0)
        row[1:] = np.maximum.accumulate(open_end + steps) - steps
        top = int(row.max())
        if top > best:
            best, end = top, k + 1
    return best, end


def _copies(words: np.ndarray, own: np.ndarray, hits: np.ndarray, similarity: float) -> Iterator[tuple[float, int, int]]:
    """Similarity, first word and end of the copies of a segment in a passage. ``hits``: place in the passage, low and high in the segment."""
    hits = hits[np.argsort(hits[:, 0], kind="stable")]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(hits[:, 0]) > 2 * len(own)]))
    for low, high in zip(starts, [*starts[1:], len(hits)], strict=True):
        part, slack = hits[low:high], len(own) // 2
        begin = max(0, part[0, 0] - part[:, 2].max() - slack)
        near = words[begin : part[-1, 0] + len(own) - part[:, 1].min() + slack]
        if np.isin(own, near).sum() < similarity * len(own):  # cannot reach the score
            continue
        score, end = align(near, own)
        if score >= similarity * 2 * len(own):
            yield score / (2 * len(own)), int(begin), int(begin + end)


def find_copies(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = N, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, chance: float = CHANCE,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``first_word`` and ``end_word`` of every passage that copies a test item.

    Only documents with a copy have rows: the best passage of each segment stretch.
    """
    if doc_id == item_id:
        raise ValueError("the ids of documents and items need different names")
    found = _found(documents, benchmark, doc_id, text, item_id, item_text, n, least_words, similarity, chance)
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "similarity", "first_word", "end_word")


def _found(documents, benchmark, doc_id, text, item_id, item_text, n, least_words, similarity, chance) -> DataFrame:
    cut = segments(benchmark, item_id, item_text, n, least_words)
    seeds = rare_seeds(documents, text, cut, n, chance)
    held = passages(documents, doc_id, text, seeds, n)
    hits = held.select("passage", F.explode(F.arrays_zip("at", "seed")).alias("hit")).select("passage", "hit.at", "hit.seed")
    pairs = hits.join(seeds, "seed").groupBy("passage", "segment").agg(F.flatten(F.collect_list(F.array("at", "low", "high"))).alias("hits"))
    met = (
        pairs.join(cut.withColumnRenamed("words", "own"), "segment")
        .join(held.select("passage", "doc", "said", "begin", "words"), "passage").select("doc", "said", "item", "begin", "words", "own", "hits")
    )

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            begins, words, own, hits = (batch.column(c) for c in range(3, 7))
            for k in range(batch.num_rows):
                parts = (c[k].values.to_numpy(zero_copy_only=False) for c in (words, own, hits))
                passage, segment, places = parts
                for score, first, end in _copies(passage, segment, places.reshape(-1, 3).astype(np.int64), similarity):
                    rows.append(k)
                    out.append((score, first + begins[k].as_py(), end + begins[k].as_py()))
            which = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(which) for c in range(3)), pa.array([o[0] for o in out], pa.float64()),
                 *(pa.array([o[c] for o in out], pa.int32()) for c in (1, 2))],
                names=["doc", "said", "item", "similarity", "first_word", "end_word"],
            )

    schema = T.StructType([met.schema["doc"], met.schema["said"], met.schema["item"], *T._parse_datatype_string("similarity double, first_word int, end_word int")])
    return met.mapInArrow(aligned, schema)


def drop_copies(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N,
    least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, chance: float = CHANCE,
) -> DataFrame:
    """The rows of ``documents`` without a copy of a test item, with all their columns.

    A text is known by two hashes of 64 bits, so rows of equal texts go together.
    """
    said = F.struct(_said(text).alias("a"), F.xxhash64(F.lit(1), F.col(text).cast("string")).alias("b"))
    own, gone = spare_name(documents, "own"), spare_name(documents, "gone")
    named = documents.select(said.alias("id"), F.col(text).cast("string").alias("text"))
    found = _found(named, benchmark, "id", "text", item_id, item_text, n, least_words, similarity, chance)
    copies = written(found.select(F.col("doc").alias(gone)).distinct(), "copies")
    return documents.withColumn(own, said).join(copies, F.col(own) == F.col(gone), "left_anti").drop(own)
