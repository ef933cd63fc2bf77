"""Line dedup by winnowing: later copies of runs of lines are found by fingerprints of their windows and deleted.

Lines are the pieces between newlines; those without a word are not compared. A line stands for itself by two numbers of 60
bits from its MD5. Every run of lines with at least ``min_words`` words that came before, in an earlier document or earlier in its
own, is deleted; nothing else is.

1. Windows: from every line on, and from every line back, the run of lines that just reaches ``min_words`` words. Whether a run is a
   window depends on its lines alone, so a copy of a window is a window; and every run of enough words is
   the union of its windows, so one that is repeated is found by them.
2. The line of least hash of a window is its fingerprint. The fingerprint with the hash of the window around it is joined with the
   first place (document, line) that has both.
3. A match is extended: a window counted on from its first line by the line before it, one counted back from its last by the line
   after it, where both places have the same one. The lines beyond begin or end windows of their own, which extend it further.
4. The matches of a document are united and deleted. A line deleted always has an equal line before it, so the first
   copy of every line stays.

Work grows with the number of lines: a window is joined with one place, however often its lines are repeated.

Defined results: a null or empty text stays as it is; order is by document id (null first), then line; rows that repeat
both id and text are one document and are treated alike; a column named ``removed_lines`` is
replaced, other columns pass through. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.tables import in_files, spare_name, written

MIN_WORDS = 20
#: A word is a run of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"


def line_hash(line: Column, start: int = 1) -> Column:
    return F.conv(F.substring(F.md5(line), start, 15), 16, 10).cast("long")


def document_key(doc_id: str, text: str) -> Column:
    return F.struct(F.col(doc_id).alias("id"), line_hash(F.col(text).cast("string")).alias("said"))


def worded_lines(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines with a word: ``doc, line, h, g`` (hashes), ``words``, and ``place``, their number among the document's."""
    in_order = Window.partitionBy("doc").orderBy("line")
    return (
        # The key before the lines, or it would be worked out again for each of them.
        documents.select(document_key(doc_id, text).alias("doc"), F.split(F.col(text).cast("string"), "\n").alias("lines"))
        .select("doc", F.posexplode("lines").alias("line", "said"))
        .filter(F.col("said").rlike(WORD))
        .select("doc", "line", line_hash(F.col("said")).alias("h"), line_hash(F.col("said"), 17).alias("g"),
                F.regexp_count("said", F.lit(WORD)).alias("words"))
        .repartition("doc").dropDuplicates(["doc", "line"])
        .withColumn("place", F.row_number().over(in_order))
    )


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """A row for each window: its fingerprint ``print`` (least hash), ``a`` and ``b`` (hashes of the window), its first and last
    ``lines``, how far the fingerprint's line is from the first (``at``), the hash ``beside`` the end where it can be extended, and that line."""
    in_order = Window.partitionBy("doc").orderBy("line")
    lines = lines.withColumn("after", F.sum("words").over(in_order)).withColumn("before", F.col("after") - F.col("words"))
    ahead = Window.partitionBy("doc").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("doc").orderBy("after").rangeBetween(1 - min_words, 0)
    run = F.collect_list(F.struct("h", "place", "g", "line"))
    near = lambda step: F.lag(F.struct("h", "g", "line"), step).over(in_order)
    windows = lines.select(
        "doc",
        F.struct(F.when(F.sum("words").over(ahead) >= min_words, run.over(ahead)).alias("run"), near(1).alias("beside")).alias("ahead"),
        # One that reaches the words only with its last line is a window of its first line already.
        F.struct(F.when(F.sum("words").over(back) - F.col("words") >= min_words, run.over(back)).alias("run"), near(-1).alias("beside")).alias("back"),
    )
    return (
        windows.select("doc", F.explode(F.array("ahead", "back")).alias("w")).select("doc", "w.*").filter("run IS NOT NULL")
        .withColumn("least", F.array_min("run"))
        .select(
            "doc", F.col("least.h").alias("print"), (F.col("least.place") - F.col("run")[0]["place"]).alias("at"),
            F.xxhash64("run.h").alias("a"), F.xxhash64("run.g").alias("b"), F.col("run.line").alias("lines"), "beside",
        )
    )


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` (id and hash of the text) and ``lines``: places (from 0) of the lines to delete, for documents that have any."""
    prints = written(fingerprints(worded_lines(documents, doc_id, text), min_words), "fingerprints")
    key = ["print", "at", "a", "b"]
    firsts = prints.groupBy(*key).agg(
        F.min(F.struct("doc", F.col("lines")[0].alias("line"), "beside")).alias("first"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select(*key, "first")
    firsts = written(in_files(firsts, prints.count()), "first-places")
    same = F.struct("beside.h", "beside.g") == F.struct("first.beside.h", "first.beside.g")
    return (
        prints.join(firsts, key).filter((F.col("doc") != F.col("first.doc")) | (F.col("lines")[0] != F.col("first.line")))
        .select("doc", F.explode(F.when(same, F.array_append("lines", F.col("beside.line"))).otherwise(F.col("lines"))).alias("line"))
        .groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    )


def _mask(lines: Column) -> Column:
    """A byte for each line up to the last one deleted: 0 where it goes, else 1. Takes one pass over the lines, sorted."""
    gaps = F.zip_with(lines, F.concat(F.array(F.lit(-1)), lines), lambda x, y: F.concat(F.repeat(F.lit("1"), x - y - 1), F.lit("0")))
    return F.array_join(gaps, "").cast("binary")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``text`` less the repeated lines, and ``removed_lines`` (their places, empty where none)."""
    key, doc, lines, mask = (spare_name(documents, c) for c in ("key", "doc", "lines", "mask"))
    doomed = repeated_lines(documents, min_words, doc_id, text).select(
        F.col("doc").alias(doc), F.col("lines").alias(lines), _mask(F.col("lines")).alias(mask)
    )
    goes = lambda k: F.substring(F.col(mask), k + 1, F.lit(1)) == F.lit("0").cast("binary")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, k: ~goes(k)), "\n")
    return (
        documents.drop("removed_lines").withColumn(key, document_key(doc_id, text))
        .join(doomed, F.col(key) == F.col(doc), "left")
        .withColumn(text, F.when(F.col(lines).isNull(), F.col(text)).otherwise(left))
        .withColumn("removed_lines", F.coalesce(F.col(lines), F.array().cast("array<int>")))
        .drop(key, doc, lines, mask)
    )
