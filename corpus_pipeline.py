"""A corpus in five steps: quality rules, line dedup, near duplicates, benchmark decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm import decontamination, jaccard_join, line_dedup, quality_rules, sentencepiece_codec
from civicspark.llm.tables import FILE_DOCUMENTS, in_files, spare_name, table, written


def _few_files(docs: DataFrame, done: DataFrame) -> DataFrame:
    """``done``, what a stage makes of ``docs``, in no more files than its rows need."""
    return in_files(done, docs.count(), FILE_DOCUMENTS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _few_files(docs, quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels"))))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and with them documents of which no word is left."""
    # The operator names a column of its own like this; one of the input keeps its values.
    held = spare_name(docs, "held")
    cleaned = line_dedup.dedup_lines(docs.withColumnRenamed("removed_lines", held)).filter(
        (F.size("removed_lines") == 0) | F.col("text").rlike(line_dedup.WORD)
    )
    shorter = F.when(F.size("removed_lines") > 0, F.char_length("text")).otherwise(F.col("n_chars") if "n_chars" in docs.columns else None)
    own = {"removed_lines": F.col(held) if "removed_lines" in docs.columns else None, "n_chars": shorter.cast("long")}
    return _few_files(docs, cleaned.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word n-grams, the one of least id stays."""
    return _few_files(docs, jaccard_join.keep_first(docs, n=5, percent=80))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a test item go."""
    return _few_files(docs, decontamination.drop_copies(docs, table(spark, sf_dir, "benchmark")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, counted and digested, and the digest of what they decode to."""
    return _few_files(docs, sentencepiece_codec.encode_documents(docs, "piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: SQL cannot grow the forest of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
