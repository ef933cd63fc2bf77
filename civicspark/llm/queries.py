"""One query for each operator, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm import (
    decontamination, exact_dedup, jaccard_join, language_id, lexical_search, line_dedup, ppm, quality_classifier, quality_rules,
    sentencepiece_codec, url_filters, warc, whitening,
)
from civicspark.llm.tables import in_share, table
from civicspark.storage import run_dir

PIECES = "piece_bpe_32k.model"
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = in_share(F.col("doc_id"), 5, 0)
    model = quality_classifier.fit(documents.filter(~held_out), labels)
    return quality_classifier.classify(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") > 0).cast("int").alias("good"))
    return url_filters.judge_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_copies(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = in_share(F.col("doc_id"), 4, 2)
    model = language_id.fit(documents.filter(~held_out))
    return language_id.identify(documents, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares"
    )


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = run_dir(spark, "archive")
    warc.write_archive(table(spark, folder, "pages"), path, min_bytes=0)
    return warc.read_index(spark, path)


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join_alike(table(spark, folder, "documents"), n=4, percent=85)


def op7_ppm(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = in_share(F.col("doc_id"), 10, 0)
    return ppm.score_texts(documents, documents.filter(~held_out)).withColumn("held_out", held_out)


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, folder, "documents"), PIECES)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", "text", F.size("removed_lines").alias("n_removed")
    )


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_rules.judge(documents, quality_rules.fit(documents, labels)).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept", "score"
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    return whitening.whiten(embeddings, whitening.fit(embeddings, most=4))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, folder, "documents"))
    return lexical_search.search(index, table(spark, folder, "benchmark"), k=10)


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    before = in_share(F.col("doc_id"), 2, 0)
    found = exact_dedup.dedup(exact_dedup.build_history(documents.filter(before)), documents.filter(~before))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_url_filters": op2_url_filters,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_warc": op5_warc,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_ppm": op7_ppm,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_line_dedup": op9_line_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_whitening": op11_whitening,
        "op12_lexical_search": op12_lexical_search,
        "op13_exact_dedup": op13_exact_dedup,
    }
