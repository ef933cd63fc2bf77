"""The registered queries: against their SQL, and the pipeline against each stage done plainly."""

import hashlib
from pathlib import Path

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from civicspark.llm import decontamination, quality_rules, queries, sentencepiece_codec, sql

from .test_jaccard_join import brute as brute_join


@pytest.fixture(scope="module")
def database(tables):
    connection = duckdb.connect()
    for file in Path(tables).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, tables, database, name):
    frame = queries.queries()[name](spark, tables)
    answer = database.execute(sql.oracle_sql()[name])
    theirs = [c[0] for c in answer.description]
    assert sorted(theirs) == sorted(frame.columns)
    places = [theirs.index(c) for c in sorted(frame.columns)]
    expected = sorted((tuple(r[i] for i in places) for r in answer.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=repr) == expected


def test_all_are_registered():
    known = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in known) == 1
    assert "pipeline" in known


def test_contract_columns(spark, tables):
    for name, columns in {
        "op1_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    }.items():
        found = queries.queries()[name](spark, tables)
        assert columns.items() <= dict(found.dtypes).items()
        assert found.count() == spark.read.parquet(f"{tables}/documents.parquet").count()


def test_pipeline_equals_plain_stages(spark, tables, database):
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    rules = quality_rules.fit(documents, labels)
    good = {r.doc_id for r in quality_rules.judge(documents, rules).collect() if r.kept}
    database.execute(f"CREATE TABLE good AS SELECT * FROM documents WHERE doc_id IN ({', '.join(map(str, good))})")
    cleaned = database.execute(f"WITH {sql._line_dedup('good', 20)}, cleaned AS ({sql._LEFT.format(source='good')}) "
                               r"SELECT doc_id, coalesce(text, '') FROM cleaned WHERE n_removed = 0 OR regexp_matches(coalesce(text, ''), '[^\x20\x09-\x0D]')").fetchall()
    joined = brute_join(sorted(cleaned), 5, 80)
    first = {i for i, _, component, _ in joined if i == component}
    kept = [(i, t) for i, t in sorted(cleaned) if i in first]
    frame = spark.createDataFrame(kept, "doc_id long, text string")
    copies = {r.doc_id for r in decontamination.find_copies(frame, benchmark).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.tokenizer_path("piece_bpe_32k.model"))
    expected = {}
    for i, text in kept:
        if i not in copies:
            ids = library.encode(text, add_eos=True)
            expected[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in P.run(spark, tables).collect()}
    assert found == expected and 0 < len(found) < len(good)


def test_stages_keep_the_columns(spark, documents, tables):
    given = documents([(1, "word " * 60), (2, None), (3, "")]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, given, tables).columns == given.columns
        assert stage(spark, given.limit(0), tables).count() == 0


def test_stages_keep_columns_whose_names_clash(spark, documents, tables):
    """Every column of the input comes out with its values, whatever a stage calls its own."""
    rows = [(k, f"line {k} " + " ".join(f"w{k}x{j}" for j in range(60))) for k in range(4)]
    given = documents(rows).withColumns({"removed_lines": F.lit("mine"), "kept": F.lit(True), "doc": F.col("doc_id"), "set": F.lit("s"), "row": F.lit(1)})
    for _, stage in P.STAGES[:-1]:
        found = stage(spark, given, tables)
        assert found.dtypes == given.dtypes
        assert sorted(found.collect(), key=repr) == sorted(given.collect(), key=repr)
