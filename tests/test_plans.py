"""Shapes of physical plans that have to hold whatever the size of the data."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from civicspark.functions import urls as U
from civicspark.operators import files as W
from civicspark.operators import keyvalue as K
from civicspark.operators import sheets as S

FOLDER = Path("/root/testdata/sf0.001")


#: Queries that run all their jobs before they give a plan, which then only reads the answer.
ANSWERED = {
    "crawl_reach", "crawl_tables", "ingest_ledger", "state_resume", "stream_cooldown", "stream_stable", "weather_files", "weather_stored", "record_files",
}


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not there")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - ANSWERED))
def test_no_query_pairs_all_rows(spark, name):
    plan = _plan(entry.queries()[name](spark, str(FOLDER)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_url_rules_are_compiled(spark):
    url = F.concat(F.lit("https://a.net/"), F.col("id"))
    frame = spark.range(9).select(
        U.normalize_url(url), U.netloc_of(url), U.path_ext(url), U.not_excluded_ext(url), U.allowed_path(url),
        U.not_excluded_dir(url), U.url_hash(url),
    )
    assert "*(1) Project" in _plan(frame)


def test_scans_are_cut_to_what_is_used(spark):
    if not FOLDER.exists():
        pytest.skip("the tables are not there")
    plan = _plan(entry.weather_avg_temp(spark, str(FOLDER)))
    assert "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_hot_groups_are_cut(spark):
    """Rows of one group meet in windows of one block only, apart from one row per block."""
    name = F.concat(F.lit("n"), F.col("id") % 2)
    kv = spark.range(10).select(
        name.alias("file"), (F.col("id") % 3).alias("sheet_index"), name.alias("sheet"), F.col("id").alias("row"),
        F.when(F.col("id") > 2, "k").alias("key"), F.when(F.col("id") > 3, "v").alias("value"),
    )
    looks = spark.range(10).select(name.alias("path"), F.timestamp_seconds("id").alias("ts"), F.lit("x").alias("sha256"))
    for frame in (K.merge_split_values(kv), W.stable_files(looks)):
        windows = [line for line in _plan(frame).splitlines() if "Window [" in line]
        assert any("_block#" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in windows)
    exchanges = [line for line in _plan(W.cooldown(looks)).splitlines() if "Exchange hashpartitioning" in line]
    assert sum("block#" in line for line in exchanges) == 2 and len(exchanges) == 3


def test_neighbours_take_one_scan(spark, tmp_path):
    """The rows and the edges of their blocks come from the same exchange."""
    path = str(tmp_path / "kv")
    spark.range(1000).selectExpr("'f' AS file", "0 AS sheet_index", "'s' AS sheet", "id AS row", "string(id) AS key", "string(id) AS value").write.parquet(path)
    merged = K.merge_split_values(spark.read.parquet(path), block_rows=100)
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_latest_is_reduced_before_the_shuffle(spark):
    rows = spark.range(10).selectExpr("id % 3 AS k", "id AS o")
    assert "partial_max_by" in _plan(S.latest_per_key(rows, ["k"], ["o"]))
