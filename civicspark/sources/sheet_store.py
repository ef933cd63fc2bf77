"""Sheet documents and their records: two keyed tables, replaced by document.

``sheets`` has one row per document, ``records`` one row per record, so that no sheet has to fit into one row. Records count
if they came with the document that is stored now.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark import storage
from civicspark.operators import sheets as S
from civicspark.sources import keyed_table

_SHEETS = (
    "_id string, file_path string, sheet_index int, sheet_name string, "
    "metadata struct<header: string, metadata: string, table_info: string, copyright: string>, records bigint, batch string"
)
_RECORDS = "_id string, batch string, row bigint, record map<string,string>"


def upsert_sheets(
    sheets: DataFrame, records: DataFrame, path: str, batch_id: int, key: Sequence[str] = ("sheet_name",), writer: str = "main",
    buckets: int | None = None,
) -> None:
    """Replace the documents of ``sheets`` and their ``records`` in the store at ``path``.

    ``sheets``: ``file_path, sheet_index, sheet_name, metadata, records`` (a count; null if the document has none) and
    optionally ``modified``. Documents lacking metadata or records are skipped. Of several documents with one key in a
    batch the last by ``modified``, file and sheet wins, and a batch wins over those before it. ``writer`` numbers its batches
    upwards and alone; a batch that it has finished is left as it is, one that was cut off is written again. ``buckets``, the hash folders, stay the same for the life of a store.
    """
    spark = sheets.sparkSession
    marks = f"{path}/finished/{writer}"
    finished = storage.versions(spark, marks, "batch")
    if finished and finished[-1] >= batch_id:
        return
    ordered = sheets if "modified" in sheets.columns else sheets.withColumn("modified", F.lit(None).cast("timestamp"))
    keyed = S.well_formed(ordered).withColumn("_id", S.sheet_key(key))
    newest = S.latest_per_key(keyed, ["_id"], ["modified", "file_path", "sheet_index"]).withColumn("batch", F.lit(f"{writer}/{batch_id}"))
    rows = records.join(newest.select("_id", "batch", "file_path", "sheet_index"), ["file_path", "sheet_index"])
    keyed_table.replace(rows.select("_id", "batch", "row", "record"), f"{path}/records", ["_id"], buckets)
    keyed_table.replace(
        newest.select("_id", "file_path", "sheet_index", "sheet_name", "metadata", "records", "batch"), f"{path}/sheets", ["_id"], buckets
    )
    spark.range(1).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
    for n in finished:
        storage.drop(spark, f"{marks}/batch={n}")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """The current documents, without their records."""
    return keyed_table.read(spark, f"{path}/sheets", _SHEETS).drop("bucket")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``_id, row, record`` of the current documents."""
    rows, current = keyed_table.read(spark, f"{path}/records", _RECORDS), read_sheets(spark, path).select("_id", "batch")
    return rows.join(current, ["_id", "batch"], "left_semi").select("_id", "row", "record")
