"""A plain Parquet table with a key, in hash folders: a write replaces the folders of its keys and leaves the others alone.

Spark's dynamic partition overwrite does the replacing. A write that was cut off is made good by writing the same rows
again. Readers see whole folders, so one that began before a write may have to be repeated. One process writes at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark import storage

#: Hash folders of a table; the more there are, the less a small write rewrites.
BUCKETS = 16


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of the table, none where nothing was written yet; ``bucket`` is kept, so that filters on it prune folders."""
    known = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*known.fields, T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(whole).parquet(path) if storage.exists(spark, path) else spark.createDataFrame([], whole)


def replace(rows: DataFrame, path: str, key: Sequence[str], buckets: int | None = None) -> None:
    """Put ``rows`` in the place of all stored rows whose key is among theirs.

    The new content of the touched folders is written to a staging folder, which Spark moves into its place when all of it is there.
    """
    spark, arrived = rows.sparkSession, f"{path}.arrived"
    _placed(rows.withColumn("bucket", bucket_of(key, buckets or BUCKETS))).mode("overwrite").parquet(arrived)
    new = read(spark, arrived, rows.schema)
    touched = storage.folders(spark, arrived, "bucket")
    if not touched:
        return
    if storage.exists(spark, path):
        old, gone = read(spark, path, rows.schema).filter(F.col("bucket").isin(touched)), new.select("bucket", *key).distinct()
        new = old.join(gone, [old[c].eqNullSafe(gone[c]) for c in ("bucket", *key)], "left_anti").unionByName(new)
    _placed(new).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    storage.drop(spark, arrived)


def _placed(rows: DataFrame):
    """A folder gets few files, a large one as many as it needs."""
    return rows.hint("rebalance", "bucket").write.partitionBy("bucket")
