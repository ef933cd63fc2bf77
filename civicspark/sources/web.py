"""Seeds, link policy, stored pages and saved crawl states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark import schemas, storage


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """``url`` of each seed in a JSON array file; a missing or damaged file is an error."""
    text = spark.read.text(path, wholetext=True)
    urls = F.from_json("value", "array<string>", {"mode": "FAILFAST"})
    return text.select(F.explode(urls).alias("url"))


def read_policy(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """``excluded_directories, excluded_extensions`` of a policy file without repeats; absent ones are empty.

    The policy is a hand-written settings file of one object, so it is read
    into the plan as constants rather than joined.
    """
    policy = spark.read.schema(schemas.POLICY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    first = policy.select(*[
        F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))).alias(c)
        for c in schemas.POLICY.fieldNames()
    ]).first()
    return first.excluded_directories, first.excluded_extensions


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages: ``url, html`` and, if stored, ``status`` and ``content_type``."""
    return spark.read.parquet(path)


def _set_digest(rows: DataFrame) -> DataFrame:
    """``entries, digest`` of ``rows(url_hash)``: both add up over parts that share no row, and a row too many or too few shows."""
    return rows.agg(
        F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.xxhash64("url_hash").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest")
    )


_DIGEST = "entries bigint, digest decimal(38,0)"


def _visited(spark: SparkSession, path: str, versions: list[int]) -> DataFrame:
    return spark.read.schema("url_hash string").parquet(*[f"{path}/visited/version={v}" for v in versions])


def save_state(visited: DataFrame, pending: DataFrame, path: str, only_new: bool = False) -> int:
    """Write the next numbered snapshot of ``visited(url_hash)`` and ``pending(url)``; returns its number.

    A snapshot holds the rows that those before it do not hold, and the count and digest of all. ``visited`` is the whole list, or with
    ``only_new`` what was visited since the last snapshot, which must be new; then nothing saved before is read.
    """
    spark = visited.sparkSession
    saved = storage.versions(spark, f"{path}/visited", "version")
    version = (saved[-1] if saved else 0) + 1
    rows = visited.select("url_hash")
    if saved and not only_new:
        new = rows.join(_visited(spark, path, saved), "url_hash", "left_anti").distinct()
    else:
        new = rows.distinct()
    # A snapshot counts once its visited part is complete, so that goes last.
    pending.write.mode("overwrite").parquet(f"{path}/pending/version={version}")
    digest = _set_digest(rows)
    if saved and only_new:
        before = spark.read.schema(_DIGEST).parquet(f"{path}/digest/version={saved[-1]}")
        digest = digest.union(before).agg(F.sum("entries").alias("entries"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
    digest.write.mode("overwrite").parquet(f"{path}/digest/version={version}")
    new.write.mode("overwrite").parquet(f"{path}/visited/version={version}")
    return version


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """``visited, pending`` of the latest snapshot, or None if there is none or it does not verify.

    It verifies if it is not empty and what is stored has the count and the digest that were saved, which a list saved with a
    duplicate in it has not. That is one pass, without a shuffle of the list.
    """
    saved = storage.versions(spark, f"{path}/visited", "version")
    if not saved:
        return None
    visited = _visited(spark, path, saved)
    said = spark.read.schema(_DIGEST).parquet(f"{path}/digest/version={saved[-1]}").first()
    if said != _set_digest(visited).first() or not said.entries:
        return None
    return visited, spark.read.parquet(f"{path}/pending/version={saved[-1]}")
