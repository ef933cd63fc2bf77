"""Files taken up exactly once, whenever a run is cut off.

A ledger is a folder. Before a batch is applied, its list of files is frozen: ``intents/from=N`` holds the lists of the batches of one
listing and counts once it is complete. A batch is applied, its files are entered in ``processed``, and ``done/batch=N`` is
written, in this order. A run begins with the batches that have a list and are not done, with the list they had, and lists files
only afterwards. So a number never stands for two lists, and a file can be lost by no crash:

- before the list is complete, the next run lists again;
- while a batch is applied or after it, before it is done, the next run applies the same list again, which has to do no harm
  (``sheet_store.upsert_sheets`` skips a batch that it has finished);
- files that came meanwhile are in no list yet, and files rewritten meanwhile have another time than the one entered, so the next listing has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark import storage
from civicspark.operators.files import changed_files
from civicspark.sources import keyed_table

#: Files of a batch, about, where their paths pass through the driver when a batch is read, as those of workbooks do.
FILES_PER_BATCH = 20_000
FILES = "path string, modificationTime timestamp"
_PROCESSED = FILES + ", batch long"


def processed(spark: SparkSession, ledger: str) -> DataFrame:
    """``path, modificationTime, batch`` of the files taken up, each as it was last."""
    return keyed_table.read(spark, f"{ledger}/processed", _PROCESSED).drop("bucket")


def waiting(spark: SparkSession, ledger: str) -> list[tuple[int, str]]:
    """Number and list folder of each batch that was frozen and is not done."""
    done = set(storage.versions(spark, f"{ledger}/done", "batch"))
    lists = [f"{ledger}/intents/from={first}" for first in storage.versions(spark, f"{ledger}/intents", "from")]
    return [(n, f"{home}/batch={n}") for home in lists for n in storage.folders(spark, home, "batch") if n not in done]


def freeze(files: DataFrame, ledger: str, per_batch: int | None = FILES_PER_BATCH) -> None:
    """Write the lists of the next batches: the ``files`` that are new or were modified since they were taken up.

    Without ``per_batch`` all of them are one batch.
    """
    spark = files.sparkSession
    changed = changed_files(files.select("path", "modificationTime"), processed(spark, ledger))
    staged = f"{ledger}/changed"
    changed.write.mode("overwrite").parquet(staged)
    found = spark.read.schema(FILES).parquet(staged)
    count = found.count()
    if not count:
        return
    done = storage.versions(spark, f"{ledger}/done", "batch")
    first = done[-1] + 1 if done else 0
    parts = -(-count // per_batch) if per_batch else 1
    number = F.pmod(F.xxhash64("path"), F.lit(parts)) + first
    found.withColumn("batch", number).write.mode("overwrite").partitionBy("batch").parquet(f"{ledger}/intents/from={first}")


def _settle(spark: SparkSession, ledger: str) -> None:
    """Lists that are done are dropped, and all marks but the last."""
    for first in storage.versions(spark, f"{ledger}/intents", "from"):
        storage.drop(spark, f"{ledger}/intents/from={first}")
    for n in storage.versions(spark, f"{ledger}/done", "batch")[:-1]:
        storage.drop(spark, f"{ledger}/done/batch={n}")


def take_up(
    spark: SparkSession, ledger: str, listing: Callable[[], DataFrame], apply: Callable[[DataFrame, int], DataFrame],
    per_batch: int | None = FILES_PER_BATCH, buckets: int | None = None,
) -> list[int]:
    """Apply the batches left over from a run cut off, then those of a new listing. Gives the numbers of the batches that took a file.

    ``listing()``: ``path, modificationTime``. ``apply(files, batch)`` takes up the files of a list and gives the ``path`` of those it could
    take; the others are listed again by the next run. ``buckets``: hash folders of the log, the same for its life.
    ``per_batch``: None if ``apply`` reads a list as a table. A batch rewrites the folders of its keys, so many batches of one listing
    cost that many times the log and the store.
    """
    took = []
    for replay in (True, False):
        if not replay:
            freeze(listing(), ledger, per_batch)
        for n, folder in waiting(spark, ledger):
            files = spark.read.schema(FILES).parquet(folder)
            # Entered with the time of the list: a file rewritten since then differs from it and is listed again.
            entered = files.join(apply(files, n).select("path").distinct(), "path", "left_semi").withColumn("batch", F.lit(n).cast("long"))
            keyed_table.replace(entered, f"{ledger}/processed", ["path"], buckets)
            if not processed(spark, ledger).filter(F.col("batch") == n).isEmpty():
                took.append(n)
            spark.range(1).write.mode("overwrite").parquet(f"{ledger}/done/batch={n}")
        _settle(spark, ledger)
    return took
