"""Tables the operators read, and what they keep between steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.storage import drop, run_dir


#: Rows of a few numbers, and whole documents, for which a table gets a file of its own.
FILE_ROWS, FILE_DOCUMENTS = 1 << 16, 1 << 12


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(frame: DataFrame, purpose: str, **options: object) -> DataFrame:
    """``frame`` as a table in the shared folder: later steps read it, no lost executor takes it along. ``options`` are the writer's."""
    spark = frame.sparkSession
    path = run_dir(spark, purpose)
    frame.write.options(**options).parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    stored.written_to = path
    return stored


def in_files(frame: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``frame`` in no more partitions than ``rows`` rows need at ``each`` a partition; fewer stay as they are.

    A file costs calls of the store, and on a local one two processes that its writer starts, however few rows it has. ``rows`` should
    bound what the last step works on, not only what it returns.
    """
    return frame.coalesce(max(1, -(-rows // each)))


def discard(*frames: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing reads any more."""
    for frame in frames:
        drop(frame.sparkSession, frame.written_to)


def in_share(doc_id: Column, parts: int, rest: int) -> Column:
    """True for documents whose ``crc32`` of the id as text leaves ``rest``; an id of null is in no share."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def least_hashes(frame: DataFrame, doc_id: str, most: int) -> DataFrame:
    """The ``most`` rows of least id hash, so that every run takes the same ones.

    Of a large ``frame`` only rows below a hash that about twice as many have are sorted, or each task would send its
    own ``most`` rows on. Reads ``frame`` up to three times, so it should be a written table.
    """
    value, n = F.xxhash64(F.col(doc_id)), frame.count()
    if n > 4 * most:
        few = frame.filter(value <= -(1 << 63) + (1 << 64) * 2 * most // n)
        frame = few if few.count() >= most else frame
    return frame.orderBy(value, F.col(doc_id)).limit(most)


def spare_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``frame`` has no such column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
