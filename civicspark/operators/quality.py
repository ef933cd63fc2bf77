"""Counts of missing values, duplicate rows and missing properties, and the check of a saved crawl."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.sources.workbooks import NOT_AVAILABLE


def _missing(rows: DataFrame, column: str) -> Column:
    missing = F.col(column).isNull()
    if rows.schema[column].dataType.typeName() in ("double", "float"):
        missing = missing | F.isnan(column)
    return missing


def missing_values(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``missing_values``: nulls over all ``columns``, per group of ``by`` if given."""
    per_row = sum((_missing(rows, c).cast("long") for c in columns), F.lit(0).cast("long"))
    total = F.coalesce(F.sum(per_row), F.lit(0).cast("long")).alias("missing_values")
    return rows.groupBy(*by).agg(total)


def duplicate_rows(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``duplicate_rows``: rows beyond the first of each set of identical rows; null equals null.

    Copies are counted in each task before the shuffle, so one row repeated
    very often costs no more than any other.
    """
    copies = rows.groupBy(*by, *columns).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    total = F.coalesce(F.sum("_extra"), F.lit(0).cast("long")).alias("duplicate_rows")
    return copies.groupBy(*by).agg(total)


def missing_properties(properties: DataFrame) -> DataFrame:
    """``file_path, missing_keys`` of the files that lack properties, keys in alphabetical order."""
    absent = properties.filter(F.col("value") == NOT_AVAILABLE)
    return absent.groupBy("file_path").agg(F.sort_array(F.collect_set("property")).alias("missing_keys"))


def verify_visited(visited: DataFrame | None, column: str = "url_hash") -> DataFrame:
    """One row ``valid, reason, entries, distinct_entries`` for a saved visited list.

    It must be present, not empty and free of duplicates.
    """
    if visited is None:
        raise ValueError("no visited list was saved")
    copies = visited.groupBy(column).agg(F.count(F.lit(1)).alias("_copies"))
    sums = copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0).cast("long")).alias("entries"),
        F.count(F.lit(1)).alias("distinct_entries"),
    )
    reason = (
        F.when(F.col("entries") == 0, "empty")
        .when(F.col("entries") != F.col("distinct_entries"), "duplicates")
        .otherwise("ok")
    )
    return sums.select((reason == "ok").alias("valid"), reason.alias("reason"), "entries", "distinct_entries")
