"""Two-column sheets: key/value rows, split values put together, the first dense sheet.

Shape: ``file, sheet_index, sheet, row, key, value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.operators.blocks import neighbour
from civicspark.operators.sheets import SHEET

# Rows never read, and the density a sheet must exceed.
SKIPPED_ROWS = (10, 20)
DENSITY_THRESHOLD = 0.2

KV_SHEET = ["file", "sheet_index", "sheet"]


def kv_rows(rows: DataFrame, extents: DataFrame) -> DataFrame:
    """Key/value rows of the two-column sheets; the first row of a sheet is its header and left out."""
    two_wide = extents.filter(F.col("n_cols") == 2).select(*SHEET)
    values = F.col("values")
    return skip_rows(rows.join(two_wide, SHEET, "left_semi")).select(
        F.col("file_path").alias("file"),
        "sheet_index",
        F.col("sheet_name").alias("sheet"),
        "row",
        F.get(values, F.lit(0)).alias("key"),
        F.get(values, F.lit(1)).alias("value"),
    )


def skip_rows(rows: DataFrame, skipped: tuple[int, int] = SKIPPED_ROWS) -> DataFrame:
    """Rows after the header row 0 that are not in ``skipped`` (end not included)."""
    row = F.col("row")
    return rows.filter((row > 0) & ((row < skipped[0]) | (row >= skipped[1])))


def drop_blank(kv: DataFrame) -> DataFrame:
    """Without the rows that hold neither key nor value."""
    return kv.na.drop(how="all", subset=["key", "value"])


def merge_split_values(kv: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """A key without a value takes the value of the next row if that row has no key; that row stays.

    The next row is the next one still present. (Counting rows by their
    labels after blank ones were dropped would look further ahead.)
    """
    following = F.struct("key", "value")
    block = F.floor(F.col("row") / block_rows)
    near = neighbour(kv, KV_SHEET, ["row"], block, following, "_next", 1)
    takes = (
        F.col("key").isNotNull() & F.col("value").isNull()
        & F.col("_next").isNotNull() & F.col("_next.key").isNull()
    )
    return near.withColumn("value", F.when(takes, F.col("_next.value")).otherwise(F.col("value"))).drop("_next")


def _share(column: Column) -> Column:
    return F.avg(column.isNotNull().cast("double"))


def sheet_density(kv: DataFrame) -> DataFrame:
    """``density`` of each sheet: mean over both columns of the share of cells that hold a value."""
    return kv.groupBy(*KV_SHEET).agg(
        ((_share(F.col("key")) + _share(F.col("value"))) / 2).alias("density"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def dense_sheets(kv: DataFrame, threshold: float = DENSITY_THRESHOLD) -> DataFrame:
    """Sheets whose density is above ``threshold``."""
    return sheet_density(kv).filter(F.col("density") > threshold)


def first_dense_sheet(kv: DataFrame, threshold: float = DENSITY_THRESHOLD) -> DataFrame:
    """``file, sheet_index``: the first sheet of each file, in workbook order, that is dense enough."""
    return dense_sheets(kv, threshold).groupBy("file").agg(F.min("sheet_index").alias("sheet_index"))


def kv_rejects(extents: DataFrame, first: DataFrame) -> DataFrame:
    """``file, reason``: files where a sheet without exactly two columns comes before the first dense one."""
    odd = (
        extents.filter(F.col("n_cols") != 2)
        .groupBy(F.col("file_path").alias("file"))
        .agg(F.min_by(F.struct("sheet_name", "n_cols"), "sheet_index").alias("sheet"),
             F.min("sheet_index").alias("odd_index"))
    )
    reached = F.col("sheet_index").isNull() | (F.col("odd_index") < F.col("sheet_index"))
    return odd.join(first, "file", "left").filter(reached).select(
        "file", F.concat(F.col("sheet.n_cols"), F.lit(" columns: "), F.col("sheet.sheet_name")).alias("reason")
    )


def assessed_rows(kv: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """Merged rows of the first dense sheet of every file that is not rejected."""
    merged = merge_split_values(drop_blank(kv))
    first = first_dense_sheet(merged)
    if extents is not None:
        first = first.join(kv_rejects(extents, first), "file", "left_anti")
    return merged.join(first, ["file", "sheet_index"], "left_semi")
