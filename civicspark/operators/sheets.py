"""Sheets to metadata and records, keyed by sheet name.

Input is one row per sheet row, ``file_path, sheet_index, sheet_name, row,
values``, and one row per sheet, ``n_rows, n_cols`` (:func:`extents_of` gives
it for tables that carry none). Because a row holds all its cells, records
need no shuffle of the cells: they meet the few header rows in one join.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Places of the parts of a sheet.
HEADER_ROW = 4
FIRST_RECORD_ROW = 6
HEADING = ["header", "metadata", "table_info", "copyright"]
SKIPPED_SHEET = "Contents"
MISSING_NAME = "nan"

SHEET = ["file_path", "sheet_index", "sheet_name"]


def extents_of(rows: DataFrame) -> DataFrame:
    """``n_rows`` and ``n_cols`` of each sheet up to its last row and cell that hold a value."""
    width = _width(F.col("values"))
    return rows.groupBy(*SHEET).agg(
        F.coalesce(F.max(F.when(width > 0, F.col("row") + 1)), F.lit(0).cast("long")).alias("n_rows"),
        F.max(width).alias("n_cols"),
    )


def _width(values: Column) -> Column:
    """Number of cells up to the last one that holds a value."""
    size = F.size(values)
    filled = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at(values, i).isNotNull())
    trimmed = F.element_at(values, -1).isNotNull()
    return (
        F.when(values.isNull() | (size == 0), 0)
        .when(trimmed, size)
        .otherwise(F.coalesce(F.array_max(filled), F.lit(0)))
    )


def drop_contents(sheets: DataFrame) -> DataFrame:
    """Without the sheets named ``Contents``."""
    return sheets.filter(F.col("sheet_name") != SKIPPED_SHEET)


def sheet_rejects(extents: DataFrame) -> DataFrame:
    """``file_path, reason``: files with a sheet too small for metadata and header; one rejects the file."""
    reason = (
        F.when(F.col("n_cols") < 2, F.concat(F.lit("one column: "), "sheet_name"))
        .when(F.col("n_rows") <= HEADER_ROW, F.concat(F.lit("no header row: "), "sheet_name"))
    )
    bad = drop_contents(extents).select("file_path", "sheet_index", reason.alias("reason"))
    return bad.filter("reason IS NOT NULL").groupBy("file_path").agg(F.min_by("reason", "sheet_index").alias("reason"))


def accepted_sheets(extents: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Extents of the sheets that become documents: no ``Contents``, no sheet of a rejected file."""
    refused = sheet_rejects(extents).select("file_path")
    if rejects is not None:
        refused = refused.union(rejects.select("file_path")).distinct()
    return drop_contents(extents).join(refused, "file_path", "left_anti")


def _cell(values: Column, col: int) -> Column:
    return F.get(values, F.lit(col))


def sheet_metadata(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """``header, metadata, table_info, copyright`` of each of ``sheets``.

    If ``sheets`` carries them as ``heading`` (decoded workbooks do) this is a
    projection; otherwise one pass over ``rows``, reduced in each task.
    """
    if "heading" in sheets.columns:
        return sheets.select(*SHEET, *[F.get("heading", i).alias(n) for i, n in enumerate(HEADING)])
    values, row = F.col("values"), F.col("row")
    first, second = _cell(values, 0), _cell(values, 1)
    cells = rows.select(*SHEET, "row", first.alias("first"), second.alias("second"), (_width(values) > 0).alias("filled"))
    found = cells.groupBy(*SHEET).agg(
        F.max(F.when(row == 0, F.col("second"))).alias("header"),
        F.max(F.when(row == 1, F.col("first"))).alias("metadata"),
        F.max(F.when(row == 2, F.col("first"))).alias("table_info"),
        F.max(F.when(F.col("filled"), F.struct("row", "first")))["first"].alias("copyright"),
    )
    return sheets.select(*SHEET).join(found, SHEET, "left")


def unique_names(names: Column) -> Column:
    """Names made unique in order: a name already taken gets ``_1``, ``_2`` ... , the first one free."""
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return F.when(unique, names).otherwise(_taken_in_turn(F.when(~unique, names)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _taken_in_turn(rows: pa.Array) -> pa.Array:
    """One pass over each row; the next number to try is kept for each name, so that it is linear."""
    out = []
    for names in rows.to_pylist():
        if names is None:
            out.append(None)
            continue
        taken, tried, done = set(), {}, []
        for name in names:
            found = name
            if found in taken and name is not None:
                number = tried.get(name, 0) + 1
                while (found := f"{name}_{number}") in taken:
                    number += 1
                tried[name] = number
            taken.add(found)
            done.append(found)
        out.append(done)
    return pa.array(out, type=pa.list_(pa.string()))


def header_names(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """``n_rows, names``: the unique column names of each of ``sheets``, as many as it has columns.

    The names come from row 4 (from ``header`` where ``sheets`` carries it); a
    missing name is ``nan``.
    """
    wide = sheets.filter("n_cols > 0")
    if "header" not in sheets.columns:
        header = rows.filter(F.col("row") == HEADER_ROW).select(*SHEET, F.col("values").alias("header"))
        wide = wide.join(header, SHEET, "left")
    padded = F.transform(
        F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.coalesce(F.get("header", i), F.lit(MISSING_NAME))
    )
    return wide.select(*SHEET, "n_rows", padded.alias("names")).withColumn("names", unique_names(F.col("names")))


def sheet_records(rows: DataFrame, sheets: DataFrame, drop_footer: bool = False) -> DataFrame:
    """``file_path, sheet_index, sheet_name, row, record`` for each data row of ``sheets``.

    The first cell is the key of the second if neither is missing. The other
    cells go under their column names, missing ones as ``""``; a column named
    like the key wins. The last row (the copyright line) is a record too,
    unless ``drop_footer``.
    """
    names = header_names(rows, sheets)
    data = rows.filter(F.col("row") >= FIRST_RECORD_ROW)
    end = F.col("n_rows") - (1 if drop_footer else 0)
    joined = data.join(names, SHEET).filter(F.col("row") < end)
    return joined.select(*SHEET, "row", row_to_record(F.col("values"), F.col("names")).alias("record"))


def row_to_record(values: Column, names: Column) -> Column:
    """One row as a map; see :func:`sheet_records`."""
    key, value = _cell(values, 0), _cell(values, 1)
    others = F.slice(names, 3, F.greatest(F.size(names) - 2, F.lit(0)))
    filled = F.transform(others, lambda _, i: F.coalesce(F.get(values, i + 2), F.lit("")))
    paired = key.isNotNull() & value.isNotNull() & ~F.array_contains(others, F.coalesce(key, F.lit("")))
    nothing = F.array().cast("array<string>")
    return F.map_from_arrays(
        F.concat(F.when(paired, F.array(key)).otherwise(nothing), others),
        F.concat(F.when(paired, F.array(value)).otherwise(nothing), filled),
    )


def numeric_key_rows(rows: DataFrame) -> DataFrame:
    """Rows whose first cell is a number (or a truth value) and whose second is not missing."""
    numeric = _cell(F.col("dtypes"), 0).isin("int", "float", "bool")
    return rows.filter(numeric & _cell(F.col("values"), 1).isNotNull())


def sheet_id(sheet_name: Column) -> Column:
    return F.md5(sheet_name)


def sheet_key(key: Sequence[str] = ("sheet_name",)) -> Column:
    """Document key: md5 of the sheet name, or of several columns."""
    return sheet_id(F.concat_ws("\x1f", *key))


def well_formed(documents: DataFrame) -> DataFrame:
    """Documents that have both ``metadata`` and ``records``."""
    return documents.filter(F.col("metadata").isNotNull() & F.col("records").isNotNull())


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``. Reduced in each task before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_newest.*")
