"""Workbook pipelines: files to stored sheet documents, and the batch assessment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark import schemas, storage
from civicspark.functions.urls import content_sha256
from civicspark.operators import files as W
from civicspark.operators import keyvalue as K
from civicspark.operators import quality as Q
from civicspark.operators import sheets as S
from civicspark.plans import ledger
from civicspark.sources import sheet_store
from civicspark.sources import workbooks as X


def sheet_documents(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sheets, records, rejects`` of decoded workbook parts.

    One damaged or too small sheet rejects its whole file.
    """
    rows, extents = X.sheet_rows(parts), X.sheet_extents(parts)
    broken = X.workbook_rejects(parts)
    accepted = S.accepted_sheets(extents, broken)
    metadata = F.struct(*[F.get("heading", i).alias(n) for i, n in enumerate(S.HEADING)]).alias("metadata")
    count = F.greatest(F.col("n_rows") - S.FIRST_RECORD_ROW, F.lit(0)).alias("records")
    sheets = accepted.select(*S.SHEET, metadata, count)
    records = S.sheet_records(rows, accepted)
    small = S.sheet_rejects(extents.join(broken, "file_path", "left_anti"))
    return sheets, records, broken.unionByName(small)


def ingest_workbooks(files: DataFrame, store: str, batch_id: int, writer: str = "main") -> DataFrame:
    """Decode ``files(path, modificationTime, length, content)`` and upsert their sheets into ``store``.

    The decoded parts are written first, so that every file is opened once. Gives ``path, modificationTime`` of the
    files that could be decoded. ``writer`` and ``batch_id`` name the batch; repeating it changes nothing.
    """
    spark = files.sparkSession
    staged = f"{store}/parts/writer={writer}/batch={batch_id}"
    X.decode_workbooks(files).write.mode("overwrite").parquet(staged)
    parts = spark.read.parquet(staged)
    sheets, records, rejects = sheet_documents(parts)
    named = files.select("path", "modificationTime")
    modified = named.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"))
    rejects.write.mode("overwrite").parquet(f"{store}/rejects/writer={writer}/batch={batch_id}")
    sheet_store.upsert_sheets(sheets.join(modified, "file_path"), records, store, batch_id, writer=writer)
    broken = X.workbook_rejects(parts).select(F.col("file_path").alias("path"))
    return named.join(broken, "path", "left_anti")


def load_workbooks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files at ``paths`` with their bytes; no other file is opened."""
    plain = [re.sub(r"([\\*?{}\[\],])", r"\\\1", p) for p in paths]
    return spark.read.format("binaryFile").load(plain) if plain else spark.createDataFrame([], schemas.BINARY_FILES)


def _pieces(paths: DataFrame, size: int = ledger.FILES_PER_BATCH) -> Iterator[list[str]]:
    rows = paths.select("path").toLocalIterator()
    while piece := [r.path for r in islice(rows, size)]:
        yield piece


def ingest_changed(
    spark: SparkSession, folder: str, store: str, recursive: bool = True, ready: DataFrame | None = None
) -> int | None:
    """Ingest the workbooks that are new or were rewritten since the last run.

    Gives the number of the last batch that took a file, None if there was none.

    Unlike a file stream this sees a file that was rewritten under its name. With ``ready(path, modificationTime)``
    only those are taken (see :func:`ingest_stable`). Only the chosen files are opened. A file that does not
    decode is reported among the rejects and tried again at the next run. A run that was cut off at any
    point is made good by the next one (see ``plans.ledger``).
    """

    def listing() -> DataFrame:
        found = X.scan_workbooks(spark, folder, recursive).select("path", "modificationTime")
        return found if ready is None else found.join(ready, ["path", "modificationTime"], "left_semi")

    def apply(files: DataFrame, batch: int) -> DataFrame:
        # A batch left over may name files that are gone.
        present = files.join(X.scan_workbooks(spark, folder, recursive).select("path"), "path", "left_semi")
        paths = [r.path for r in present.select("path").collect()]
        return ingest_workbooks(load_workbooks(spark, paths), store, batch, "listing")

    took = ledger.take_up(spark, f"{store}/ledger", listing, apply)
    return took[-1] if took else None


_LOOKS = "path string, ts timestamp, sha256 string, modificationTime timestamp, length bigint"


def _looks(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(_LOOKS).parquet(log) if storage.exists(spark, log) else spark.createDataFrame([], _LOOKS)


def observe_files(spark: SparkSession, folder: str, log: str, cooldown_seconds: int = 0) -> None:
    """Append an observation of each workbook below ``folder`` that may have changed to those at ``log``.

    Looked at are files without an observation, with another time or length than at the last one, or whose last two
    hashes differ; none that was looked at within ``cooldown_seconds``. The others are not opened.
    """
    last_two = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("sha256"))) <= 2
    order = F.struct("ts", "sha256")
    state = _looks(spark, log).withColumn("recent", last_two).filter("recent").groupBy("path").agg(
        F.max("ts").alias("seen"), F.max_by(F.struct("modificationTime", "length", "sha256"), order).alias("last"),
        F.collect_list("sha256").alias("hashes"),
    )
    listing = X.scan_workbooks(spark, folder).select("path", "modificationTime", "length")
    same = (F.col("modificationTime") == F.col("last.modificationTime")) & (F.col("length") == F.col("last.length"))
    settled = same & (F.size("hashes") == 2) & (F.col("hashes")[0] == F.col("hashes")[1])
    recent = F.unix_seconds(F.current_timestamp()) - F.unix_seconds("seen") < cooldown_seconds
    due = listing.join(state, "path", "left").filter(~F.coalesce(settled, F.lit(False)) & ~F.coalesce(recent, F.lit(False)))
    for paths in _pieces(due):
        load_workbooks(spark, paths).select(
            "path", F.current_timestamp().alias("ts"), content_sha256(F.col("content")).alias("sha256"), "modificationTime", "length"
        ).write.mode("append").parquet(log)


def stable_workbooks(spark: SparkSession, log: str) -> DataFrame:
    """``path, modificationTime`` of the files whose last observation has the hash of the one before."""
    looks = _looks(spark, log)
    last = looks.groupBy("path").agg(F.max(F.struct("ts", "sha256")).alias("last")).select("path", "last.*")
    stable = W.stable_files(looks.select("path", "ts", "sha256", "modificationTime"))
    return stable.join(last, ["path", "ts", "sha256"], "left_semi").select("path", "modificationTime").distinct()


def ingest_stable(spark: SparkSession, folder: str, store: str, log: str, cooldown_seconds: int = W.COOLDOWN_SECONDS) -> int | None:
    """One round over a folder: look at what may have changed, then ingest what two looks found equal.

    A file that is still being written has another hash at the next look, so it is not decoded half-written.
    """
    observe_files(spark, folder, log, cooldown_seconds)
    return ingest_changed(spark, folder, store, ready=stable_workbooks(spark, log))


def assess_workbooks(spark: SparkSession, folder: str, output: str, recursive: bool = True) -> dict[str, DataFrame]:
    """Assess all workbooks below ``folder`` and write the dense key/value rows as JSON to ``output/records``.

    Gives ``rejects``, ``properties``, ``missing_keys``, ``rows`` and, per
    file, ``missing_values`` and ``duplicate_rows``.
    """
    X.decode_workbooks(X.scan_workbooks(spark, folder, recursive)).write.mode("overwrite").parquet(f"{output}/parts")
    parts = spark.read.parquet(f"{output}/parts")
    opened = X.workbook_rejects(parts)
    extents = X.sheet_extents(parts).join(opened, "file_path", "left_anti")
    kv = K.kv_rows(X.sheet_rows(parts).join(opened, "file_path", "left_anti"), extents)
    K.assessed_rows(kv, extents).write.mode("overwrite").parquet(f"{output}/assessed")
    rows = spark.read.parquet(f"{output}/assessed")
    write_records_json(rows, f"{output}/records")
    properties = X.workbook_properties(parts)
    first = K.first_dense_sheet(K.merge_split_values(K.drop_blank(kv)))
    odd = K.kv_rejects(extents, first).withColumnRenamed("file", "file_path")
    return {
        "rejects": opened.unionByName(odd),
        "properties": properties,
        "missing_keys": Q.missing_properties(properties),
        "rows": rows,
        "missing_values": Q.missing_values(rows, ["key", "value"], ["file"]),
        "duplicate_rows": Q.duplicate_rows(rows, ["key", "value"], ["file"]),
    }


def write_records_json(rows: DataFrame, folder: str, file: str = "file") -> None:
    """Records as JSON lines, one folder per workbook path, in row order, times in ISO form.

    The folder is named by the file and a hash of its whole path. Lines instead of one array, so that a large
    workbook is written by many tasks; each line names its file, and ``sheet`` and ``row`` where ``rows`` has them.
    Tasks take ranges of (workbook, sheet, row), so files of a workbook read by name give its rows in order.
    """
    name = F.regexp_replace(F.substring_index(file, "/", -1), r"\.xlsx$", "")
    workbook = F.concat(name, F.lit("-"), F.substr(F.sha2(F.col(file), 256), F.lit(1), F.lit(16)))
    titles = {"key": "Key", "value": "Value"}
    places = [c for c in ("sheet_index", "row") if c in rows.columns]
    fields = [F.col(c).alias(titles.get(c, c)) for c in rows.columns if c != "sheet_index"]
    (
        rows.withColumn("workbook", workbook)
        .repartitionByRange("workbook", *places)
        .sortWithinPartitions("workbook", *places)
        .select("workbook", *fields)
        .write.mode("overwrite").partitionBy("workbook")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").option("ignoreNullFields", False)
        .json(folder)
    )
