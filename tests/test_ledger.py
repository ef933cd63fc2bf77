import os

import pytest
from pyspark.sql import functions as F

from civicspark.plans import ledger as G
from civicspark.plans import workbooks as P
from civicspark.sources import keyed_table, sheet_store
from test_workbooks import _norths, _table
from workbook_files import write_workbook


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(keyed_table, "BUCKETS", 2)


class Died(Exception):
    pass


def _dies(*_, **__):
    raise Died


def _books(folder):
    folder.mkdir()
    for name, value in (("one", 1), ("two", 2)):
        write_workbook(folder / f"{name}.xlsx", {f"Sheet {name}": _table(value)})
    return str(folder)


@pytest.mark.parametrize("where", [(G, "changed_files"), (P.X, "decode_workbooks"), (sheet_store.keyed_table, "replace"), (G, "_settle")])
def test_a_run_cut_off_anywhere_loses_no_file(spark, tmp_path, monkeypatch, where):
    books, home = _books(tmp_path / "books"), str(tmp_path / "store")
    with monkeypatch.context() as patch:
        patch.setattr(*where, _dies)
        with pytest.raises(Died):
            P.ingest_changed(spark, books, home)
    write_workbook(tmp_path / "books" / "three.xlsx", {"Sheet three": _table(3)})
    assert P.ingest_changed(spark, books, home) is not None
    assert _norths(spark, home) == ["1", "2", "3"]
    assert G.processed(spark, f"{home}/ledger").count() == 3
    assert P.ingest_changed(spark, books, home) is None


@pytest.mark.parametrize("step", [1, 2, 4])
def test_a_run_cut_off_after_each_write(spark, tmp_path, monkeypatch, step):
    """The process dies right after its n-th keyed write or mark; files come, change and go before the next run."""
    books, home = _books(tmp_path / "books"), str(tmp_path / "store")
    left = [step]
    real = keyed_table.replace

    def replace(*given, **named):
        real(*given, **named)
        if left[0] == 0:
            left[0] = -1
            raise Died
        left[0] -= 1

    with monkeypatch.context() as patch:
        patch.setattr(keyed_table, "replace", replace)
        try:
            P.ingest_changed(spark, books, home)
            write_workbook(tmp_path / "books" / "between.xlsx", {"Sheet between": _table(7)})
            P.ingest_changed(spark, books, home)
        except Died:
            pass
    os.utime(write_workbook(tmp_path / "books" / "one.xlsx", {"Sheet one": _table(10)}), (2_000_000_000, 2_000_000_000))
    write_workbook(tmp_path / "books" / "three.xlsx", {"Sheet three": _table(3)})
    (tmp_path / "books" / "two.xlsx").unlink()
    P.ingest_changed(spark, books, home)
    expected = {"10", "3"} | ({"7"} if (tmp_path / "books" / "between.xlsx").exists() else set())
    assert expected <= set(_norths(spark, home)) <= expected | {"2"}
    entered = {r.path.rsplit("/", 1)[-1]: r.modificationTime.timestamp() for r in G.processed(spark, f"{home}/ledger").collect()}
    assert entered["one.xlsx"] == 2_000_000_000 and "three.xlsx" in entered
    assert P.ingest_changed(spark, books, home) is None


def test_lists_are_frozen_and_cut_into_batches(spark, tmp_path):
    home = str(tmp_path / "ledger")
    files = spark.range(100).select(F.concat(F.lit("f"), "id").alias("path"), F.timestamp_seconds("id").alias("modificationTime"))
    G.freeze(files, home, per_batch=30)
    assert [n for n, _ in G.waiting(spark, home)] == [0, 1, 2, 3]
    seen = []

    def apply(some, batch):
        seen.append((batch, some.count()))
        return some.filter("path <> 'f7'")

    more = files.unionByName(spark.createDataFrame([("new", None)], G.FILES))
    took = G.take_up(spark, home, lambda: more, apply)
    assert took[:4] == [0, 1, 2, 3] and sum(n for b, n in seen if b < 4) == 100
    assert [n for b, n in seen if b >= 4] == [2]  # the new one, and the one that could not be taken
    assert G.processed(spark, home).count() == 100 and G.waiting(spark, home) == []
    assert G.take_up(spark, home, lambda: files.limit(0), apply) == []


def test_keyed_replace(spark, tmp_path, rows_of):
    path = str(tmp_path / "table")
    schema = "k int, v string"
    put = lambda *rows: keyed_table.replace(spark.createDataFrame(rows, schema), path, ["k"], buckets=4)
    get = lambda: rows_of(keyed_table.read(spark, path, schema), "k", "v")
    assert get() == []
    put((1, "a"), (2, "a"), (2, "b"), (None, "n"))
    put()
    put((2, "c"), (9, "d"), (None, "m"))
    assert get() == [(1, "a"), (2, "c"), (9, "d"), (None, "m")]
    keyed_table.replace(spark.range(50).selectExpr("CAST(id AS int) AS k", "'x' AS v"), path, ["k"], buckets=4)
    assert len(get()) == 51


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    path = tmp_path / "table"
    many = spark.range(200).selectExpr("CAST(id AS int) AS k", "'x' AS v")
    keyed_table.replace(many, str(path), ["k"], buckets=16)
    before = {p: p.stat().st_mtime_ns for p in path.glob("bucket=*/*.parquet")}
    keyed_table.replace(many.filter("k = 5").selectExpr("k", "'y' AS v"), str(path), ["k"], buckets=16)
    after = set(path.glob("bucket=*/*.parquet"))
    assert {p.parent for p in before if p not in after} == {p.parent for p in after - set(before)} and len({p.parent for p in after - set(before)}) == 1
    assert keyed_table.read(spark, str(path), "k int, v string").filter("v = 'y'").count() == 1


def test_a_listing_read_as_a_table_is_one_batch(spark, tmp_path):
    home, seen = str(tmp_path / "ledger"), []

    def apply(some, batch):
        seen.append((batch, some.count()))
        return some

    many = G.FILES_PER_BATCH + 1
    files = spark.range(many).select(F.concat(F.lit("f"), "id").alias("path"), F.timestamp_seconds("id").alias("modificationTime"))
    assert G.take_up(spark, home, lambda: files, apply, per_batch=None) == [0] and seen == [(0, many)]


def test_each_listing_of_the_query_is_one_batch(spark, tmp_path, monkeypatch):
    """Also of more files than pass through the driver at once; the run that dies is that of the second listing."""
    import __spark_entry__ as entry

    orders = spark.range(5 * G.FILES_PER_BATCH // 2).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"),
        F.lit(1.5).alias("o_totalprice"),
        F.expr("CAST(make_date(1996 + CAST(id % 2 AS INT) * 2, 1, 1) AS timestamp_ntz)").alias("o_orderdate"),
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    frozen, freeze = [], G.freeze

    def noted(files, ledger, *given):
        freeze(files, ledger, *given)
        frozen.append([n for n, _ in G.waiting(spark, ledger)])

    monkeypatch.setattr(G, "freeze", noted)
    found = entry.queries()["ingest_ledger"](spark, str(tmp_path))
    assert found.count() == orders.count() and found.filter("applied <> 1 OR n_records <> 1").isEmpty()
    assert frozen == [[0], [1], []]
