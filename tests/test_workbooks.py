import json
import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from civicspark.functions.urls import content_md5, content_sha256
from civicspark.operators import files as W
from civicspark.operators import sheets as S
from civicspark.plans import workbooks as P
from civicspark.sources import sheet_store as store
from civicspark.sources import workbooks as X
from civicspark.streaming import watch as T
from workbook_files import Date, Error, write_workbook

TABLE = [
    [None, "Heading"], ["info"], ["title"], [None], ["Region", "2021", "2021", "Note"], ["units"],
    ["North", 12, 7.5, "N/A"], ["South", None, True, "inline:rich"], ["© notice"],
]


def _table(value):
    return [*TABLE[:6], ["North", value, 1, "x"], ["© notice"]]


@pytest.fixture
def folder(tmp_path):
    home = tmp_path / "books"
    (home / "deep").mkdir(parents=True)
    write_workbook(home / "one.xlsx", {"Contents": [["x"]], "Table 1": TABLE}, {"title": "One", "creator": "Me"})
    write_workbook(home / "deep" / "two.xlsx", {"Table 2": [*TABLE, [None] * 3]})
    (home / "broken.xlsx").write_bytes(b"PK\x03\x04 no workbook")
    (home / "upper.XLSX").write_bytes(b"ignored")
    write_workbook(home / "narrow.xlsx", {"Table 1": TABLE, "thin": [["a"]] * 9})
    return home


def _parts(spark, folder, **kw):
    return X.decode_workbooks(X.scan_workbooks(spark, str(folder)), **kw)


def _short(frame, column="file_path"):
    return frame.withColumn(column, F.substring_index(column, "/", -1))


def test_scan(spark, folder, rows_of):
    assert rows_of(_short(X.scan_workbooks(spark, str(folder)), "path"), "path") == [
        ("broken.xlsx",), ("narrow.xlsx",), ("one.xlsx",), ("two.xlsx",)
    ]
    assert X.scan_workbooks(spark, str(folder), recursive=False).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        X.scan_workbooks(spark, str(folder / "nowhere")).count()
    hashes = X.scan_workbooks(spark, str(folder)).filter(F.col("path").endswith("broken.xlsx")).select(
        content_sha256(F.col("content")), content_md5(F.col("content"))
    ).first()
    import hashlib
    data = (folder / "broken.xlsx").read_bytes()
    assert tuple(hashes) == (hashlib.sha256(data).hexdigest(), hashlib.md5(data).hexdigest())


def test_decoded_rows(spark, folder):
    write_workbook(folder / "types.xlsx", {"s": [
        [1, 2.5, 3.0, True, "text", "NULL", Date(44562), Date(44562.5), Date(0.25), Error(), None], [], ["inline:a & b", None, "z"], [None, "  "],
    ]})
    parts = _parts(spark, folder).filter(F.col("file_path").endswith("types.xlsx"))
    rows = {r.row: (r["values"], r.dtypes) for r in X.sheet_rows(parts).collect()}
    assert rows[0] == (
        ["1", "2.5", "3", "True", "text", None, "2022-01-01T00:00:00.000", "2022-01-01T12:00:00.000", "06:00:00"],
        ["int", "float", "int", "bool", "str", None, "datetime", "datetime", "time"],
    )
    assert rows[1] == ([], [])
    assert rows[2] == (["a & b", None, "z"], ["str", None, "str"])
    assert rows[3] == ([None, "  "], [None, "str"])
    assert tuple(X.sheet_extents(parts).select("sheet_index", "sheet_name", "n_rows", "n_cols").first()) == (0, "s", 4, 9)
    cells = X.workbook_cells(X.sheet_rows(parts))
    assert cells.count() == 11
    assert cells.filter("row = 2 AND col = 2").first().value == "z"


def test_chart_sheets_are_left_out(spark, tmp_path):
    write_workbook(tmp_path / "chart.xlsx", {"Table 1": TABLE}, chart="Chart 1")
    extents = X.sheet_extents(_parts(spark, tmp_path))
    assert [tuple(r) for r in extents.select("sheet_index", "sheet_name").collect()] == [(0, "Table 1")]


def test_rejects_and_properties(spark, folder, rows_of):
    parts = _parts(spark, folder)
    broken = X.workbook_rejects(parts)
    assert rows_of(_short(broken), "file_path") == [("broken.xlsx",)]
    properties = {r.property: r.value for r in X.workbook_properties(parts).filter(F.col("file_path").endswith("one.xlsx")).collect()}
    assert len(properties) == 11
    assert properties["Title"] == "One" and properties["Author"] == "Me" and properties["Version"] == "N/A"


def test_documents(spark, folder, rows_of):
    sheets, records, rejects = P.sheet_documents(_parts(spark, folder))
    assert rows_of(_short(rejects), "file_path") == [("broken.xlsx",), ("narrow.xlsx",)]
    assert rows_of(_short(sheets), "file_path", "sheet_name", "metadata.copyright", "records") == [
        ("one.xlsx", "Table 1", "© notice", 3), ("two.xlsx", "Table 2", "© notice", 3)
    ]
    one = records.filter(F.col("sheet_name") == "Table 1").orderBy("row").collect()
    assert [r.record for r in one] == [
        {"North": "12", "2021_1": "7.5", "Note": ""}, {"2021_1": "True", "Note": "rich"}, {"2021_1": "", "Note": ""}
    ]


def _stored(spark, home):
    return {
        r.sheet_name: (Path(r.file_path).name, r.records)
        for r in store.read_sheets(spark, home).collect()
    }


def _norths(spark, home):
    return sorted(r.record["North"] for r in store.read_records(spark, home).collect() if "North" in r.record)


def test_store_replaces_documents(spark, tmp_path, rows_of):
    home = str(tmp_path / "store")
    books = tmp_path / "b"
    books.mkdir()

    def put(batch, name, sheets):
        path = write_workbook(books / name, sheets)
        files = X.scan_workbooks(spark, str(books)).filter(F.col("path").endswith(name))
        P.ingest_workbooks(files, home, batch)
        return path

    put(0, "a.xlsx", {"One": _table(1), "Two": _table(2)})
    assert _norths(spark, home) == ["1", "2"]
    put(1, "b.xlsx", {"One": _table(10)})
    assert _stored(spark, home) == {"One": ("b.xlsx", 2), "Two": ("a.xlsx", 2)}
    assert _norths(spark, home) == ["10", "2"]
    put(1, "b.xlsx", {"One": _table(10)})  # the same batch again
    assert _norths(spark, home) == ["10", "2"]
    put(2, "c.xlsx", {"Two": _table(20)})
    assert _norths(spark, home) == ["10", "20"]
    assert store.read_sheets(spark, home).filter("sheet_name = 'One'").first()._id == "06c2cea18679d64399783748fa367bdd"


def test_incomplete_documents_are_skipped(spark, tmp_path):
    empty = "struct<header: string, metadata: string, table_info: string, copyright: string>"
    sheets = spark.sql(f"""
        SELECT 'f' AS file_path, 0 AS sheet_index, 'no records' AS sheet_name,
               from_json('{{}}', '{empty}') AS metadata, CAST(NULL AS BIGINT) AS records
        UNION ALL SELECT 'f', 1, 'no metadata', CAST(NULL AS {empty}), 1L
        UNION ALL SELECT 'f', 2, 'whole', from_json('{{}}', '{empty}'), 0L""")
    records = spark.createDataFrame([], "file_path string, sheet_index int, row long, record map<string,string>")
    home = str(tmp_path / "store")
    assert store.read_sheets(spark, home).count() == 0
    store.upsert_sheets(sheets, records, home, 0)
    assert [r.sheet_name for r in store.read_sheets(spark, home).collect()] == ["whole"]
    store.upsert_sheets(sheets.filter("sheet_index = 2").withColumn("file_path", F.lit("g")), records, home, 1,
                        key=("file_path", "sheet_name"))
    assert store.read_sheets(spark, home).count() == 2


def test_watched_folder(spark, folder, tmp_path):
    home, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def run():
        query = T.start_watch(spark, str(folder), home, checkpoint, once=True)
        query.awaitTermination(300)
        assert query.exception() is None

    run()
    assert _stored(spark, home) == {"Table 1": ("one.xlsx", 3), "Table 2": ("two.xlsx", 3)}
    run()  # nothing new
    write_workbook(folder / "deep" / "later.xlsx", {"Table 2": _table(5)})
    run()
    assert _stored(spark, home) == {"Table 1": ("one.xlsx", 3), "Table 2": ("later.xlsx", 2)}


def test_changed_files_are_ingested_again(spark, folder, tmp_path):
    home = str(tmp_path / "store")
    assert P.ingest_changed(spark, str(folder), home) == 0
    assert P.ingest_changed(spark, str(folder), home) is None
    path = write_workbook(folder / "one.xlsx", {"Table 1": _table(77)})
    os.utime(path, (2_000_000_000, 2_000_000_000))
    assert P.ingest_changed(spark, str(folder), home) is not None
    assert "77" in _norths(spark, home)
    assert P.ingest_changed(spark, str(folder), home) is None


def test_assessment(spark, tmp_path, rows_of):
    books = tmp_path / "books"
    books.mkdir()
    dense = [["Key", "Value"], ["a", None], [None, "1"], ["b", "2"], ["b", "2"], [None, None]]
    sparse = [["Key", "Value"], ["a"], *[[None, None]] * 8, *[["skipped", "s"]] * 10]
    write_workbook(books / "good.xlsx", {"empty": [["Key", "Value"]], "data": dense, "odd": [["x", "y", "z"]]}, {"title": "T"})
    write_workbook(books / "odd.xlsx", {"odd": [["x", "y", "z"], [1, 2, 3]], "data": dense})
    write_workbook(books / "dates.xlsx", {"data": [["Key", "Value"], ["day", Date(44562)]], "s": sparse})
    (books / "bad.xlsx").write_bytes(b"zip?")
    out = P.assess_workbooks(spark, str(books), str(tmp_path / "out"))
    assert rows_of(_short(out["rejects"]), "file_path") == [("bad.xlsx",), ("odd.xlsx",)]
    assert rows_of(_short(out["rows"], "file").filter("file = 'good.xlsx'"), "sheet", "row", "key", "value") == [
        ("data", 1, "a", "1"), ("data", 2, None, "1"), ("data", 3, "b", "2"), ("data", 4, "b", "2")
    ]
    assert rows_of(_short(out["missing_values"], "file")) == [("dates.xlsx", 0), ("good.xlsx", 1)]
    assert rows_of(_short(out["duplicate_rows"], "file")) == [("dates.xlsx", 0), ("good.xlsx", 1)]
    assert {r.file_path.rsplit("/", 1)[-1]: len(r.missing_keys) for r in out["missing_keys"].collect()} == {
        "good.xlsx": 10, "odd.xlsx": 11, "dates.xlsx": 11
    }
    lines = [json.loads(t) for p in (tmp_path / "out" / "records").glob("workbook=good-*/*.json") for t in p.read_text().splitlines()]
    assert ("a", "1") in {(line["Key"], line["Value"]) for line in lines} and len(lines) == 4
    assert '"2022-01-01T00:00:00.000"' in "".join(
        p.read_text() for p in (tmp_path / "out" / "records").glob("workbook=dates-*/*.json")
    )


def _stream(spark, log, gate, checkpoint, out):
    observed = spark.readStream.schema("path string, ts timestamp, sha256 string").parquet(log)
    query = gate(observed).writeStream.format("parquet").option("checkpointLocation", checkpoint).option(
        "path", out).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return sorted((r.path, r.second) for r in spark.read.parquet(out).selectExpr("path", "unix_seconds(ts) AS second").collect())


def _observe(spark, log, *looks):
    spark.createDataFrame(looks, "path string, second long, sha256 string").selectExpr(
        "path", "timestamp_seconds(second) AS ts", "sha256"
    ).write.mode("append").parquet(log)


def test_streamed_gates(spark, tmp_path):
    log = str(tmp_path / "log")
    cool = (T.stream_cooldown, str(tmp_path / "c1"), str(tmp_path / "o1"))
    stable = (T.stream_stable, str(tmp_path / "c2"), str(tmp_path / "o2"))
    _observe(spark, log, ("a", 0, "x"), ("a", 200, "x"), ("a", 300, "y"), ("b", 250, "x"))
    assert _stream(spark, log, *cool) == [("a", 0), ("a", 300), ("b", 250)]
    assert _stream(spark, log, *stable) == [("a", 200)]
    _observe(spark, log, ("a", 590, "y"), ("a", 600, "z"), ("b", 400, "y"))
    assert _stream(spark, log, *cool) == [("a", 0), ("a", 300), ("a", 600), ("b", 250)]
    assert _stream(spark, log, *stable) == [("a", 200), ("a", 590)]


def test_observations_of_a_folder(spark, folder, tmp_path):
    log = str(tmp_path / "log")
    for _ in range(3):  # the third finds nothing to look at
        P.observe_files(spark, str(folder), log)
    assert spark.read.parquet(log).groupBy("path", "sha256").count().filter("count = 2").count() == 4
    P.observe_files(spark, str(folder), str(tmp_path / "other"), cooldown_seconds=60)
    P.observe_files(spark, str(folder), str(tmp_path / "other"), cooldown_seconds=60)
    assert spark.read.parquet(str(tmp_path / "other")).count() == 4


def test_half_written_files_wait(spark, tmp_path):
    books, home, log = tmp_path / "b", str(tmp_path / "store"), str(tmp_path / "log")
    books.mkdir()
    whole = Path(write_workbook(tmp_path / "x.xlsx", {"One": _table(1)})).read_bytes()
    (books / "x.xlsx").write_bytes(whole[: len(whole) // 2])
    run = lambda: P.ingest_stable(spark, str(books), home, log, cooldown_seconds=0)
    assert run() is None
    (books / "x.xlsx").write_bytes(whole)
    os.utime(books / "x.xlsx", (2_000_000_000, 2_000_000_000))
    assert run() is None
    assert run() == 0
    assert _stored(spark, home) == {"One": ("x.xlsx", 2)}
    assert run() is None


def test_writers_do_not_lose_documents(spark, tmp_path):
    home, books = str(tmp_path / "store"), tmp_path / "books"
    for n in range(5):
        (books / f"f{n}").mkdir(parents=True)
        write_workbook(books / f"f{n}" / "book.xlsx", {f"Sheet {n}": _table(n), "Shared": _table(100 + n)})
    for n in range(2):  # two checkpoints, both with a batch 0
        query = T.start_watch(spark, str(books / f"f{n}"), home, str(tmp_path / f"checkpoint{n}"), once=True)
        query.awaitTermination(300)
        assert query.exception() is None
    for n in (2, 3, 4):
        P.ingest_changed(spark, str(books / f"f{n}"), home)
    assert _norths(spark, home) == ["0", "1", "104", "2", "3", "4"]
    P.ingest_workbooks(P.load_workbooks(spark, [str(books / "f0" / "book.xlsx")]), home, 0, "listing")  # a batch repeated late
    write_workbook(books / "f0" / "new.xlsx", {"Later": _table(9)})
    P.ingest_workbooks(P.load_workbooks(spark, [str(books / "f0" / "new.xlsx")]), home, 0, "another")
    assert _norths(spark, home) == ["0", "1", "104", "2", "3", "4", "9"]
    assert _stored(spark, home)["Shared"][1] == 2


def test_names_with_pattern_characters(spark, tmp_path):
    path = write_workbook(tmp_path / "a[1]{b}*,.xlsx", {"One": _table(1)})
    assert P.load_workbooks(spark, [f"file:{path}"]).count() == 1


def test_records_of_equal_names_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"/in/{d}/x.xlsx", 0, "s", r, f"{d}{r}", None) for d in "ab" for r in range(50)],
        "file string, sheet_index int, sheet string, row long, key string, value string",
    ).repartition(3)
    P.write_records_json(rows, str(tmp_path / "out"))
    folders = sorted((tmp_path / "out").glob("workbook=*"))
    assert len(folders) == 2
    for folder in folders:
        lines = [json.loads(t) for p in sorted(folder.glob("*.json")) for t in p.read_text().splitlines()]
        assert len({line["file"] for line in lines}) == 1 and [line["row"] for line in lines] == list(range(50))


def test_sheet_key(spark):
    frame = spark.createDataFrame([("Table 1",)], "sheet_name string")
    import hashlib
    assert frame.select(S.sheet_key()).first()[0] == hashlib.md5(b"Table 1").hexdigest()


def test_gates_take_looks_in_the_order_of_their_times(spark, tmp_path):
    """Looks come out of order within the lateness allowed; the last one moves the watermark on."""
    looks = [("a", t, "x" if t % 4 else "y") for t in range(0, 3000, 50)]
    random.Random(4).shuffle(looks)
    batch = spark.createDataFrame(looks, "path string, second long, sha256 string").selectExpr("path", "timestamp_seconds(second) AS ts", "sha256")
    for gate, plain, name in (
        (lambda s: T.stream_cooldown(s, 300, late="1 hour"), W.cooldown(batch, 300), "cool"),
        (lambda s: T.stream_stable(s, late="1 hour"), W.stable_files(batch), "stable"),
    ):
        log = str(tmp_path / name)
        for k in range(0, len(looks), 20):
            _observe(spark, log, *looks[k : k + 20])
        _observe(spark, log, ("end", 100_000, "z"))
        found = _stream(spark, log, gate, str(tmp_path / f"{name}-checkpoint"), str(tmp_path / f"{name}-out"))
        expected = sorted((r.path, int(r.second)) for r in plain.selectExpr("path", "unix_seconds(ts) AS second").collect())
        assert [f for f in found if f[0] != "end"] == expected


def test_a_stable_path_is_forgotten(spark, tmp_path):
    log = str(tmp_path / "log")
    gate = lambda s: T.stream_stable(s, forget_seconds=100)
    run = lambda: _stream(spark, log, gate, str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    _observe(spark, log, ("a", 0, "x"), ("b", 0, "x"))
    run()
    _observe(spark, log, ("b", 90, "x"), ("c", 150, "x"))
    assert run() == [("b", 90)]
    _observe(spark, log, ("c", 160, "y"))
    run()
    _observe(spark, log, ("a", 180, "x"), ("b", 185, "x"), ("c", 400, "z"))
    assert run() == [("b", 90), ("b", 185)]  # a was forgotten at 100, b not before 190


def test_live_watch_waits_for_whole_files_and_sees_rewrites(spark, tmp_path):
    books, home = tmp_path / "b", str(tmp_path / "store")
    books.mkdir()
    whole = Path(write_workbook(tmp_path / "x.xlsx", {"One": _table(1)})).read_bytes()
    (books / "x.xlsx").write_bytes(whole[: len(whole) // 2])
    query = T.start_watch_stable(spark, str(books), home, str(tmp_path / "log"), str(tmp_path / "checkpoint"), "1 second", cooldown_seconds=0)

    def wait(expected):
        end = time.monotonic() + 120
        while time.monotonic() < end and query.isActive:
            try:
                if os.path.exists(f"{home}/sheets") and _norths(spark, home) == expected:
                    return
            except Exception:  # folders are being replaced
                pass
            time.sleep(1)
        raise AssertionError(query.exception())

    try:
        (books / "x.xlsx").write_bytes(whole)
        os.utime(books / "x.xlsx", (1_900_000_000, 1_900_000_000))
        wait(["1"])
        os.utime(write_workbook(books / "x.xlsx", {"One": _table(2)}), (2_000_000_000, 2_000_000_000))
        wait(["2"])
    finally:
        query.stop()
    assert _stored(spark, home) == {"One": ("x.xlsx", 2)}
