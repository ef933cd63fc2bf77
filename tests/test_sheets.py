import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicspark.operators import keyvalue as K
from civicspark.operators import quality as Q
from civicspark.operators import sheets as S

ROWS = "file_path string, sheet_index int, sheet_name string, row long, values array<string>"

REGIONS = [
    [None, "Bureau heading"],
    ["series info"],
    ["table title"],
    [],
    ["Region", "2021", "2021"],
    ["units"],
    ["North", "12"],
    ["South", None, "9"],
    ["© notice"],
]


def _rows(spark, sheets):
    """``sheets``: (file, index, name, rows)."""
    return spark.createDataFrame(
        [(f, i, n, r, values) for f, i, n, rows in sheets for r, values in enumerate(rows)], ROWS
    )


def test_metadata_and_records(spark):
    rows = _rows(spark, [("f", 0, "Table 1", REGIONS)])
    extents = S.extents_of(rows)
    assert tuple(extents.first()) == ("f", 0, "Table 1", 9, 3)
    sheets = S.accepted_sheets(extents)
    assert tuple(S.sheet_metadata(rows, sheets).first()) == (
        "f", 0, "Table 1", "Bureau heading", "series info", "table title", "© notice"
    )
    assert S.header_names(rows, sheets).first().names == ["Region", "2021", "2021_1"]
    records = [r.record for r in S.sheet_records(rows, sheets).orderBy("row").collect()]
    assert records == [{"North": "12", "2021_1": ""}, {"2021_1": "9"}, {"2021_1": ""}]
    assert S.sheet_records(rows, sheets, drop_footer=True).count() == 2


def test_a_column_named_like_the_key_wins(spark):
    sheet = [["", "h"], ["m"], ["t"], [], ["Name", "n", "North", None], ["u"], ["North", "12", "13"], ["x", "1", None, "4"]]
    rows = _rows(spark, [("f", 0, "s", sheet)])
    records = [r.record for r in S.sheet_records(rows, S.accepted_sheets(S.extents_of(rows))).orderBy("row").collect()]
    assert records == [{"North": "13", "nan": ""}, {"x": "1", "North": "", "nan": "4"}]


def test_last_row_without_first_cell_gives_no_copyright(spark):
    rows = _rows(spark, [("f", 0, "s", [*REGIONS[:7], [None, "x"], [None, None]])])
    extents = S.extents_of(rows)
    assert extents.first().n_rows == 8
    assert S.sheet_metadata(rows, S.accepted_sheets(extents)).first().copyright is None


def test_one_small_sheet_rejects_the_file(spark, rows_of):
    rows = _rows(spark, [
        ("good", 0, "Contents", [["only"]]), ("good", 1, "a", REGIONS),
        ("narrow", 0, "a", REGIONS), ("narrow", 1, "b", [[r[0] if r else None] for r in REGIONS]),
        ("short", 0, "a", REGIONS[:4]), ("short", 1, "b", REGIONS),
        ("header-only", 0, "a", REGIONS[:5]),
    ])
    extents = S.extents_of(rows)
    assert rows_of(S.sheet_rejects(extents)) == [("narrow", "one column: b"), ("short", "no header row: a")]
    sheets = S.accepted_sheets(extents, spark.createDataFrame([("header-only", "damaged")], "file_path string, reason string"))
    assert rows_of(sheets, "file_path", "sheet_name") == [("good", "a")]
    again = S.accepted_sheets(extents)
    assert rows_of(S.sheet_records(rows, again).groupBy("file_path").count()) == [("good", 3)]


def _unique(names):
    taken = {}
    for name in names:
        candidate, number = name, 0
        while candidate in taken:
            number += 1
            candidate = f"{name}_{number}"
        taken[candidate] = True
    return list(taken)


def test_unique_names(spark):
    chance = random.Random(4)
    headers = [["a", "a_1", "a"], ["a", "a", "a_1"], ["nan"] * 5, [], ["a_1", "a", "a", "a_1", "a"], ["x", "y"]]
    headers += [[chance.choice(["a", "b", "a_1", "a_1_1", "b_2", "nan"]) for _ in range(chance.randint(1, 9))] for _ in range(300)]
    headers.append(["nan"] * 3000)
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, names array<string>")
    for row in frame.select("i", S.unique_names(F.col("names")).alias("unique")).collect():
        assert row.unique == _unique(headers[row.i])


def test_numeric_keys(spark, rows_of):
    rows = spark.createDataFrame([
        (1, ["1", "a"], ["int", "str"]), (2, ["1.5", "a"], ["float", "str"]), (3, ["x", "a"], ["str", "str"]),
        (4, ["2", None], ["int", None]), (5, ["True", "b"], ["bool", "str"]), (6, ["3"], ["int"]), (7, [], []),
    ], "row int, values array<string>, dtypes array<string>")
    assert rows_of(S.numeric_key_rows(rows), "row") == [(1,), (2,), (5,)]


def test_latest_per_key_with_a_hot_key(spark, rows_of):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k",
                                        "id * 7919 % 3001 AS place", "id AS v")
    newest = {}
    for r in rows.collect():
        if r.k not in newest or r.place > newest[r.k][0]:
            newest[r.k] = (r.place, r.v)
    assert rows_of(S.latest_per_key(rows, ["k"], ["place"]), "k", "v") == sorted(
        ((k, v) for k, (_, v) in newest.items()), key=repr
    )


KV = "file string, sheet_index int, sheet string, row long, key string, value string"


def _kv(spark, *rows):
    return spark.createDataFrame([("f", 0, "s", *r) for r in rows], KV)


def test_split_values_are_merged(spark, rows_of):
    kv = _kv(spark, (1, "k", None), (2, None, "v"), (3, "a", None), (4, "b", None), (5, None, None), (6, None, "w"),
             (7, "last", None))
    merged = K.merge_split_values(K.drop_blank(kv))
    assert rows_of(merged, "row", "key", "value") == [
        (1, "k", "v"), (2, None, "v"), (3, "a", None), (4, "b", "w"), (6, None, "w"), (7, "last", None)
    ]


@pytest.mark.parametrize("block", [1, 3, 7, 100_000])
def test_merge_does_not_depend_on_blocks(spark, rows_of, block):
    chance = random.Random(block)
    rows = []
    for file, size in (("hot", 300), ("a", 20), ("b", 1)):
        for row in sorted(chance.sample(range(size * 4), size)):
            rows.append((file, 0, "s", row, chance.choice([None, "k"]), chance.choice([None, "v", "w"])))
    kv = spark.createDataFrame(rows, KV)
    expected = []
    for here, after in zip(rows, [*rows[1:], None]):
        value = here[5]
        if here[4] and value is None and after and after[0] == here[0] and after[4] is None:
            value = after[5]
        expected.append((*here[:5], value))
    assert rows_of(K.merge_split_values(kv, block)) == sorted(expected, key=repr)


def test_rows_read_from_a_sheet(spark, rows_of):
    rows = _rows(spark, [
        ("f", 0, "s", [["Key", "Value"], *[[f"k{i}", f"v{i}"] for i in range(1, 25)]]),
        ("f", 1, "wide", [["a", "b", "c"]]),
    ])
    kv = K.kv_rows(rows, S.extents_of(rows))
    assert sorted(r.row for r in kv.collect()) == [*range(1, 10), *range(20, 25)]


def test_density_and_first_dense_sheet(spark, rows_of):
    def sheet(index, filled, total):
        return [("f", index, f"s{index}", i, "k" if i < filled else None, None) for i in range(total)]

    kv = spark.createDataFrame([*sheet(0, 2, 5), *sheet(1, 3, 5), *sheet(2, 5, 5), ("none", 0, "s", 1, None, None)], KV)
    assert rows_of(K.sheet_density(kv), "sheet", "density") == [("s", 0.0), ("s0", 0.2), ("s1", 0.3), ("s2", 0.5)]
    assert rows_of(K.first_dense_sheet(kv)) == [("f", 1)]


def test_sheets_of_another_width_reject_the_file_if_they_are_reached(spark, rows_of):
    extents = spark.createDataFrame([
        ("before", 0, "odd", 5, 3), ("before", 1, "kv", 5, 2),
        ("after", 0, "kv", 5, 2), ("after", 1, "odd", 5, 3),
        ("sparse", 0, "kv", 5, 2), ("sparse", 1, "odd", 5, 1),
    ], "file_path string, sheet_index int, sheet_name string, n_rows long, n_cols int")
    first = spark.createDataFrame([("before", 1), ("after", 0)], "file string, sheet_index int")
    assert rows_of(K.kv_rejects(extents, first)) == [("before", "3 columns: odd"), ("sparse", "1 columns: odd")]


def test_quality_counts_equal_pandas(spark, rows_of):
    chance = random.Random(9)
    rows = [(chance.choice("xyz"), chance.choice(["a", "b", None]), chance.choice([1.0, None, float("nan")])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "g string, a string, b double")
    local = pd.DataFrame(rows, columns=["g", "a", "b"])
    assert Q.missing_values(frame, ["a", "b"]).first()[0] == local[["a", "b"]].isnull().sum().sum()
    assert Q.missing_values(frame.limit(0), ["a"]).first()[0] == 0
    texts = frame.select("g", "a")
    assert Q.duplicate_rows(texts, ["g", "a"]).first()[0] == local[["g", "a"]].duplicated().sum()
    assert rows_of(Q.duplicate_rows(texts, ["a"], ["g"])) == sorted(
        ((g, int(p[["a"]].duplicated().sum())) for g, p in local.groupby("g")), key=repr
    )
    assert Q.duplicate_rows(texts.limit(0), ["g"]).first()[0] == 0


def test_missing_properties(spark, rows_of):
    frame = spark.createDataFrame([("f", "Title", "N/A"), ("f", "Author", "N/A"), ("g", "Title", "t")],
                                  "file_path string, property string, value string")
    assert rows_of(Q.missing_properties(frame)) == [("f", ["Author", "Title"])]
