"""Schemas of the data shapes."""

from __future__ import annotations

from pyspark.sql import types as T

CITIES = T.StructType([
    T.StructField("locations", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("country", T.StringType()),
    ]))),
])

# ``dt`` is read wider than its 32 bits, so that an overflow can be counted
# instead of turning into a null.
WEATHER = T.StructType([
    T.StructField("dt", T.LongType()),
    T.StructField("dt_iso", T.StringType()),
    T.StructField("timezone", T.IntegerType()),
    T.StructField("main", T.StructType([
        T.StructField("temp", T.DoubleType()),
        T.StructField("temp_min", T.DoubleType()),
        T.StructField("temp_max", T.DoubleType()),
        T.StructField("feels_like", T.DoubleType()),
        T.StructField("pressure", T.IntegerType()),
        T.StructField("humidity", T.IntegerType()),
        T.StructField("dew_point", T.DoubleType()),
    ])),
    T.StructField("clouds", T.StructType([T.StructField("all", T.IntegerType())])),
    T.StructField("weather", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("main", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("icon", T.StringType()),
    ]))),
    T.StructField("rain", T.StructType([
        T.StructField("1h", T.DoubleType()),
        T.StructField("duration_1h", T.DoubleType()),
    ])),
    T.StructField("wind", T.StructType([
        T.StructField("speed", T.DoubleType()),
        T.StructField("deg", T.IntegerType()),
    ])),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("city_name", T.StringType()),
])

BINARY_FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

# One record per sheet row (arrays end at the last cell that holds a value), per
# sheet (its extent, the four cells of its heading and, as values, its header
# row), per document property and per file that fails to open.
WORKBOOK_PARTS = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("part", T.StringType()),
    T.StructField("sheet_index", T.IntegerType()),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("dtypes", T.ArrayType(T.StringType())),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_cols", T.IntegerType()),
    T.StructField("heading", T.ArrayType(T.StringType())),
    T.StructField("name", T.StringType()),
    T.StructField("text", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

POLICY = T.StructType([
    T.StructField("excluded_directories", T.ArrayType(T.StringType())),
    T.StructField("excluded_extensions", T.ArrayType(T.StringType())),
])
