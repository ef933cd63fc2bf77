"""Weather queries: date filter, page, averages, cities and field checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions.dates import iso_utc

DEFAULT_LIMIT = 10  # fixed value: rows of a page when no limit is given

# Fields that must not be null.
REQUIRED_FIELDS = [
    "dt", "dt_iso", "timezone", "main", "main.temp", "main.temp_min", "main.temp_max",
    "main.feels_like", "main.pressure", "main.humidity", "main.dew_point", "clouds",
    "clouds.all", "weather", "weather.id", "weather.main", "weather.description",
    "weather.icon", "wind", "wind.speed", "wind.deg", "lat", "lon", "city_name",
]
INT_RANGE = (-(2**31), 2**31 - 1)


def in_dates(start: str | None = None, end: str | None = None, no_dates: str = "empty") -> Column:
    """``dt_iso`` within the given dates, both ends included, compared as text.

    An empty date counts as absent. Without any date nothing matches, unless
    ``no_dates="all"``.
    """
    if no_dates not in ("empty", "all"):
        raise ValueError("no_dates is 'empty' or 'all'")
    dt_iso = F.col("dt_iso")
    if start and end:
        return dt_iso.between(iso_utc(start), iso_utc(end))
    if start:
        return dt_iso >= iso_utc(start)
    if end:
        return dt_iso <= iso_utc(end)
    return F.lit(no_dates == "all")


def of_city(
    rows: DataFrame, city: str, start: str | None = None, end: str | None = None, no_dates: str = "empty"
) -> DataFrame:
    """Observations of one city in a date range. Both filters reach the scan."""
    return rows.filter((F.col("city") == city) & in_dates(start, end, no_dates))


def with_rain_duration(rows: DataFrame) -> DataFrame:
    """Rename ``rain.1h`` to ``rain.duration_1h``; a missing, zero or NaN amount gives a null ``rain``."""
    amount = F.col("rain.1h")
    named = [f.name for f in rows.schema["rain"].dataType.fields]
    present = F.when(amount.isNotNull() & (amount != 0) & ~F.isnan(amount), amount)
    if "duration_1h" in named:
        present = F.coalesce(present, F.col("rain.duration_1h"))
    return rows.withColumn("rain", F.when(present.isNotNull(), F.struct(present.alias("duration_1h"))))


def select_fields(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keep the listed dotted fields, nested as they were; the scan reads nothing else.

    ``select_fields(rows, ["dt", "main.temp", "main.humidity"])`` gives
    ``dt, main struct<temp, humidity>``. Inside lists a field is taken from
    every element.
    """
    wanted: dict[str, list[str]] = {}
    for field in fields:
        top, _, leaf = field.partition(".")
        wanted.setdefault(top, [])
        if leaf:
            wanted[top].append(leaf)

    def part(top: str, leaves: list[str]) -> Column:
        if not leaves:
            return F.col(top)
        if rows.schema[top].dataType.typeName() == "array":
            return F.transform(top, lambda e: F.struct(*[e[leaf].alias(leaf) for leaf in leaves])).alias(top)
        nested = F.struct(*[F.col(f"{top}.{leaf}").alias(leaf) for leaf in leaves])
        return F.when(F.col(top).isNotNull(), nested).alias(top)

    return rows.select(*[part(top, leaves) for top, leaves in wanted.items()])


def page(
    rows: DataFrame,
    limit: int | None = DEFAULT_LIMIT,
    skip: int | None = 0,
    tie_keys: Sequence[str] = (),
    after: Sequence | None = None,
) -> DataFrame:
    """Rows ``skip .. skip + limit`` in ``dt_iso`` order (nulls first), ties broken by ``tie_keys``.

    No limit or 0 means :data:`DEFAULT_LIMIT`. For pages deep in the data give ``after``, the ``dt_iso`` and
    ``tie_keys`` of the last row of the page before: it becomes a filter that reaches the scan.
    """
    limit = limit or DEFAULT_LIMIT
    skip = skip or 0
    if limit < 0 or skip < 0:
        raise ValueError("limit and skip must not be negative")
    names = ["dt_iso", *tie_keys]
    if after is not None:
        if len(after) != len(names):
            raise ValueError("after needs a value for dt_iso and for each of tie_keys")
        rows = rows.filter(_behind(names, list(after)))
    return rows.orderBy(*[F.col(n).asc() for n in names]).offset(skip).limit(limit)


def _behind(names: list[str], values: list) -> Column:
    """Rows that come after ``values`` in ascending order, nulls first."""
    column, value = F.col(names[0]), values[0]
    beyond = column.isNotNull() if value is None else column > F.lit(value)
    if len(names) == 1:
        return beyond
    level = column.isNull() if value is None else column == F.lit(value)
    inner = beyond | (level & _behind(names[1:], values[1:]))
    # Implied by the rest, and simple enough to be pushed to the scan.
    return inner if value is None else inner & (column >= F.lit(value))


def get_weather(
    rows: DataFrame,
    city: str,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = DEFAULT_LIMIT,
    skip: int | None = 0,
    fields: Sequence[str] | None = None,
    tie_keys: Sequence[str] = (),
    no_dates: str = "empty",
) -> DataFrame:
    """One page of a city's observations with ``rain`` renamed, cut to ``fields`` if given."""
    found = of_city(rows, city, start, end, no_dates)
    paged = page(found, limit, skip, tie_keys)
    if "rain" in paged.columns:
        paged = with_rain_duration(paged)
    return select_fields(paged, fields) if fields else paged


def average(rows: DataFrame, field: str) -> DataFrame:
    """Mean of a dotted field, named by its last part, and the row count.

    The mean ignores missing values, the count does not.
    """
    name = field.split(".")[-1]
    return rows.agg(F.avg(field).alias(name), F.count(F.lit(1)).alias("count"))


def _guarded(rows: DataFrame, field: str, name: str) -> DataFrame:
    result = average(rows, field)
    mean = F.col(field.split(".")[-1])
    void = mean.isNull() | (mean == 0) | F.isnan(mean)
    return result.select(
        F.when(void, F.lit(0.0)).otherwise(mean).alias(name),
        F.when(void, F.lit(0).cast("long")).otherwise(F.col("count")).alias("count"),
    )


def average_temperature(
    rows: DataFrame, city: str, start: str | None = None, end: str | None = None, no_dates: str = "empty"
) -> DataFrame:
    """``averageTemperature, count``; both are 0 when the mean is absent, NaN or 0."""
    return _guarded(of_city(rows, city, start, end, no_dates), "main.temp", "averageTemperature")


def average_feels_like(
    rows: DataFrame, city: str, start: str | None = None, end: str | None = None, no_dates: str = "empty"
) -> DataFrame:
    """``averageFeelsLike, count``; both are 0 when the mean is absent, NaN or 0."""
    return _guarded(of_city(rows, city, start, end, no_dates), "main.feels_like", "averageFeelsLike")


def all_cities(rows: DataFrame) -> DataFrame:
    """Names of the cities that have observations."""
    return rows.select("city").distinct()


def required_violations(rows: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """``field, violations`` over all required fields, in one pass.

    A row violates a field if it is null, or if one element of a list lacks
    it. A field inside an absent parent counts for the parent only.
    ``dt`` beyond 32 bits also counts.
    """

    def violated(field: str) -> Column:
        top, _, leaf = field.partition(".")
        if not leaf:
            broken = F.col(top).isNull()
            return broken | ~F.col(top).between(*INT_RANGE) if field == "dt" else broken
        if rows.schema[top].dataType.typeName() == "array":
            return F.exists(top, lambda e: e[leaf].isNull())
        return F.col(top).isNotNull() & F.col(field).isNull()

    counts = rows.agg(*[F.count_if(violated(f)).alias(f"v{i}") for i, f in enumerate(fields)])
    return counts.select(
        F.inline(
            F.array(*[
                F.struct(F.lit(f).alias("field"), F.col(f"v{i}").alias("violations"))
                for i, f in enumerate(fields)
            ])
        )
    )
