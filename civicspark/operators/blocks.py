"""Neighbouring rows without putting a whole group into one task.

``lead`` and ``lag`` over ``partitionBy(group)`` send a group to a single
task. Here a group is cut into blocks by its order column, each block is a
window partition of its own, and only one row per block is carried over to
the next block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbour(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: Column,
    name: str,
    step: int,
) -> DataFrame:
    """Add ``name``: ``value`` of the next (``step=1``) or the previous (``step=-1``) row of the group.

    ``block`` must not decrease along ``order``. ``value`` must not be null
    (wrap it in a struct), so that null means there is no such row. The group
    columns hold no nulls.
    """
    shift, other = (F.lead, F.lag) if step > 0 else (F.lag, F.lead)
    keys, spare = [*group, "_block"], "_row"
    # Both sides of the join below take all columns from one window, so Spark works it out once and reads its exchange twice.
    whole = F.struct(*rows.columns, value.alias("_value"))
    within = Window.partitionBy(*keys).orderBy(*[f"_by{k}" for k in range(len(order))])
    cut = (
        rows.select(*group, block.alias("_block"), whole.alias(spare), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(order)])
        .withColumn("_near", shift(spare).over(within))
        .withColumn("_outer", other(F.lit(1)).over(within).isNull())
    )
    edges = cut.filter("_outer").select(*keys, F.col(spare).alias("_edge"))
    across = edges.select(*keys, shift("_edge").over(Window.partitionBy(*group).orderBy("_block")).alias("_far"))
    return (
        cut.join(across, keys, "left")
        .select(*[F.col(spare)[c].alias(c) for c in rows.columns], F.coalesce("_near", "_far")["_value"].alias(name))
    )
