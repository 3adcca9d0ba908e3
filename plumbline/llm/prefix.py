"""Sums of the rows before each row, over a whole table or within groups of any size."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch


def prefix_sums(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    scratch: Scratch,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Add to each row, within its group in the given order: `start` (sum of `value` before it),
    `position` (number of rows before it), `total` and `rows` (of the whole group).

    A range placement by (groups, order, row number) cuts hot groups, and runs of equal rows, over
    partitions; each partition's totals, a row per partition and group, give its offset. Group
    columns must not be null. Rows equal in `order` are interchangeable: callers put a hash of
    whatever else matters last in `order`.
    """
    groups, order = list(groups), list(order)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = scratch.save(
        tied.repartitionByRange(*groups, *order, "_tie").withColumn("_part", F.spark_partition_id())
    )
    key = ["_part", *groups]
    totals = placed.groupBy(*key).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy()
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *key,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_position"),
        F.sum("_sum").over(whole).alias("total"),
        F.sum("_rows").over(whole).alias("rows"),
    )
    inside = Window.partitionBy(*key).orderBy(*order, "_tie")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        "*",
        F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_own_start"),
        (F.row_number().over(inside) - 1).alias("_own_position"),
    )
    return local.join(offsets, key).select(
        *df.columns,
        (F.col("_start") + F.col("_own_start")).alias("start"),
        (F.col("_position") + F.col("_own_position")).alias("position"),
        "total",
        "rows",
    )
