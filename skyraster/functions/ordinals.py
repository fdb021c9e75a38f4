"""Running totals and ordinals that never sort one large group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """Sum of ``weight`` over the rows before this one.  For small (already aggregated) tables."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(weight).over(frame), F.lit(0)).cast("long"))


def running_offset(
    df: DataFrame,
    keys: list[str],
    buckets: list[str],
    order: list[str],
    weight: Column | None = None,
    name: str = "ord",
    total: str | None = None,
) -> DataFrame:
    """Running total of ``weight`` (default: row ordinal from 0) inside each ``keys`` group.

    ``buckets`` are columns that split a group into bounded slices and sort in front of ``order``.
    Slice totals are aggregated map-side and summed up over slices; rows are then ordered inside
    their slice only, so a group that holds a large share of all rows is spread over many tasks.
    ``total`` optionally names a column with the total of the whole group.
    """
    weight = F.lit(1) if weight is None else weight
    weighted = df.withColumn("_weight", weight.cast("long"))
    slices = weighted.groupBy(*keys, *buckets).agg(F.sum("_weight").alias("_slice"))
    slices = running_total(slices, keys, buckets, F.col("_slice"), "_before")
    if total:
        slices = slices.withColumn(total, F.sum("_slice").over(Window.partitionBy(*keys)))
    joined = weighted.join(slices.drop("_slice"), [*keys, *buckets])
    frame = Window.partitionBy(*keys, *buckets).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_weight").over(frame), F.lit(0))
    return joined.withColumn(name, (F.col("_before") + inside).cast("long")).drop("_weight", "_before")
