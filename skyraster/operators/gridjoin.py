"""Range joins on grid cells.

A range-only join would be planned as a nested loop.  Here every row of the build side gets one
cell per dimension, every row of the probe side the few cells its range touches, and Spark joins
on the cells; the exact condition is part of the join.  A build row has one cell, so every matching
pair appears exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import cell_of
from ..session import materialize_counted

#: A cell in which more pairs than the square of this meet is cut into slices of so many rows a side.
HOT_ROWS = 20_000
#: The table of hot cells is broadcast up to this many rows (about 50 bytes each).
BROADCAST_HOT_ROWS = 200_000


@dataclass(frozen=True)
class GridDim:
    """One dimension: probe range [low, high], build value, cell size in the same unit (a number, or a
    column that both sides have under their own name: probe, build)."""

    low: Column
    high: Column
    value: Column
    size: int | tuple[str, str]


def _slices(rows: Column, hot_rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(hot_rows))).cast("int")


def grid_join(
    probe: DataFrame,
    build: DataFrame,
    dims: list[GridDim],
    condition: Column,
    equal: list[tuple[str, str]] | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Pairs of probe and build rows whose build values fall in the probe ranges.

    ``equal`` adds plain equality keys (probe column, build column).  Column names of the two
    sides must differ.  With ``hot_rows`` the rows per cell are counted first and crowded cells are
    split into slices on both sides; ``None`` leaves skew to adaptive execution, which is what a
    stream or a bounded selection needs.  Build rows, which have one cell each, are counted first:
    probe rows are only counted in cells that would be crowded if all of them met there.
    """
    left, right = probe, build
    keys = []
    for i, (p, b) in enumerate(equal or []):
        left, right = left.withColumn(f"_p{i}", F.col(p)), right.withColumn(f"_b{i}", F.col(b))
        keys.append((f"_p{i}", f"_b{i}"))
    for i, dim in enumerate(dims, start=len(keys)):
        own, other = [F.col(s) for s in dim.size] if isinstance(dim.size, tuple) else [dim.size] * 2
        left = left.withColumn(f"_p{i}", F.explode(F.sequence(cell_of(dim.low, own), cell_of(dim.high, own))))
        right = right.withColumn(f"_b{i}", cell_of(dim.value, other))
        keys.append((f"_p{i}", f"_b{i}"))
    if hot_rows is not None:
        left, right, keys = _slice_hot(left, right, keys, hot_rows, probe.count())
    on = condition
    for p, b in keys:
        on = on & (F.col(p) == F.col(b))
    return left.join(right, on).drop(*[name for pair in keys for name in pair])


def _slice_hot(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], hot_rows: int, probes: int):
    """Split crowded cells: a slice of one side meets every slice of the other side.  ``probes`` rows
    at most lie in one cell of the left side."""
    names = [f"_k{i}" for i in range(len(keys))]
    limit = float(hot_rows) ** 2

    def counted(side: DataFrame, columns: list[str], into: str) -> DataFrame:
        return side.groupBy(*[F.col(c).alias(n) for c, n in zip(columns, names)]).agg(F.count(F.lit(1)).alias(into))

    dense = counted(right, [b for _, b in keys], "_nr").filter(F.col("_nr") * F.lit(float(probes)) > limit)
    dense, seen = materialize_counted(dense, "dense-cells")
    if seen["rows"] == 0:
        return left, right, keys
    few = F.broadcast(dense) if seen["rows"] <= BROADCAST_HOT_ROWS else dense
    met = None
    for (p, _), name in zip(keys, names):
        term = F.col(p) == F.col(name)
        met = term if met is None else met & term
    hot = (
        counted(left.join(few.select(*names), met, "left_semi"), [p for p, _ in keys], "_nl")
        .join(few, names)
        .filter(F.col("_nl").cast("double") * F.col("_nr") > limit)
        .select(*names, _slices(F.col("_nl"), hot_rows).alias("_sl"), _slices(F.col("_nr"), hot_rows).alias("_sr"))
    )
    hot, seen = materialize_counted(hot, "hot-cells")
    if seen["rows"] == 0:
        return left, right, keys
    if seen["rows"] <= BROADCAST_HOT_ROWS:
        hot = F.broadcast(hot)

    def spread(side: DataFrame, columns: list[str], own: str, other: str, mine: str, theirs: str) -> DataFrame:
        match = None
        for column, name in zip(columns, names):
            term = F.col(column) == F.col(name)
            match = term if match is None else match & term
        joined = side.join(hot, match, "left")
        # A hash of the row, not a random number: a recomputed task must choose the same slice.
        pick = F.pmod(F.xxhash64(*side.columns), F.coalesce(F.col(own), F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        return joined.withColumn(mine, pick).withColumn(theirs, F.explode(every)).drop(*names, "_sl", "_sr")

    left = spread(left, [p for p, _ in keys], "_sl", "_sr", "_pl", "_pr")
    right = spread(right, [b for _, b in keys], "_sr", "_sl", "_br", "_bl")
    return left, right, [*keys, ("_pl", "_bl"), ("_pr", "_br")]
