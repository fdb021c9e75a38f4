"""Stored boxes in the order of a space-filling curve, so that a slab reads the parts of the files it lies in.

A box belongs to one cell: its level is the least at which a cell is wider than the box, its cell the one of its low
corner, so it reaches into the next cell at most.  Rows are sorted by level and the cell's number on the Hilbert
curve; a slab is cut into ranges of these numbers per level, widened by one cell to the low side.  The ranges are
a plain filter that the scan turns into skipped row groups and pages; whatever is read beyond is removed by the
exact predicate that a query puts on top.

``points`` are further points of a row (its centre) that a slab may ask for; they widen the box that is indexed,
not the stored one.  Rows without a box are kept, but lie in no slab.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curve import hilbert_key, key_ranges
from ..functions.geometry import Rect, corners
from ..session import materialize

LEVEL, KEY = "_level", "_key"
#: Coordinates are shifted to non-negative numbers of 32 bits.
_SHIFT, _BITS = 1 << 31, 32


def _indexed(rows: DataFrame, box: list[str], points: list[tuple[str, str]], least_level: int) -> DataFrame:
    xs = [box[0], box[2], *[p[0] for p in points]]
    ys = [box[1], box[3], *[p[1] for p in points]]

    def low(names: list[str]) -> Column:
        return F.least(*[F.col(n) for n in names]).cast("long")

    def high(names: list[str]) -> Column:
        return F.greatest(*[F.col(n) for n in names]).cast("long")

    def cell(names: list[str]) -> Column:
        return F.call_function("shiftright", low(names) + _SHIFT, F.col(LEVEL))

    size = F.greatest(high(xs) - low(xs), high(ys) - low(ys))
    level = F.greatest(F.lit(least_level), F.length(F.bin(size)))
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in [*xs, *ys]])
    out = rows.withColumn(LEVEL, F.when(missing, -1).otherwise(level).cast("int"))
    key = hilbert_key(cell(xs), cell(ys), _BITS - F.col(LEVEL))
    return out.withColumn(KEY, F.when(F.col(LEVEL) < 0, -1).otherwise(key).cast("long"))


def write_boxes(
    rows: DataFrame,
    path: str,
    box: list[str],
    points: list[tuple[str, str]] | None = None,
    folders: list[str] | None = None,
    least_level: int = 6,
    row_group_bytes: int = 16 << 20,
) -> None:
    """Store ``rows`` below ``path``; ``folders`` are columns that become folders (a cycle, say)."""
    folders = folders or []
    # Written once, as dealing into ranges reads its input twice.
    placed = materialize(_indexed(rows, box, points or [], least_level), "placed-boxes")
    order = [*folders, LEVEL, KEY]
    writer = placed.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", row_group_bytes)
    writer.partitionBy(*folders).parquet(f"{path}/rows")
    spark = rows.sparkSession
    levels = spark.read.parquet(f"{path}/rows").select(LEVEL).distinct()
    levels.coalesce(1).write.parquet(f"{path}/levels")


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows."""
    return spark.read.parquet(f"{path}/rows").drop(LEVEL, KEY)


def meeting(spark: SparkSession, path: str, rect: Rect, ranges: int = 32) -> DataFrame:
    """Stored rows whose cells the slab (border included) meets: all boxes that meet it, and some around it."""
    try:
        levels = sorted(r[0] for r in spark.read.parquet(f"{path}/levels").collect() if r[0] >= 0)
    except AnalysisException as error:
        raise ValueError(f"{path} was not written by write_boxes") from error
    xs, ys, xe, ye = corners(rect)
    terms = []
    for level in levels:
        side, last = 1 << level, (1 << _BITS - level) - 1
        low = [max(0, v - side + 1 + _SHIFT) >> level for v in (xs, ys)]
        high = [min(last, v + _SHIFT >> level) for v in (xe, ye)]
        found = key_ranges((*low, *high), _BITS - level, ranges)
        if found:
            keys = reduce(Column.__or__, [F.col(KEY).between(a, b) for a, b in found])
            terms.append((F.col(LEVEL) == level) & keys)
    rows = spark.read.parquet(f"{path}/rows")
    return rows.filter(reduce(Column.__or__, terms) if terms else F.lit(False)).drop(LEVEL, KEY)
