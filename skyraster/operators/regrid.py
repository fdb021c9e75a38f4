"""10:3 regridding: ten source pixels become three coarse cells per axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Rect
from ..functions.tiles import TILE_RATIO, TILE_SIZE, idiv
from .pixel_stats import box_pixels

MODES = ("area", "compat")


def _cells(v: Column, mode: str) -> Column:
    """Coarse cells that coordinate ``v`` contributes to."""
    first = idiv(v * 3, 10).cast("int")
    return F.sequence(first, idiv(v * 3 + 2, 10).cast("int") if mode == "area" else first + 1)


def _share(v: Column, cell: Column, mode: str, across: bool) -> Column:
    """Weight of ``v`` in one cell.  ``area``: overlap of [0.3 v, 0.3 v + 0.3) with the cell, in thirds
    of a pixel.  ``compat``: the shares the older tool used, in thirds across and ninths down."""
    if mode == "area":
        return F.least(v * 3 + 3, cell * 10 + 10) - F.greatest(v * 3, cell * 10)
    near, third = cell == idiv(v * 3, 10), v % 10 == 3
    if across:
        return F.when(near == third, 2).otherwise(1)
    return F.when(~near, 2).when(third, 6).otherwise(3)


def regrid(
    pixels: DataFrame,
    images: DataFrame,
    cycle: int | None = None,
    rect: Rect | None = None,
    mode: str = "area",
    tile_size: int = TILE_SIZE,
    ratio: int = TILE_RATIO,
) -> DataFrame:
    """Coarse image per source image: weighted sums of pix and var and the AND of valid.

    Weights are kept as integers (hundredths for ``area``, three-hundredths for ``compat``) up to
    one final division, so sums do not depend on the order of addition.  Every coarse cell is
    produced: zero-weight rows for all cells join the pixel contributions in front of the one
    aggregation, which costs no join.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    chosen = images if cycle is None else images.filter(F.col("cycle") == cycle)
    chosen = chosen.select(
        "imageid",
        (F.lit(rect[1]) if rect else F.col("xend") - F.col("xstart")).alias("xlen"),
        (F.lit(rect[3]) if rect else F.col("yend") - F.col("ystart")).alias("ylen"),
    )
    x0, y0 = (rect[0], rect[2]) if rect else (0, 0)
    source = (
        box_pixels(pixels, rect, tile_size, ratio)
        .join(chosen.select("imageid"), "imageid", "left_semi")
        .select(
            "imageid",
            (F.col("x") - x0).alias("x"),
            (F.col("y") - y0).alias("y"),
            "pix",
            "var",
            "valid",
        )
    )
    scale = 100.0 if mode == "area" else 300.0
    # explode_outer: a plain explode would make Spark evaluate every array once more as a filter.
    parts = (
        source.withColumn("_h", F.explode_outer(_cells(F.col("x"), mode)))
        .withColumn("_v", F.explode_outer(_cells(F.col("y"), mode)))
        .withColumn(
            "_w",
            _share(F.col("x"), F.col("_h"), mode, True) * _share(F.col("y"), F.col("_v"), mode, False).cast("long"),
        )
        .select(
            "imageid",
            F.col("_h").alias("x"),
            F.col("_v").alias("y"),
            (F.col("_w") * F.col("pix")).alias("wpix"),
            (F.col("_w") * F.col("var")).alias("wvar"),
            "valid",
        )
    )
    cells = (
        chosen.select(
            "imageid",
            F.explode(F.sequence(F.lit(0), idiv(F.col("ylen") * 3, 10).cast("int"))).alias("y"),
            idiv(F.col("xlen") * 3, 10).cast("int").alias("xmax"),
        )
        .select("imageid", F.explode(F.sequence(F.lit(0), F.col("xmax"))).alias("x"), "y")
        .select(
            "imageid",
            "x",
            "y",
            F.lit(0).cast("long").alias("wpix"),
            F.lit(0).cast("long").alias("wvar"),
            F.lit(None).cast("int").alias("valid"),
        )
    )
    return (
        parts.unionByName(cells)
        .groupBy("imageid", "x", "y")
        .agg(
            F.coalesce(F.bit_and("valid"), F.lit(0)).cast("int").alias("valid_and"),
            (F.sum("wpix").cast("double") / F.lit(scale)).alias("pixavg"),
            (F.sum("wvar").cast("double") / F.lit(scale)).alias("varavg"),
        )
    )
