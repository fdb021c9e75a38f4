"""Averages of a pixel attribute over the images of a cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Rect
from ..functions.tiles import BAND_TILES, TILE_RATIO, TILE_SIZE, box_tile_ranges, in_box, in_tile_ranges
from .catalog import pixels_of_cycle


def box_pixels(
    pixels: DataFrame, rect: Rect | None, tile_size: int = TILE_SIZE, ratio: int = TILE_RATIO
) -> DataFrame:
    """Pixels of a closed box in image coordinates, with the tile predicate that prunes row groups and,
    for a stored raster, the band predicate that prunes folders."""
    if rect is None:
        return pixels
    ranges = box_tile_ranges(rect, tile_size, ratio)
    if "band" in pixels.columns and ranges:
        rows = ratio * BAND_TILES
        pixels = pixels.filter(F.col("band").between(ranges[0][0] // rows, ranges[-1][1] // rows))
    return pixels.filter(in_tile_ranges(F.col("tile"), ranges, ratio) & in_box(F.col("x"), F.col("y"), rect))


def _sum_count(attr: str) -> list:
    value = F.col(attr).cast("long")
    return [F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.count(F.col(attr)).alias("n")]


def q1(
    pixels: DataFrame,
    images: DataFrame,
    cycle: int,
    attr: str,
    rect: Rect | None = None,
    tile_size: int = TILE_SIZE,
    ratio: int = TILE_RATIO,
) -> DataFrame:
    """Sum, count and average of ``attr`` over a box (or everything) for all images of a cycle."""
    chosen = pixels_of_cycle(box_pixels(pixels, rect, tile_size, ratio), images, cycle)
    sums = chosen.agg(*_sum_count(attr))
    return sums.withColumn("average", F.try_divide(F.col("total").cast("double"), F.col("n").cast("double")))


def q1_partials(pixels: DataFrame, images: DataFrame, cycle: int, attr: str, n: int) -> DataFrame:
    """The per-node (sum, count) pairs of the same average; node = imageid modulo ``n``."""
    return (
        pixels_of_cycle(pixels, images, cycle)
        .groupBy(F.pmod(F.col("imageid"), F.lit(n)).cast("int").alias("node"))
        .agg(*_sum_count(attr))
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Global average from per-node partials."""
    return partials.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    ).withColumn("average", F.try_divide(F.col("total").cast("double"), F.col("n").cast("double")))
