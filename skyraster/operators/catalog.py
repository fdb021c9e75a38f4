"""Image catalog access and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Rect, corners


def images_by_cycle(images: DataFrame, cycle: int | None = None) -> DataFrame:
    """All images, or those of one cycle, in id order."""
    chosen = images if cycle is None else images.filter(F.col("cycle") == cycle)
    return chosen.orderBy("imageid")


def image_by_id(images: DataFrame, imageid: int) -> DataFrame:
    return images.filter(F.col("imageid") == imageid)


def images_in_slab(images: DataFrame, rect: Rect) -> DataFrame:
    """Images of every cycle whose (closed) extent meets the slab."""
    xs, ys, xe, ye = corners(rect)
    return images.filter(
        (F.col("xend") >= xs) & (F.col("xstart") <= xe) & (F.col("yend") >= ys) & (F.col("ystart") <= ye)
    )


def pixels_of_cycle(pixels: DataFrame, images: DataFrame, cycle: int) -> DataFrame:
    """Pixels of one cycle.  A stored raster is pruned by its own cycle column, and by the semi join on
    imageid."""
    if "cycle" in pixels.columns:
        pixels = pixels.filter(F.col("cycle") == cycle)
    chosen = images.filter(F.col("cycle") == cycle).select("imageid")
    return pixels.join(chosen, "imageid", "left_semi")
