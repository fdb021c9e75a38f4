"""Pixel cutouts around selected observations (Q8, Q9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Rect, box_inside, box_overlaps, point_in_rect
from ..functions.tiles import TILE_RATIO, TILE_SIZE, band_of, idiv
from ..session import materialize, materialize_counted
from .catalog import images_in_slab
from .gridjoin import GridDim, grid_join
from .groups import group_summary, members_of, step_boxes

BOX = ["minx", "miny", "maxx", "maxy"]
#: A cell that makes more windows than the square of this is dealt to several tasks.
HOT_ROWS = 256
#: So many windows on one tile are joined with its pixels in one task.
TILE_WINDOWS = 4096


def obs_union(from_groups: DataFrame, from_slab: DataFrame) -> DataFrame:
    """Distinct observation ids of both selections."""
    return from_groups.select("obsid").unionByName(from_slab.select("obsid")).distinct()


def select_q8(members: DataFrame, obs: DataFrame, rect: Rect, boxes: DataFrame | None = None) -> DataFrame:
    """Ids of the members of groups contained in the slab and of observations centred in it."""
    boxes = group_summary(members, obs) if boxes is None else boxes
    inside = boxes.filter(box_inside(*[F.col(c) for c in BOX], rect))
    slab = obs.filter(point_in_rect(F.col("centerx"), F.col("centery"), rect))
    return obs_union(members_of(members, inside), slab)


def select_q9(members: DataFrame, obs: DataFrame, t: int, rect: Rect, steps: DataFrame | None = None) -> DataFrame:
    """Ids of the members of groups whose step polygon valid at ``t`` meets the slab, and of
    observations at ``t`` whose outline lies in it."""
    steps = step_boxes(members, obs) if steps is None else steps
    valid = steps.filter(
        (F.col("fromtime") <= t) & (F.col("totime") >= t) & box_overlaps(*[F.col(c) for c in BOX], rect)
    )
    outline_box = [F.col(c) for c in ("boxxstart", "boxystart", "boxxend", "boxyend")]
    slab = obs.filter((F.col("time") == t) & box_inside(*outline_box, rect))
    return obs_union(members_of(members, valid), slab)


def _centres_in_images(centres: DataFrame, images: DataFrame, dist: int, cell: int) -> DataFrame:
    """(obsid, imageid) of every image whose margin-expanded extent holds the centre, with the
    centre in image coordinates (lx, ly) and the image size.

    A crowded cell, as the centre of the sky that most images cover, is cut into slices of centres and of images, so
    that a task makes ``HOT_ROWS`` squared windows of it at most.
    """
    frames = images.select("imageid", "xstart", "ystart", "xend", "yend")
    points = materialize(centres.select("obsid", "centerx", "centery"), "cutout-centres")
    dims = [
        GridDim(F.col("xstart") - dist, F.col("xend") + dist, F.col("centerx"), cell),
        GridDim(F.col("ystart") - dist, F.col("yend") + dist, F.col("centery"), cell),
    ]
    held = F.col("centerx").between(F.col("xstart") - dist, F.col("xend") + dist) & F.col("centery").between(
        F.col("ystart") - dist, F.col("yend") + dist
    )
    return grid_join(frames, points, dims, held, hot_rows=HOT_ROWS).select(
        "obsid",
        "imageid",
        "xstart",
        "ystart",
        (F.col("centerx") - F.col("xstart")).alias("lx"),
        (F.col("centery") - F.col("ystart")).alias("ly"),
        (F.col("xend") - F.col("xstart")).alias("width"),
        (F.col("yend") - F.col("ystart")).alias("height"),
    )


def cutout_tiles(
    centres: DataFrame,
    images: DataFrame,
    dist: int,
    tile_size: int = TILE_SIZE,
    ratio: int = TILE_RATIO,
    cell: int = 4096,
) -> DataFrame:
    """Tiles of each image that a square of ``dist`` around a centre touches: obsid, imageid, tile."""

    def span(centre: str, size: str):
        low = F.greatest(idiv(F.col(centre) - dist, tile_size), F.lit(0))
        high = F.least(idiv(F.col(centre) + dist, tile_size), idiv(F.col(size), tile_size))
        return F.when(high >= low, F.sequence(low, high))

    return (
        _centres_in_images(centres, images, dist, cell)
        .withColumn("_tx", F.explode(span("lx", "width")))
        .withColumn("_ty", F.explode(span("ly", "height")))
        .select("obsid", "imageid", (F.col("_ty") * ratio + F.col("_tx")).cast("int").alias("tile"))
    )


def _dense(first: Column, tile_size: int) -> Column:
    """The pixels of ``_row``, (x, pix) by x, as one value for each column of the tile; NULL where none is."""
    full = F.size("_row") == tile_size
    at = F.map_from_entries("_row")
    sparse = F.transform(F.sequence(first, first + tile_size - 1), lambda x: F.try_element_at(at, x.cast("int")))
    return F.when(full, F.transform("_row", lambda p: p["pix"])).otherwise(sparse)


def cutouts(
    ids: DataFrame,
    obs: DataFrame,
    images: DataFrame,
    pixels: DataFrame,
    dist: int,
    fill: bool = True,
    tile_size: int = TILE_SIZE,
    ratio: int = TILE_RATIO,
    cell: int = 4096,
) -> DataFrame:
    """Pixels in [centre - dist, centre + dist) of every image around each observation.

    One row per (obsid, image, pixel) with world coordinates.  ``fill`` adds 0 for pixels the raster
    does not hold.  Pixels are gathered once per image row of a tile, so an observation joins one
    row per tile row it touches instead of one per pixel, and the fill needs no further join.
    """
    centres = obs.join(ids, "obsid", "left_semi")
    windows = _centres_in_images(centres, images, dist, cell).select(
        "obsid",
        "imageid",
        "xstart",
        "ystart",
        F.greatest(F.col("lx") - dist, F.lit(0)).alias("x0"),
        F.least(F.col("lx") + dist, F.col("width")).alias("x1"),
        F.greatest(F.col("ly") - dist, F.lit(0)).alias("y0"),
        F.least(F.col("ly") + dist, F.col("height")).alias("y1"),
    ).filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    tiles = windows.withColumn(
        "_ty", F.explode(F.sequence(idiv(F.col("y0"), tile_size), idiv(F.col("y1") - 1, tile_size)))
    ).withColumn("_tx", F.explode(F.sequence(idiv(F.col("x0"), tile_size), idiv(F.col("x1") - 1, tile_size))))
    tiles = tiles.select(
        "obsid",
        "imageid",
        "xstart",
        "ystart",
        (F.col("_ty") * ratio + F.col("_tx")).cast("int").alias("tile"),
        F.greatest(F.col("x0"), F.col("_tx") * tile_size).cast("int").alias("x0"),
        F.least(F.col("x1"), (F.col("_tx") + 1) * tile_size).cast("int").alias("x1"),
        F.greatest(F.col("y0"), F.col("_ty") * tile_size).cast("int").alias("y0"),
        F.least(F.col("y1"), (F.col("_ty") + 1) * tile_size).cast("int").alias("y1"),
    )
    # Written once: the raster is then filtered by a small table of known size, before its shuffle.
    tiles = materialize(tiles, "cutout-tiles")
    wanted = tiles.groupBy("imageid", band_of(F.col("tile"), ratio).alias("band"), "tile").agg(
        F.ceil(F.count(F.lit(1)) / TILE_WINDOWS).cast("int").alias("_parts")
    )
    wanted, seen = materialize_counted(wanted, "cutout-wanted", {"most": F.max("_parts")})
    keys = ["imageid", "band", "tile"] if "band" in pixels.columns else ["imageid", "tile"]
    # The comparison, true of all tiles, marks the table as one to prune the folders of a raster by.
    strips = (
        pixels.select(*keys, "x", "y", "pix")
        .join(images.select("imageid"), "imageid", "left_semi")
        .join(wanted.filter(F.col("tile") >= 0).select(*keys), keys, "left_semi")
        .groupBy("imageid", "tile", "y")
        .agg(F.sort_array(F.collect_list(F.struct("x", "pix"))).alias("_row"))
        .select("imageid", "tile", "y", _dense(F.col("tile") % ratio * tile_size, tile_size).alias("strip"))
    )
    on = ["imageid", "tile", "y"]
    if (seen["most"] or 1) > 1:  # a tile that very many windows want is given to each of its parts
        parts = wanted.select("imageid", "tile", "_parts")
        tiles = tiles.join(parts, ["imageid", "tile"]).withColumn("_part", F.pmod(F.xxhash64("obsid"), F.col("_parts")).cast("int"))
        strips = strips.join(parts, ["imageid", "tile"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        on.append("_part")
    rows = tiles.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).join(strips, on, "left" if fill else "inner")
    found = rows.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))).withColumn(
        "pix", F.get("strip", F.pmod(F.col("x"), F.lit(tile_size)))
    )
    if fill:
        found = found.withColumn("pix", F.coalesce("pix", F.lit(0)))
    else:
        found = found.filter(F.col("pix").isNotNull())
    return found.select(
        "obsid",
        "imageid",
        (F.col("x") + F.col("xstart")).alias("x"),
        (F.col("y") + F.col("ystart")).alias("y"),
        "pix",
    )


def q8(
    members: DataFrame,
    obs: DataFrame,
    images: DataFrame,
    pixels: DataFrame,
    rect: Rect,
    dist: int,
    fill: bool = True,
    boxes: DataFrame | None = None,
    **layout: int,
) -> DataFrame:
    """Cutouts around all observations of groups contained in the slab and of those centred in it."""
    ids = select_q8(members, obs, rect, boxes)
    return cutouts(ids, obs, images_in_slab(images, rect), pixels, dist, fill, **layout)


def q9(
    members: DataFrame,
    obs: DataFrame,
    images: DataFrame,
    pixels: DataFrame,
    t: int,
    rect: Rect,
    dist: int,
    fill: bool = True,
    steps: DataFrame | None = None,
    **layout: int,
) -> DataFrame:
    """As :func:`q8`, selected by the step polygons and outlines valid at time ``t``."""
    ids = select_q9(members, obs, t, rect, steps)
    return cutouts(ids, obs, images_in_slab(images, rect), pixels, dist, fill, **layout)
