"""From pixels to observations: statistics, ids, outlines, world coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import shift_polygon
from ..functions.ordinals import running_offset, running_total
from ..session import materialize, materialize_counted
from .components import BAND_ROWS, label_runs, run_pixels
from .outline import box_columns, outline, short_outlines

MAX_VERTICES = 50
#: Regions with more pixels than this are not gathered in one task.
HOT_PIXELS = 4_000_000
#: Their table (about 40 bytes a row) is broadcast up to this many rows.
BROADCAST_HOT_REGIONS = 200_000
#: Image rows per slice when objects are numbered.
ROWS_PER_SLICE = 256


def object_stats(labelled: DataFrame, hot_pixels: int = HOT_PIXELS) -> DataFrame:
    """Per region: pixelSum, intensity-weighted centroid and averageDist.

    The centroid is truncated to integers in the result; the average distance uses it untruncated.
    The second pass joins the centroid to the runs.  Regions with more than ``hot_pixels`` pixels
    are few for any amount of data (at most the pixel count over ``hot_pixels``), so their
    centroids are broadcast and their runs are summed where they are read.
    """
    key = ["imageid", "label"]
    zero = F.lit(0).cast("long")
    light = F.aggregate("pixels", zero, lambda s, p: s + p)
    moment = F.aggregate(F.transform("pixels", lambda p, i: p.cast("long") * (F.col("xs") + i)), zero, lambda s, p: s + p)
    sums = labelled.groupBy(*key).agg(
        F.sum(light).alias("pixelSum"),
        F.sum(moment).alias("_wx"),
        F.sum(light * F.col("y")).alias("_wy"),
        *box_columns(),
    )
    sums = sums.withColumns(
        {
            "_cx": F.try_divide(F.col("_wx").cast("double"), F.col("pixelSum").cast("double")),
            "_cy": F.try_divide(F.col("_wy").cast("double"), F.col("pixelSum").cast("double")),
        }
    )
    is_hot = F.col("n") > hot_pixels
    sums, seen = materialize_counted(sums, "object-sums", {"hot": F.sum(F.when(is_hot, 1).otherwise(0))})
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")

    def spread_of(centred: DataFrame) -> DataFrame:
        return run_pixels(centred, "_cx", "_cy").groupBy(*key).agg(
            F.sum(F.col("pix") * F.sqrt(dx * dx + dy * dy)).alias("_spread")
        )

    centres = sums.select(*key, "_cx", "_cy")
    if seen["hot"] and seen["hot"] <= BROADCAST_HOT_REGIONS:
        hot = F.broadcast(sums.filter(is_hot).select(*key, "_cx", "_cy"))
        rest = labelled.join(hot.select(*key), key, "left_anti")
        spread = spread_of(labelled.join(hot, key)).unionByName(spread_of(rest.join(centres, key)))
    else:
        spread = spread_of(labelled.join(centres, key))
    return sums.join(spread, ["imageid", "label"]).select(
        "imageid",
        "label",
        "n",
        F.try_divide(F.col("_spread"), F.col("pixelSum").cast("double")).alias("averageDist"),
        "pixelSum",
        F.col("_cx").cast("int").alias("centerx"),
        F.col("_cy").cast("int").alias("centery"),
        "minx",
        "miny",
        "maxx",
        "maxy",
    )


def number_objects(objects: DataFrame, start_id: int = 1) -> DataFrame:
    """Dense ids in order of (imageid, first pixel in raster order), starting at ``start_id``.

    Offsets come from counts per image and per slice of image rows, so rows are only ever ordered
    inside one slice.
    """
    sliced = objects.withColumn("_slice_of_rows", F.floor(F.shiftright("label", 32) / ROWS_PER_SLICE))
    inside = running_offset(sliced, ["imageid"], ["_slice_of_rows"], ["label"], name="_inside")
    per_image = running_total(
        objects.groupBy("imageid").agg(F.count(F.lit(1)).alias("_n")), [], ["imageid"], F.col("_n"), "_images_before"
    ).drop("_n")
    return (
        inside.join(per_image, "imageid")
        .withColumn("obsid", (F.col("_images_before") + F.col("_inside") + start_id).cast("long"))
        .drop("_images_before", "_inside", "_slice_of_rows")
    )


def to_world(obs: DataFrame, images: DataFrame) -> DataFrame:
    """Shift centre, box and outline from image to world coordinates; add time and cycle."""
    corner = images.select(
        "imageid", "time", "cycle", F.col("xstart").alias("_x0"), F.col("ystart").alias("_y0")
    )
    joined = obs.drop("time", "cycle").join(corner, "imageid")
    shifted = {
        "centerx": (F.col("centerx") + F.col("_x0")).cast("int"),
        "centery": (F.col("centery") + F.col("_y0")).cast("int"),
        "boxxstart": (F.col("boxxstart") + F.col("_x0")).cast("int"),
        "boxystart": (F.col("boxystart") + F.col("_y0")).cast("int"),
        "boxxend": (F.col("boxxend") + F.col("_x0")).cast("int"),
        "boxyend": (F.col("boxyend") + F.col("_y0")).cast("int"),
    }
    if "polygon" in obs.columns:
        shifted["polygon"] = shift_polygon(F.col("polygon"), F.col("_x0"), F.col("_y0"))
    return joined.withColumns(shifted).drop("_x0", "_y0")


def observations_of(
    labelled: DataFrame, images: DataFrame, max_vertices: int | None = MAX_VERTICES, start_id: int = 1
) -> DataFrame:
    """Observation rows (world coordinates) of labelled runs.

    With ``max_vertices`` regions with a longer outline are left out and each row carries its
    polygon.  With ``None`` all regions are kept and outlines, which have no size bound then, are
    left to :func:`observation_vertices`.
    """
    stats = object_stats(labelled)
    if max_vertices is not None:
        stats = materialize(stats, "object-stats")
        stats = stats.join(short_outlines(labelled, stats, max_vertices), ["imageid", "label"])
    numbered = number_objects(materialize(stats, "objects"), start_id)
    named = numbered.withColumnsRenamed(
        {"minx": "boxxstart", "miny": "boxystart", "maxx": "boxxend", "maxy": "boxyend"}
    )
    columns = ["obsid", "imageid", "time", "cycle", "averageDist", "pixelSum", "centerx", "centery"]
    columns += ["boxxstart", "boxystart", "boxxend", "boxyend", "label"]
    if max_vertices is not None:
        columns.append("polygon")
    return to_world(named, images).select(*columns)


def cook(
    pixels: DataFrame,
    images: DataFrame,
    threshold: int,
    max_vertices: int | None = MAX_VERTICES,
    start_id: int = 1,
    imageid: int | None = None,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """Observations of all images, or of one."""
    if imageid is not None:
        pixels = pixels.filter(F.col("imageid") == imageid)
    labelled = materialize(label_runs(pixels, threshold, band_rows), "labelled-runs")
    return observations_of(labelled, images, max_vertices, start_id).drop("label")


def cook_with_vertices(
    pixels: DataFrame, images: DataFrame, threshold: int, max_vertices: int | None = MAX_VERTICES, start_id: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Observations and their vertex table (obsid, ord, x, y); outlines may have any length."""
    labelled = materialize(label_runs(pixels, threshold), "labelled-runs")
    obs = materialize(observations_of(labelled, images, max_vertices, start_id), "observations")
    if max_vertices is not None:
        return obs.drop("label", "polygon"), obs_vertices(obs)
    corner = images.select("imageid", F.col("xstart").alias("_x0"), F.col("ystart").alias("_y0"))
    vertices = (
        outline(labelled)
        .join(obs.select("obsid", "imageid", "label"), ["imageid", "label"])
        .join(corner, "imageid")
        .select("obsid", "ord", (F.col("x") + F.col("_x0")).alias("x"), (F.col("y") + F.col("_y0")).alias("y"))
    )
    return obs.drop("label"), vertices


def obs_vertices(obs: DataFrame) -> DataFrame:
    """Vertex table of observations that carry a polygon."""
    return obs.select("obsid", F.posexplode("polygon").alias("ord", "p")).select(
        "obsid", "ord", F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )


def obs_cutoff(obs: DataFrame, max_vertices: int = MAX_VERTICES) -> DataFrame:
    """Observations whose outline has at most ``max_vertices`` vertices."""
    return obs.filter(F.size("polygon") <= max_vertices)


def dedup_obs(obs: DataFrame, order: list[str]) -> DataFrame:
    """First row per obsid in the given order; combined map-side, however many copies there are."""
    rest = [c for c in obs.columns if c != "obsid"]
    return (
        obs.groupBy("obsid")
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select("obsid", "_row.*")
        .select(*obs.columns)
    )
