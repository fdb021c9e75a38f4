"""Connected bright regions (8-neighbour) of every image.

Pixels at or above the threshold are folded into horizontal runs, so the graph has one node per
run.  One shuffle by (image, band of rows) builds the runs and labels them inside their band; a
band is bounded by the image width, whatever the sky looks like.  Only runs on both sides of a band
border are then joined, and alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014) merge the band labels that touch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, materialize_counted

#: Image rows labelled together.
BAND_ROWS = 128
#: Columns per join key when runs of neighbouring rows are matched.
BLOCK = 1024


def _node(y: str, x: str):
    """Raster-order number of a pixel inside its image."""
    return F.shiftleft(F.col(y).cast("long"), 32) + F.col(x)


def _label_band(band: pa.Table) -> pa.Table:
    """Fold the bright pixels of one band into runs and label the runs inside the band.

    ``part`` of a run is the node of the first run, in raster order, of its region in the band.
    """
    y = band.column("y").to_numpy().astype(np.int64)
    x = band.column("x").to_numpy().astype(np.int64)
    order = np.lexsort((x, y))
    y, x, pix = y[order], x[order], band.column("pix").to_numpy()[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(y) != 0) | (np.diff(x) != 1)]))
    ends = np.append(starts[1:], len(x))
    row, first, last = y[starts] << 32, x[starts], x[ends - 1]
    # Runs of the next row that touch run i are neighbours in raster order: positions low..high-1.
    below = row + (1 << 32)
    low = np.searchsorted(row + last, below + first - 1)
    high = np.searchsorted(row + first, below + last + 1, side="right")
    count = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(row)), count)
    lower = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    lead = np.arange(len(row))
    while True:
        a, b = lead[upper], lead[lower]
        apart = a != b
        if not apart.any():
            break
        upper, lower, a, b = upper[apart], lower[apart], a[apart], b[apart]
        np.minimum.at(lead, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = lead[lead]
            if np.array_equal(jumped, lead):
                break
            lead = jumped
    image = band.column("imageid")[0].as_py()
    return pa.table(
        {
            "imageid": pa.array(np.full(len(row), image), pa.int32()),
            "y": pa.array(y[starts], pa.int32()),
            "xs": pa.array(first, pa.int32()),
            "xe": pa.array(last, pa.int32()),
            "pixels": pa.ListArray.from_arrays(
                pa.array(np.append(starts, len(x)), pa.int32()), pa.array(pix, pa.int32())
            ).cast(pa.list_(pa.field("element", pa.int32()))),
            "part": pa.array((row + first)[lead], pa.int64()),
        }
    )


def bright_runs(pixels: DataFrame, threshold: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """Horizontal runs of bright pixels: imageid, y, xs, xe, the pixel values in x order, and the
    label ``part`` of the run inside its band of ``band_rows`` image rows."""
    return (
        pixels.filter(F.col("pix") >= threshold)
        .select("imageid", F.floor(F.col("y") / band_rows).cast("int").alias("band"), "y", "x", "pix")
        .groupBy("imageid", "band")
        .applyInArrow(_label_band, "imageid int, y int, xs int, xe int, pixels array<int>, part long")
    )


def border_edges(runs: DataFrame, band_rows: int) -> DataFrame:
    """Band labels that touch across a band border, as (imageid, u, v) with u < v.

    The join key holds a block of x as well as the row, so a wide row is spread over many tasks:
    a run is placed in each block it covers (the upper one widened by a pixel), and a pair is kept
    only in the block where its overlap begins.
    """
    inside = F.pmod(F.col("y"), F.lit(band_rows))
    upper = runs.filter(inside == band_rows - 1).select(
        "imageid", (F.col("y") + 1).alias("row"), F.col("xs").alias("us"), F.col("xe").alias("ue"), F.col("part").alias("u")
    )
    upper = upper.withColumn(
        "block", F.explode(F.sequence(F.floor((F.col("us") - 1) / BLOCK), F.floor((F.col("ue") + 1) / BLOCK)))
    )
    lower = runs.filter(inside == 0).select(
        "imageid", F.col("y").alias("row"), F.col("xs").alias("ls"), F.col("xe").alias("le"), F.col("part").alias("v")
    )
    lower = lower.withColumn("block", F.explode(F.sequence(F.floor(F.col("ls") / BLOCK), F.floor(F.col("le") / BLOCK))))
    touching = (F.col("ls") <= F.col("ue") + 1) & (F.col("le") >= F.col("us") - 1)
    first_block = F.floor(F.greatest(F.col("ls"), F.col("us") - 1) / BLOCK)
    return (
        upper.join(lower, ["imageid", "row", "block"])
        .filter(touching & (F.col("block") == first_block))
        .select("imageid", "u", "v")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select("imageid", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("imageid", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter(F.col("v") > F.col("u"))
        .join(least, ["imageid", "u"])
        .select("imageid", F.col("m").alias("u"), "v")
        .filter(F.col("u") < F.col("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # Edges always point from the smaller to the larger node, so v sees only smaller neighbours.
    least = edges.groupBy("imageid", "v").agg(F.min("u").alias("m"))
    spread = edges.join(least, ["imageid", "v"]).select("imageid", F.col("m"), F.col("u"))
    return (
        spread.filter(F.col("m") < F.col("u"))
        .select("imageid", F.col("m").alias("u"), F.col("u").alias("v"))
        .unionByName(least.select("imageid", F.col("m").alias("u"), "v"))
        .distinct()
    )


def contract(edges: DataFrame) -> DataFrame:
    """Stars (imageid, root, node) for all nodes that have an edge to a smaller node.

    A large-star step keeps the number of edges, so repeated edges are only removed once per round.

    A minimum and a join back are used instead of a window per node: the minimum is combined
    map-side and the join can be split by adaptive execution where one node has very many edges.
    """
    def fingerprint():
        return {"digest": F.bit_xor(F.xxhash64("imageid", "u", "v"))}

    current, seen = materialize_counted(edges, "cc-edges", fingerprint())
    if seen["rows"] == 0:
        return current.select("imageid", F.col("u").alias("root"), F.col("v").alias("node"))
    while True:
        step, now = materialize_counted(_small_star(_large_star(current)), "cc-round", fingerprint())
        if (now["rows"], now["digest"]) == (seen["rows"], seen["digest"]):
            return step.select("imageid", F.col("u").alias("root"), F.col("v").alias("node"))
        current, seen = step, now


def label_runs(pixels: DataFrame, threshold: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """Runs with the ``label`` of their component: the raster-order number of its first pixel.

    The runs are written once, with their pixel values; everything after this reads them instead of
    scanning the raster again.
    """
    runs = materialize(bright_runs(pixels, threshold, band_rows), "bright-runs")
    stars = contract(border_edges(runs, band_rows)).withColumnRenamed("node", "part")
    return runs.join(stars, ["imageid", "part"], "left").select(
        "imageid", F.coalesce("root", "part").alias("label"), "y", "xs", "xe", "pixels"
    )


def run_pixels(labelled: DataFrame, *keep: str) -> DataFrame:
    """Back to pixels: imageid, label, x, y, pix and the columns in ``keep``."""
    return labelled.select("imageid", "label", "y", "xs", *keep, F.posexplode("pixels").alias("_i", "pix")).select(
        "imageid", "label", (F.col("xs") + F.col("_i")).alias("x"), "y", "pix", *keep
    )


def label(pixels: DataFrame, threshold: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """Bright pixels with their component, named by its first pixel (first_y, first_x)."""
    return run_pixels(label_runs(pixels, threshold, band_rows)).select(
        "imageid",
        F.shiftright("label", 32).cast("int").alias("first_y"),
        F.col("label").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("first_x"),
        "x",
        "y",
        "pix",
    )
