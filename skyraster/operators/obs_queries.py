"""Filters and aggregates over observations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Rect, box_inside, box_overlaps, point_in_rect
from ..functions.ordinals import running_total
from ..functions.tiles import cell_of
from .dominance import box_sums


def _bbox(prefix: str = "") -> list:
    return [F.col(prefix + name) for name in ("boxxstart", "boxystart", "boxxend", "boxyend")]


def obs_in_rect(obs: DataFrame, rect: Rect) -> DataFrame:
    """Observations whose centre lies in the rectangle (border included)."""
    return obs.filter(point_in_rect(F.col("centerx"), F.col("centery"), rect))


def obs_overlapping(obs: DataFrame, rect: Rect) -> DataFrame:
    """Observations whose bounding box meets the rectangle."""
    return obs.filter(box_overlaps(*_bbox(), rect))


def obs_inside(obs: DataFrame, rect: Rect) -> DataFrame:
    """Observations whose bounding box lies inside the rectangle."""
    return obs.filter(box_inside(*_bbox(), rect))


def in_box(obs: DataFrame, box: tuple[int, int, int, int], time: int) -> DataFrame:
    """Observations of one time inside (xstart, ystart, xend, yend), border included."""
    xs, ys, xe, ye = box
    return obs.filter(
        (F.col("time") == time) & F.col("centerx").between(xs, xe) & F.col("centery").between(ys, ye)
    )


def radius_rect(cx: int, cy: int, dist: float) -> Rect:
    """The smallest rectangle of whole coordinates around a circle."""
    x, y = int(np.floor(cx - dist)), int(np.floor(cy - dist))
    return x, int(np.ceil(cx + dist)) - x, y, int(np.ceil(cy + dist)) - y


def in_radius(obs: DataFrame, cx: int, cy: int, time: int, dist: float) -> DataFrame:
    """Observations of one time within ``dist`` of a point."""
    dx = F.col("centerx").cast("long") - cx
    dy = F.col("centery").cast("long") - cy
    near = point_in_rect(F.col("centerx"), F.col("centery"), radius_rect(cx, cy, dist))
    return obs.filter(
        (F.col("time") == time)
        & near
        & ((dx * dx + dy * dy).cast("double") <= float(dist) * float(dist))
    )


def _average(obs: DataFrame, attr: str) -> DataFrame:
    return obs.agg(
        F.coalesce(F.avg(F.col(attr).cast("double")), F.lit(0.0)).alias("average"), F.count(F.lit(1)).alias("n")
    )


def q4(obs: DataFrame, cycle: int, attr: str, rect: Rect) -> DataFrame:
    """Average of ``attr`` and count for centres in the slab; an empty slab gives 0 and 0."""
    return _average(obs_in_rect(obs.filter(F.col("cycle") == cycle), rect), attr)


def q5(obs: DataFrame, cycle: int, attr: str, rect: Rect) -> DataFrame:
    """As :func:`q4` for observations whose outline box meets the slab."""
    return _average(obs_overlapping(obs.filter(F.col("cycle") == cycle), rect), attr)


def q6_grid(obs: DataFrame, cycle: int, box: int, threshold: int) -> DataFrame:
    """Grid cells of side ``box`` with at least ``threshold`` centres."""
    return (
        obs.filter(F.col("cycle") == cycle)
        .groupBy(
            cell_of(F.col("centerx"), box).cast("int").alias("dx"),
            cell_of(F.col("centery"), box).cast("int").alias("dy"),
        )
        .agg(F.count(F.lit(1)).alias("counts"))
        .filter(F.col("counts") >= threshold)
    )


def q6_neighbours(obs: DataFrame, cycle: int, box: int, threshold: int, rect: Rect | None = None) -> DataFrame:
    """Centres of a slab and cycle that have at least ``threshold`` centres of the same selection
    (themselves included) within ``box``/2, integer half, on both axes.

    Centres are first collapsed to distinct coordinates with a count, then counted by sums over strips (see
    :mod:`.dominance`), so the cost depends neither on the box nor on how crowded the sky is.
    """
    chosen = obs.filter(F.col("cycle") == cycle)
    if rect is not None:
        chosen = obs_in_rect(chosen, rect)
    half = box // 2
    points = chosen.groupBy(F.col("centerx").alias("px"), F.col("centery").alias("py")).agg(
        F.count(F.lit(1)).alias("weight")
    )
    counts = box_sums(points, half)
    dense = counts.filter(F.col("n") >= threshold)
    return chosen.join(
        dense, (F.col("centerx") == F.col("px")) & (F.col("centery") == F.col("py"))
    ).select("obsid", F.col("centerx").alias("dx"), F.col("centery").alias("dy"), F.col("n").alias("counts"))


def batch_bbox(obs: DataFrame) -> DataFrame:
    """Bounding box of the centres of a batch of observations."""
    return obs.agg(
        F.min("centerx").alias("boxxstart"),
        F.min("centery").alias("boxystart"),
        F.max("centerx").alias("boxxend"),
        F.max("centery").alias("boxyend"),
    )


def time_index(obs: DataFrame) -> DataFrame:
    """First position of every time step when observations are ordered by (time, obsid).

    Positions come from per-time counts, so only one row per time step is ever ordered.
    """
    counts = obs.groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.min("obsid").alias("first_obsid"))
    return running_total(counts, [], ["time"], F.col("n"), "first_index").select(
        "time", "first_obsid", "first_index", "n"
    )
