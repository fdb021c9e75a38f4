"""Pairs of observations of different times: candidate search, motion pairs, similar pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import int_distance, long_square
from .gridjoin import HOT_ROWS, GridDim, grid_join

CANDIDATE_EPSILON = 1e-4
#: Time differences of a band: its longest is less than this many times its shortest.
BAND_GROWTH = 8
#: Cells, buckets of time and of brightness are so many search windows wide: a row then visits
#: 1 + 1 / CELL_WINDOWS of them on average.
CELL_WINDOWS = 2


def step_bands(longest: int) -> list[tuple[int, int]]:
    """(shortest, longest) time difference of each band: 1-7, 8-63, 64-511, ... up to ``longest``."""
    bands, low = [], 1
    while low <= longest:
        bands.append((low, min(low * BAND_GROWTH - 1, longest)))
        low *= BAND_GROWTH
    return bands


def _banded(rows: DataFrame, prefix: str, bands: list[tuple[int, int]], reach: Callable[[int], int]) -> DataFrame:
    """Every row once for each band, with the band's reach in space (``reach`` of its longest step), the
    size of its cells and its bounds in time.  Cells of short steps stay small however long the history."""
    table = [
        F.struct(
            F.lit(low).alias("low"),
            F.lit(high).alias("high"),
            F.lit(reach(high)).alias("reach"),
            F.lit(CELL_WINDOWS * (2 * reach(high) + 1)).alias("size"),
            F.lit(CELL_WINDOWS * high).alias("steps"),
        )
        for low, high in bands
    ]
    one = rows.withColumn("_band", F.explode(F.array(*table)))
    return one.select(*rows.columns, *[F.col(f"_band.{c}").alias(f"{prefix}{c}") for c in ("low", "high", "reach", "size", "steps")])


def _band_dims() -> list[GridDim]:
    """Two space axes and time, each with the cell size of the band; ``low`` is the band's number."""
    size = ("n_size", "e_size")
    return [
        GridDim(F.col("n_centerx") - F.col("n_reach"), F.col("n_centerx") + F.col("n_reach"), F.col("e_centerx"), size),
        GridDim(F.col("n_centery") - F.col("n_reach"), F.col("n_centery") + F.col("n_reach"), F.col("e_centery"), size),
        GridDim(F.col("n_time") - F.col("n_high"), F.col("n_time") - F.col("n_low"), F.col("e_time"), ("n_steps", "e_steps")),
    ]


#: Both sides in the same band, and the pair's time difference in it.
BAND_KEY = [("n_low", "e_low")]


def _in_band() -> Column:
    return (F.col("n_time") - F.col("e_time")).between(F.col("n_low"), F.col("n_high"))


def _renamed(obs: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return obs.select(*[F.col(c).alias(prefix + c) for c in columns])


def _squared_distance() -> Column:
    return long_square(F.col("n_centerx").cast("long") - F.col("e_centerx")) + long_square(
        F.col("n_centery").cast("long") - F.col("e_centery")
    )


def motion_pairs(
    new: DataFrame,
    history: DataFrame,
    d2: float,
    t: int,
    hot_rows: int | None = HOT_ROWS,
    new_columns: Sequence[str] = (),
    existing_columns: Sequence[str] = (),
) -> DataFrame:
    """(new, existing) pairs: existing is 1..t time steps older and within d2 per step of distance.

    The key is a band of time differences, a space cell and a time bucket.  A cell is
    twice as wide as the band's largest search window, so a new observation visits at most two cells
    per axis, mostly one.  ``new_columns`` and ``existing_columns`` come along under their names.
    """
    bands = step_bands(t) or [(1, 1)]
    columns = ["obsid", "time", "centerx", "centery"]
    more = {"n_": [c for c in new_columns if c not in columns], "e_": [c for c in existing_columns if c not in columns]}
    step = F.col("n_time") - F.col("e_time")
    limit = F.lit(float(d2)) * step.cast("double")
    near = _in_band() & step.between(1, t) & (_squared_distance().cast("double") <= limit * limit)
    sides = [
        _banded(_renamed(rows, p, columns + more[p]), p, bands, lambda s: int(math.floor(d2 * s)))
        for rows, p in ((new, "n_"), (history, "e_"))
    ]
    joined = grid_join(*sides, _band_dims(), near, BAND_KEY, hot_rows=hot_rows)
    return joined.select(
        F.col("n_obsid").alias("new_obsid"),
        F.col("e_obsid").alias("existing_obsid"),
        F.col("n_time").alias("new_time"),
        F.col("e_time").alias("existing_time"),
        *[F.col("n_" + c).alias(c) for c in new_columns],
        *[F.col("e_" + c).alias(c) for c in existing_columns],
    )


@dataclass(frozen=True)
class MotionPairs:
    """Motion pairs of one table of observations that are found where they are followed, not listed before: they grow
    with the square of the observations at one place.  The later time is at least ``since`` and before ``until``."""

    obs: DataFrame
    d2: float
    t: int
    since: int | None = None
    until: int | None = None

    def takes(self, time: int) -> bool:
        """Whether observations of this time are the later ones of pairs."""
        return (self.since is None or time >= self.since) and (self.until is None or time < self.until)

    def rows(self) -> DataFrame:
        """One row per pair, see :func:`motion_pairs`."""
        new = self.obs
        if self.since is not None:
            new = new.filter(F.col("time") >= self.since)
        if self.until is not None:
            new = new.filter(F.col("time") < self.until)
        return motion_pairs(new, self.obs, self.d2, self.t)


def candidates(
    obs: DataFrame, images: DataFrame, d2: float, t: int, cell: int = 1000, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Per image: observations 1..min(t, time) steps older, within d2 per step of its rectangle."""
    reach = int(math.ceil(d2 * t)) + 1
    frames = images.select(
        F.col("imageid").alias("n_imageid"),
        F.col("time").alias("n_time"),
        F.col("xstart").alias("n_xs"),
        F.col("xend").alias("n_xe"),
        F.col("ystart").alias("n_ys"),
        F.col("yend").alias("n_ye"),
    )
    dims = [
        GridDim(F.col("n_xs") - reach, F.col("n_xe") + reach, F.col("e_centerx"), cell),
        GridDim(F.col("n_ys") - reach, F.col("n_ye") + reach, F.col("e_centery"), cell),
        GridDim(F.greatest(F.col("n_time") - t, F.lit(0)), F.col("n_time") - 1, F.col("e_time"), max(t, 1)),
    ]

    def outside(value: str, low: str, high: str) -> Column:
        return F.greatest(F.col(low) - F.col(value), F.col(value) - F.col(high), F.lit(0))

    step = F.col("n_time") - F.col("e_time")
    limit = F.lit(float(d2)) * step.cast("double")
    gap = long_square(outside("e_centerx", "n_xs", "n_xe")) + long_square(outside("e_centery", "n_ys", "n_ye"))
    near = (
        step.between(1, t)
        & (F.col("e_time") >= 0)
        & (gap.cast("double") <= limit * limit + F.lit(CANDIDATE_EPSILON))
    )
    found = grid_join(
        frames.filter(F.col("n_time") > 0),
        _renamed(obs, "e_", ["obsid", "time", "centerx", "centery"]),
        dims,
        near,
        hot_rows=hot_rows,
    )
    return found.select(
        F.col("n_imageid").alias("imageid"),
        F.col("e_obsid").alias("obsid"),
        F.col("e_time").alias("time"),
        F.col("e_centerx").alias("centerx"),
        F.col("e_centery").alias("centery"),
    )


def similar_pairs(
    obs: DataFrame,
    t: float,
    d2: float,
    d_radius: float,
    d_sum: int,
    mode: str = "batch",
    new: DataFrame | None = None,
    max_step: int | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Pairs of any two times with close position, size and brightness.

    The radius is d2 * (t_new/t - t_old/t), truncated to a whole number.  ``batch`` compares it with
    the truncated distance, ``radius`` with the exact distance.  Besides the band of time differences,
    the two space cells and the time bucket, the key holds a brightness bucket.  ``new`` limits the
    later side (default: all of ``obs``).  ``max_step`` is the longest time span present; it bounds
    the bands and is read from the data when it is not given.
    """
    if mode not in ("batch", "radius"):
        raise ValueError("mode must be 'batch' or 'radius'")
    later = obs if new is None else new
    if max_step is None:
        last = later.agg(F.max("time").alias("hi"))
        first = obs.agg(F.min("time").alias("lo"))
        span = last.first()["hi"], first.first()["lo"]
        max_step = max(0, span[0] - span[1]) if None not in span else 0
    bands = step_bands(max_step) or [(1, 1)]
    columns = ["obsid", "time", "centerx", "centery", "pixelSum", "averageDist"]
    bright = GridDim(F.col("n_pixelSum") - d_sum, F.col("n_pixelSum") + d_sum, F.col("e_pixelSum"), CELL_WINDOWS * (2 * d_sum + 1))
    scale = F.lit(float(t))
    radius = (F.lit(float(d2)) * (F.col("n_time") / scale - F.col("e_time") / scale)).cast("int")
    if mode == "batch":
        dx = F.col("n_centerx").cast("long") - F.col("e_centerx")
        dy = F.col("n_centery").cast("long") - F.col("e_centery")
        close = int_distance(dx, dy) <= radius
    else:
        close = _squared_distance() <= long_square(radius)
    near = (
        _in_band()
        & close
        & (F.abs(F.col("n_averageDist") - F.col("e_averageDist")) <= F.lit(float(d_radius)))
        & (F.abs(F.col("n_pixelSum") - F.col("e_pixelSum")) <= d_sum)
    )
    sides = [
        _banded(_renamed(rows, p, columns), p, bands, lambda s: int(math.floor(d2 * (s / t))) + 1)
        for rows, p in ((later, "n_"), (obs, "e_"))
    ]
    joined = grid_join(*sides, [*_band_dims(), bright], near, BAND_KEY, hot_rows=hot_rows)
    return joined.select(
        F.col("n_obsid").alias("new_obsid"),
        F.col("e_obsid").alias("existing_obsid"),
        F.col("n_time").alias("new_time"),
        F.col("e_time").alias("existing_time"),
    )


def pair_count(pairs: DataFrame, d2: float, t: int) -> DataFrame:
    """Number of pairs, labelled with the parameters that produced them."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).select(
        F.lit(float(d2)).alias("d2"), F.lit(int(t)).alias("t"), "pairs"
    )
