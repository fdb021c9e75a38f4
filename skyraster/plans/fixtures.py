"""Images, observations and tiles derived from the given tables, as DataFrames.

The given tables hold no images, so rasters come from the vectors of ``embeddings`` and
observations from ``events``.  The same definitions as SQL text are in ``oracles.py``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Rect
from ..functions.tiles import idiv, tile_of
from ..operators.components import label_runs
from ..operators.cook import observations_of
from ..operators.groups import PackedMembers, accumulate, group_summary, pack, step_boxes
from ..operators.pairs import MotionPairs, motion_pairs
from ..schema import BOX, PIXELS
from ..session import materialize, scratch_path
from ..sources import box_layout
from ..sources.generator import rescaled
from ..sources.layout import read_raster, write_raster
from ..sources.raster_text import image_name

TILE_SIZE = 10
ROWS = 100
COLUMNS = 64
WORLD = 1000
IMAGE_SIDE = 100
IMAGE_RANGE = 900
X_REPEAT = 70
# Rows of a base tile; ten tiles are a set, and ten images are made of each set.
TILE_ROWS = 50
SET_IMAGES = 10
GAP_Y = 10
# Small bands, so that regions cross their borders.
BAND_ROWS = 32
THRESHOLD = 14000
LOW_THRESHOLD = 13500
D2, T = 3, 3
RASTER_D2, RASTER_T = 2, 2
#: Ids kept for each piece of the raster that is cooked on its own.
ID_BLOCK = 10_000_000
START_DAY = "2024-01-01"


@dataclass
class SkyTables:
    """Derived tables of one data folder.  Tables that the queries take as loaded (observations,
    groups) are built once per session and stored."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def pixels(self) -> DataFrame:
        """One image per hundred vectors: a vector is an image row, its components the pixels."""
        value = F.greatest(F.least(F.floor((F.col("v").cast("double") + F.lit(0.6)) * F.lit(20000.0)), F.lit(65535)), F.lit(0))
        base = (
            self.table("embeddings")
            .select("vec_id", F.posexplode("embedding").alias("x", "v"))
            .select(
                idiv(F.col("vec_id"), ROWS).cast("int").alias("imageid"),
                (F.col("vec_id") % ROWS).cast("int").alias("y"),
                F.col("x"),
                value.cast("int").alias("pix"),
            )
        )
        pix, x, y = F.col("pix"), F.col("x"), F.col("y")
        return base.withColumns(
            {
                "tile": tile_of(x, y, TILE_SIZE),
                "var": F.sqrt(pix.cast("double")).cast("int"),
                "valid": F.when(pix % 17 != 0, 1).otherwise(0),
                "sat": F.when(pix >= 15000, 1).otherwise(0),
                "v0": rescaled(pix),
                "v1": pix + x,
                "v2": pix + y,
                "v3": pix - 30000,
                "v4": x - y,
                "v5": F.col("imageid"),
                "v6": pix % 2,
            }
        ).select(*PIXELS.fieldNames())

    @property
    def images(self) -> DataFrame:
        i = F.col("imageid")
        ids = self.table("embeddings").select(idiv(F.col("vec_id"), ROWS).cast("int").alias("imageid")).distinct()
        return ids.select(
            i,
            (i * 37).alias("xstart"),
            (i * 23).alias("ystart"),
            (i * 37 + COLUMNS).alias("xend"),
            (i * 23 + ROWS).alias("yend"),
            i.alias("time"),
            idiv(i, 2).cast("int").alias("cycle"),
            image_name(i).alias("tablename"),
        )

    @property
    def obs(self) -> DataFrame:
        """One observation per event, with the four corners of its box as outline."""
        e, u = F.col("event_id"), F.col("user_id")
        half = (e % 5 * 40 + 1).cast("int")
        x = ((u * 7919) % 10000 + 500 + (e * 31) % 41 - 20).cast("int")
        y = ((u * 104729) % 10000 + 500 + (e * 17) % 43 - 21).cast("int")
        day = F.datediff(F.col("ts").cast("timestamp_ntz").cast("date"), F.lit(START_DAY).cast("date"))
        base = self.table("events").select(
            (e + 1).alias("obsid"),
            day.alias("imageid"),
            day.alias("time"),
            idiv(day, 5).cast("int").alias("cycle"),
            ((e % 1000) / F.lit(100.0)).alias("averageDist"),
            F.floor(F.col("value") * F.lit(100.0)).cast("long").alias("pixelSum"),
            x.alias("centerx"),
            y.alias("centery"),
            (x - half).alias("boxxstart"),
            (y - half).alias("boxystart"),
            (x + half).alias("boxxend"),
            (y + half).alias("boxyend"),
        )

        def corner(a: str, b: str):
            return F.struct(F.col(a).alias("x"), F.col(b).alias("y"))

        return base.withColumn(
            "polygon",
            F.array(
                corner("boxxstart", "boxystart"),
                corner("boxxend", "boxystart"),
                corner("boxxend", "boxyend"),
                corner("boxxstart", "boxyend"),
            ),
        )

    @property
    def obs_frames(self) -> DataFrame:
        """Catalog for ``obs``: one image per time that holds every centre."""
        return self._frames(F.col("time") + 400, F.col("time") + 400, 10200)

    @property
    def narrow_frames(self) -> DataFrame:
        """Catalog for the candidate search: images that hold only a part of the centres."""
        return self._frames((F.col("time") * 317) % 7000 + 500, (F.col("time") * 211) % 7000 + 500, 3000)

    def _frames(self, x, y, side: int) -> DataFrame:
        times = self.obs.select("time", "cycle").distinct()
        return times.select(
            F.col("time").alias("imageid"),
            x.alias("xstart"),
            y.alias("ystart"),
            (x + side).alias("xend"),
            (y + side).alias("yend"),
            "time",
            "cycle",
        )

    @property
    def base_tiles(self) -> DataFrame:
        """Vectors dealt to the ten tiles of a set in turn; the last set may lack rows, which are 0."""
        value = F.greatest(F.least(F.floor((F.col("v").cast("double") + F.lit(0.6)) * F.lit(20000.0)), F.lit(65535)), F.lit(0))
        return self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("tx", "v")).select(
            idiv(F.col("vec_id"), 10 * TILE_ROWS).cast("int").alias("tile_set"),
            (F.col("vec_id") % 10).cast("int").alias("tile_num"),
            F.col("tx"),
            idiv(F.col("vec_id") % (10 * TILE_ROWS), 10).cast("int").alias("ty"),
            value.cast("int").alias("pix"),
        )

    @property
    def image_times(self) -> DataFrame:
        """One generated image per fifty vectors."""
        return self.table("embeddings").select(idiv(F.col("vec_id"), 50).cast("int").alias("t")).distinct()

    @property
    def event_times(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").cast("int").alias("t"))

    # Stored tables -------------------------------------------------------------------------------

    @cached_property
    def stored_obs(self) -> DataFrame:
        return materialize(self.obs, "fixture-obs")

    @cached_property
    def obs_store(self) -> str:
        """Observations by cycle, in the order of their place."""
        path = scratch_path(self.spark, "fixture-obs-boxes")
        box_layout.write_boxes(self.stored_obs, path, BOX, [("centerx", "centery")], ["cycle"])
        return path

    def obs_near(self, rect: Rect) -> DataFrame:
        return box_layout.meeting(self.spark, self.obs_store, rect).select(*self.stored_obs.columns)

    @cached_property
    def groups_store(self) -> str:
        path = scratch_path(self.spark, "fixture-group-boxes")
        box_layout.write_boxes(self.stored_summary, path, ["minx", "miny", "maxx", "maxy"])
        return path

    def groups_near(self, rect: Rect) -> DataFrame:
        return box_layout.meeting(self.spark, self.groups_store, rect)

    @cached_property
    def stored_raster(self) -> DataFrame:
        path = scratch_path(self.spark, "fixture-raster")
        write_raster(self.pixels, self.images, path)
        return read_raster(self.spark, path)

    @cached_property
    def stored_pairs(self) -> DataFrame:
        return materialize(motion_pairs(self.stored_obs, self.stored_obs, D2, T), "fixture-pairs")

    @property
    def moving(self) -> MotionPairs:
        """The pairs of ``stored_pairs``, found where they are followed."""
        return MotionPairs(self.stored_obs, D2, T)

    @cached_property
    def stored_members(self) -> PackedMembers:
        """Written by the sweep, packed."""
        return pack(self.moving)

    @cached_property
    def stored_summary(self) -> DataFrame:
        return materialize(group_summary(self.stored_members, self.stored_obs), "fixture-groups")

    @cached_property
    def labelled(self) -> DataFrame:
        return materialize(label_runs(self.pixels, THRESHOLD, BAND_ROWS), "fixture-labels")

    @cached_property
    def cooked_obs(self) -> DataFrame:
        """Observations found in the raster, without a limit on the outline."""
        return materialize(observations_of(self.labelled, self.images, None), "fixture-cooked")

    @cached_property
    def cooked_members(self) -> DataFrame:
        pairs = motion_pairs(self.cooked_obs, self.cooked_obs, RASTER_D2, RASTER_T)
        return materialize(accumulate(pairs), "fixture-cooked-members")

    @cached_property
    def cooked_summary(self) -> DataFrame:
        return materialize(group_summary(self.cooked_members, self.cooked_obs), "fixture-cooked-groups")

    @cached_property
    def cooked_steps(self) -> DataFrame:
        return materialize(step_boxes(self.cooked_members, self.cooked_obs), "fixture-cooked-steps")


_sessions: dict[tuple[str, str], SkyTables] = {}


def sky_tables(spark: SparkSession, folder: str) -> SkyTables:
    """The derived tables of a folder; stored ones are shared by all queries of a session."""
    key = spark.sparkContext.applicationId, folder
    if key not in _sessions:
        _sessions[key] = SkyTables(spark, folder)
    return _sessions[key]
