"""Stored raster: Parquet by cycle, image and band of tile rows, clustered by tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tiles import TILE_RATIO, band_of
from ..schema import PIXELS

FOLDERS = ["cycle", "imageid", "band"]
SORT = [*FOLDERS, "tile", "y", "x"]


def write_raster(pixels: DataFrame, images: DataFrame, path: str, ratio: int = TILE_RATIO) -> None:
    """Range partitioning on (image, tile) gives every task a contiguous part of an image, so large
    images are written by many tasks and each file covers few tiles: a box reads few folders and row groups.  The ranges are
    sampled first, so pixels that are costly to make should be materialized by the caller."""
    (
        pixels.join(images.select("imageid", "cycle"), "imageid")
        .withColumn("band", band_of(F.col("tile"), ratio))
        .repartitionByRange(*SORT[:4])
        .sortWithinPartitions(*SORT)
        .write.mode("errorifexists")
        .partitionBy(*FOLDERS)
        .parquet(path)
    )


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """The stored raster; filters on cycle, imageid and band prune folders, on tile row groups."""
    fields = [f for f in PIXELS.fields if f.name != "imageid"]
    schema = T.StructType([*fields, *[T.StructField(name, T.IntegerType()) for name in FOLDERS]])
    return spark.read.schema(schema).parquet(path).select(*PIXELS.fieldNames(), "cycle", "band")


def place_images(pixels: DataFrame, nodes: int) -> DataFrame:
    """Round-robin placement of images over ``nodes`` partitions, with the partition as a column."""
    node = F.pmod(F.col("imageid"), F.lit(nodes)).cast("int")
    return pixels.withColumn("node", node).repartition(nodes, "node")
