"""Raster text files: one line of 14 integers per pixel, one file (or folder) per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PIXELS, POSITIONS, RASTER_TEXT

IMAGE_NAME = r"bench_(\d+)"


def image_name(imageid: Column) -> Column:
    """Numbers are padded to four digits; longer ones are written in full."""
    return F.format_string("bench_%04d", imageid)


def scan_raster_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of all raster text files below ``path``; the image number comes from the file name."""
    lines = spark.read.schema(RASTER_TEXT).option("recursiveFileLookup", "true").csv(path)
    number = F.regexp_extract(F.col("_metadata.file_path"), r".*" + IMAGE_NAME, 1).cast("int")
    return lines.select(number.alias("imageid"), *[F.col(f.name) for f in RASTER_TEXT.fields]).select(
        *PIXELS.fieldNames()
    )


def write_raster_csv(pixels: DataFrame, path: str) -> None:
    """One folder per image; many tasks may write one image."""
    columns = RASTER_TEXT.fieldNames()
    (
        pixels.withColumn("tablename", image_name(F.col("imageid")))
        .select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"), "tablename")
        .write.mode("errorifexists")
        .partitionBy("tablename")
        .text(path)
    )


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSITIONS).csv(path)


def image_catalog(positions: DataFrame, side: int, cycle_length: int = 20) -> DataFrame:
    """Image catalog of a position file: extent from the image side, time and cycle from the number."""
    t = F.col("t")
    return positions.select(
        t.alias("imageid"),
        F.col("x").alias("xstart"),
        F.col("y").alias("ystart"),
        (F.col("x") + side).cast("int").alias("xend"),
        (F.col("y") + side).cast("int").alias("yend"),
        t.alias("time"),
        F.floor(t / cycle_length).cast("int").alias("cycle"),
        image_name(t).alias("tablename"),
    )
