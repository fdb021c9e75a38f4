"""Table layouts.  Ids are LONG: a large survey has more observations than an INT can number."""

from __future__ import annotations

from pyspark.sql import types as T

PIXEL_ATTRS = ["pix", "var", "valid", "sat", "v0", "v1", "v2", "v3", "v4", "v5", "v6"]


def _ints(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.IntegerType()) for name in names]


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.LongType()) for name in names]


#: One line of a raster text file, in column order.
RASTER_TEXT = T.StructType(_ints("tile", "x", "y", *PIXEL_ATTRS))
#: All pixels of all images in one table.
PIXELS = T.StructType(_ints("imageid", "tile", "x", "y", *PIXEL_ATTRS))
IMAGES = T.StructType(
    _ints("imageid", "xstart", "ystart", "xend", "yend", "time", "cycle")
    + [T.StructField("tablename", T.StringType())]
)
POSITIONS = T.StructType(_ints("t", "x", "y") + [T.StructField("filename", T.StringType())])
VERTEX = T.StructType(_ints("x", "y"))
BOX = ["boxxstart", "boxystart", "boxxend", "boxyend"]
OBS_SCALARS = T.StructType(
    _longs("obsid")
    + _ints("imageid", "time", "cycle")
    + [T.StructField("averageDist", T.DoubleType())]
    + _longs("pixelSum")
    + _ints("centerx", "centery", *BOX)
)
OBSERVATIONS = T.StructType(OBS_SCALARS.fields + [T.StructField("polygon", T.ArrayType(VERTEX))])
OBS_VERTICES = T.StructType(_longs("obsid") + _ints("ord", "x", "y"))
PAIRS = T.StructType(_longs("new_obsid", "existing_obsid"))
MEMBERS = T.StructType(_longs("obsgroupid", "obsid"))
