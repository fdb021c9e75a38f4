"""Binary rasters: little-endian int32, row-major.

Two layouts: ``record`` keeps the 11 attributes of a pixel together, ``attribute`` has one file per
attribute.  A file is named ``bench_<image>`` or, when it holds the rows from y on only,
``bench_<image>_y<first row>``; the attribute layout appends ``_<attribute>``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.tiles import TILE_RATIO, TILE_SIZE, tile_of
from ..schema import PIXEL_ATTRS
from ..session import qualified

FORMAT = "raster_binary"
FILE_NAME = re.compile(r"bench_(\d+)(?:_y(\d+))?(?:_(" + "|".join(PIXEL_ATTRS) + r"))?$")
INT = np.dtype("<i4")
BATCH_RECORDS = 65_536


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class RasterSlice(InputPartition):
    """Records [start, start + count) of one file, or of the same range of several attribute files."""

    imageid: int
    first_row: int
    files: dict[str, str]
    start: int
    count: int


class RasterBinaryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.width = int(options["width"])
        self.layout = options.get("layout", "record")
        self.attrs = [a for a in options.get("attrs", ",".join(PIXEL_ATTRS)).split(",") if a]
        self.slice_bytes = int(options.get("slicebytes", str(64 << 20)))

    def partitions(self) -> list[RasterSlice]:
        system, base = _filesystem(self.root)
        groups: dict[tuple[int, int], dict[str, str]] = {}
        sizes: dict[str, int] = {}
        for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
            match = FILE_NAME.match(info.base_name)
            if info.type != fs.FileType.File or not match:
                continue
            attr = match.group(3) or ""
            if (self.layout == "attribute") != bool(attr) or (attr and attr not in self.attrs):
                continue
            key = int(match.group(1)), int(match.group(2) or 0)
            groups.setdefault(key, {})[attr] = info.path
            sizes[info.path] = info.size
        record = INT.itemsize * (1 if self.layout == "attribute" else len(PIXEL_ATTRS))
        per_slice = max(1, self.slice_bytes // (INT.itemsize * len(PIXEL_ATTRS)))
        slices = []
        for (imageid, first_row), files in sorted(groups.items()):
            lengths = {sizes[p] for p in files.values()}
            missing = self.layout == "attribute" and set(files) != set(self.attrs)
            if missing or len(lengths) != 1 or next(iter(lengths)) % record:
                raise ValueError(f"incomplete raster files for image {imageid} from row {first_row}")
            total = next(iter(lengths)) // record
            slices += [
                RasterSlice(imageid, first_row, files, at, min(per_slice, total - at))
                for at in range(0, total, per_slice)
            ]
        return slices

    def read(self, part: RasterSlice) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.root)
        fields = 1 if self.layout == "attribute" else len(PIXEL_ATTRS)
        streams = {name: system.open_input_file(path) for name, path in part.files.items()}
        try:
            for at in range(part.start, part.start + part.count, BATCH_RECORDS):
                rows = min(BATCH_RECORDS, part.start + part.count - at)
                values = {}
                for name, stream in streams.items():
                    stream.seek(at * fields * INT.itemsize)
                    block = np.frombuffer(stream.read(rows * fields * INT.itemsize), dtype=INT).reshape(-1, fields)
                    if self.layout == "attribute":
                        values[name] = block[:, 0]
                    else:
                        values.update({a: block[:, PIXEL_ATTRS.index(a)] for a in self.attrs})
                position = np.arange(at, at + rows, dtype=np.int64) + part.first_row * self.width
                arrays = [
                    np.full(rows, part.imageid, dtype=np.int32),
                    (position % self.width).astype(np.int32),
                    (position // self.width).astype(np.int32),
                    *[np.ascontiguousarray(values[a]) for a in self.attrs],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int32()) for a in arrays], names=["imageid", "x", "y", *self.attrs]
                )
        finally:
            for stream in streams.values():
                stream.close()


class RasterBinarySource(DataSource):
    """Options: path, width, layout (record | attribute), attrs, slicebytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        attrs = self.options.get("attrs", ",".join(PIXEL_ATTRS)).split(",")
        return ", ".join(f"{c} int" for c in ["imageid", "x", "y", *[a for a in attrs if a]])

    def reader(self, schema) -> DataSourceReader:
        return RasterBinaryReader(dict(self.options))


def scan_raster_binary(
    spark: SparkSession,
    path: str,
    width: int,
    layout: str = "record",
    attrs: list[str] | None = None,
    tile_size: int = TILE_SIZE,
    ratio: int = TILE_RATIO,
    slice_bytes: int = 64 << 20,
) -> DataFrame:
    """Pixels of binary raster files, read in byte ranges.  With the attribute layout only the files
    of ``attrs`` are opened."""
    spark.dataSource.register(RasterBinarySource)
    attrs = attrs or PIXEL_ATTRS
    rows = (
        spark.read.format(FORMAT)
        .option("width", width)
        .option("layout", layout)
        .option("attrs", ",".join(attrs))
        .option("slicebytes", slice_bytes)
        .load(qualified(spark, path))
    )
    return rows.select(
        "imageid", tile_of(F.col("x"), F.col("y"), tile_size, ratio).alias("tile"), "x", "y", *attrs
    )


def write_raster_binary(
    pixels: DataFrame, path: str, width: int, layout: str = "record", band_rows: int = 64, images: DataFrame | None = None
) -> DataFrame:
    """Write bands of ``band_rows`` image rows, each as its own file; returns (imageid, first_row, rows).

    A group is one band, so no task holds a whole image.  Pixels that are absent are written as 0: with
    ``images``, the catalog, in all rows of each image, without it up to the last row of a band that has
    a pixel.  A column beyond ``width`` is an error.  Files are moved into place when complete, so a repeated task leaves one whole file.
    """
    path = qualified(pixels.sparkSession, path)

    def write_band(key: tuple, band: pd.DataFrame) -> pd.DataFrame:
        imageid, number = int(key[0]), int(key[1])
        first_row = number * band_rows
        height = band["_height"].max()
        band = band[band["x"].notna()]
        rows = min(band_rows, int(height) - first_row) if height == height else int(band["y"].max()) - first_row + 1
        y, x = band["y"].to_numpy().astype(np.int64) - first_row, band["x"].to_numpy().astype(np.int64)
        if len(x) and (x.min() < 0 or x.max() >= width or y.max() >= rows):
            raise ValueError(f"image {imageid} has pixels outside its {width} columns or its rows")
        block = np.zeros((rows * width, len(PIXEL_ATTRS)), dtype=INT)
        block[y * width + x] = band[PIXEL_ATTRS].to_numpy()
        system, base = _filesystem(path)
        system.create_dir(base, recursive=True)
        name = f"{base}/bench_{imageid:04d}_y{first_row:08d}"
        parts = {"": block} if layout == "record" else {
            f"_{a}": np.ascontiguousarray(block[:, i]) for i, a in enumerate(PIXEL_ATTRS)
        }
        for suffix, data in parts.items():
            unfinished = f"{base}/.{uuid.uuid4().hex}"
            with system.open_output_stream(unfinished) as stream:
                stream.write(data.tobytes())
            system.move(unfinished, name + suffix)
        return pd.DataFrame({"imageid": [imageid], "first_row": [first_row], "rows": [rows]})

    rows = pixels.select("imageid", "x", "y", *PIXEL_ATTRS, F.lit(None).cast("int").alias("_height"))
    if images is not None:
        height = (F.col("yend") - F.col("ystart")).cast("int")
        starts = F.sequence(F.lit(0), height - 1, F.lit(band_rows))
        empty = images.filter(height > 0).select("imageid", height.alias("_height"), F.explode(starts).alias("y"))
        rows = rows.unionByName(empty, allowMissingColumns=True)
    return (
        rows
        .groupBy("imageid", F.floor(F.col("y") / band_rows).alias("band"))
        .applyInPandas(write_band, "imageid int, first_row int, rows int")
    )
