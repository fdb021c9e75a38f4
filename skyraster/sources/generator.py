"""Synthetic images as a pure function of (x, y, t) and sets of ten base tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bench_random import bench_rand, bench_rand_norm
from ..functions.tiles import TILE_RATIO, TILE_SIZE, idiv, tile_of
from ..schema import PIXELS
from .raster_text import image_name

# Fixed values of the data set.
WORLD_SIZE = 1_000_000
TILE_SEQUENCE = (
    "31415926535897932384626433832795028841971693993751058209749445923078164062862089986280348253421170679"
)
#: name: (images, side, range of corner positions)
SIZES = {
    "tiny": (10, 1000, 1200),
    "very-small": (40, 1600, 3162),
    "small": (160, 3750, 10000),
    "normal": (400, 7500, 31623),
    "large": (1000, 15000, 100000),
    "very-large": (2500, 30000, 316228),
}
#: name: (offset, scale) of the random attributes v1..v6
NOISE = [(0, 65535), (32768, 32768), (-500_000_000, 1_000_000), (0, 10), (1000, 100), (1, 0.5)]
NOISE_SEEDS = 65359
MAX_PIX = 65535
CENTRAL_SHARE = 0.8
#: Pixels that one task generates, about.
PIXELS_PER_TASK = 4_000_000


def positions(times: DataFrame, total: int, side: int, range_: int, world: int = WORLD_SIZE) -> DataFrame:
    """Nominal corner of every image t (column ``t`` of ``times``).

    Four in five lie in the central range; the second half of the run repeats the first.
    """
    t = F.col("t").cast("long")
    half = total // 2
    seed = F.when(t >= half, t - half).otherwise(t) * 3

    def corner(offset: int) -> Column:
        r = bench_rand(seed + offset)
        central = (F.lit((world - range_) // 2) + r * (range_ - side)).cast("int")
        anywhere = (r * (world - side)).cast("int")
        return F.when(bench_rand(seed) < CENTRAL_SHARE, central).otherwise(anywhere)

    return times.select(
        F.col("t").cast("int").alias("t"), corner(1).alias("x"), corner(2).alias("y"), image_name(F.col("t")).alias("filename")
    )


def piece(frame: DataFrame, n: int, i: int, total: int, round_robin: bool = False, column: str = "t") -> DataFrame:
    """Piece ``i`` of ``n``: every n-th image, or a contiguous range of them."""
    t = F.col(column)
    if round_robin:
        return frame.filter(F.pmod(t, F.lit(n)) == i)
    return frame.filter((t >= total * i // n) & (t < total * (i + 1) // n))


def _shifted(value: Column, step: Column) -> Column:
    return F.greatest(value + step - 1, F.lit(0))


def noise_table(frame: DataFrame) -> DataFrame:
    """The random attributes v1..v6 of every noise seed."""
    seeds = frame.sparkSession.range(NOISE_SEEDS).withColumnRenamed("id", "_seed")
    return seeds.select(
        "_seed",
        *[
            (F.lit(float(mean)) + F.lit(float(scale)) * bench_rand_norm(F.col("_seed"), 6, k)).cast("int").alias(f"v{k}")
            for k, (mean, scale) in enumerate(NOISE, start=1)
        ],
    )


def _tile_rows(tiles: DataFrame, x_size: int) -> DataFrame:
    """Base tiles as one array of ``x_size`` pixel values per tile row; missing pixels are 0."""
    rows = tiles.groupBy("tile_set", "tile_num", "ty").agg(F.sort_array(F.collect_list(F.struct("tx", "pix"))).alias("_row"))
    known = F.map_from_entries("_row")
    spread = F.transform(F.sequence(F.lit(0), F.lit(x_size - 1)), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(0)))
    dense = F.col("_row")["pix"]
    return rows.select("tile_set", "tile_num", "ty", F.when(F.size("_row") == x_size, dense).otherwise(spread).alias("_row"))


def gen_pixels(
    corners: DataFrame,
    tiles: DataFrame,
    side: int,
    x_size: int,
    y_size: int,
    x_repeat: int,
    y_repeat: int,
    world: int = WORLD_SIZE,
    tile_size: int = TILE_SIZE,
    ratio: int = TILE_RATIO,
    tasks: int | None = None,
) -> DataFrame:
    """All pixels of the images in ``corners`` (t, x, y), from ``tiles`` (tile_num, tx, ty, pix).

    With a column ``tile_set`` in both, an image is made of the tiles of its own set.

    An image row is cut where the base tile changes.  These segments, not pixels, are joined with
    the tile rows, and are expanded to pixels behind the join: what is shuffled is a few dozen bytes
    per segment.  ``tasks`` is a stated number of partitions (default: by the number of pixels, but not fewer than
    the session's shuffle partitions), because adaptive execution would merge them by the size of the segments.
    """
    if tasks is None:
        least = int(corners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(least, -(-corners.count() * side * side // PIXELS_PER_TASK))
    if "tile_set" not in corners.columns:
        corners, tiles = (frame.withColumn("tile_set", F.lit(0)) for frame in (corners, tiles))
    rows = corners.select(
        "tile_set",
        F.col("t").cast("long").alias("t"),
        _shifted(F.col("x"), F.col("t") % 3).alias("_x0"),
        _shifted(F.col("y"), idiv(F.col("t"), 3) % 3).alias("_y0"),
        F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y"),
    ).withColumn("_wy", F.col("y") + F.col("_y0"))
    columns = F.sequence(idiv(F.col("_x0"), x_repeat), idiv(F.col("_x0") + (side - 1), x_repeat))
    segments = rows.withColumn("_column", F.explode(columns)).withColumns(
        {
            "_place": (F.col("_column") + idiv(F.col("_wy"), y_repeat) * (world // x_repeat + 1)) % len(TILE_SEQUENCE),
            "ty": (F.col("_wy") % y_repeat).cast("int"),
            "_from": F.greatest(F.col("_x0"), F.col("_column") * x_repeat),
            "_to": F.least(F.col("_x0") + side, (F.col("_column") + 1) * x_repeat) - 1,
        }
    )
    segments = segments.withColumn(
        "tile_num", F.substring(F.lit(TILE_SEQUENCE), (F.col("_place") + 1).cast("int"), F.lit(1)).cast("int")
    ).repartition(tasks, "tile_set", "tile_num", "ty")
    base = _tile_rows(tiles.filter((F.col("tx") < x_size) & (F.col("ty") < y_size)), x_size)
    spots = (
        segments.join(base, ["tile_set", "tile_num", "ty"], "left")
        .withColumn("_wx", F.explode(F.sequence("_from", "_to")))
        .withColumns(
            {"x": (F.col("_wx") - F.col("_x0")).cast("int"), "tx": (F.col("_wx") - F.col("_column") * x_repeat).cast("int")}
        )
    )
    inside = (F.col("tx") < x_size) & (F.col("ty") < y_size)
    found = spots.select(
        F.col("t").cast("int").alias("imageid"),
        tile_of(F.col("x"), F.col("y"), tile_size, ratio).alias("tile"),
        "x",
        "y",
        F.when(inside, 1).otherwise(0).alias("valid"),
        F.when(inside, F.coalesce(F.get("_row", F.col("tx")), F.lit(0))).otherwise(0).alias("_raw"),
        ((F.col("t") % 5 - 2) * 10).cast("int").alias("_fudge"),
        ((F.col("t") * 3141 + F.col("_wx") * 592 + F.col("_wy")) % NOISE_SEEDS).alias("_seed"),
    )
    fudged = F.least(F.greatest(F.col("_raw") + F.col("_fudge"), F.lit(0)), F.lit(MAX_PIX)).cast("int")
    out = found.withColumns({"sat": F.when(F.col("_raw") == MAX_PIX, 1).otherwise(0), "pix": fudged})
    out = out.withColumns({"var": F.sqrt(F.col("pix").cast("double")).cast("int"), "v0": rescaled(F.col("pix"))})
    # The noise has NOISE_SEEDS different rows whatever the number of pixels: a broadcast of fixed size.
    return out.join(F.broadcast(noise_table(corners)), "_seed").select(*PIXELS.fieldNames())


def rescaled(pix: Column) -> Column:
    """Background-subtracted and stretched pixel value, not below 0."""
    return F.greatest(((pix - 3000) * F.lit(65535.0) / F.lit(62535.0)).cast("int"), F.lit(0))
