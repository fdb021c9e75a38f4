"""Pixel queries on a stored set of generated images.

Usage: python bench_images.py <empty folder> [images] [side]

Writes the images as a tile-clustered raster below the folder, then times queries on it and prints
one JSON line with seconds and pixels per second.  The default (10 images of 1000 x 1000) is the
smallest size of the generator.
"""

from __future__ import annotations

import json
import os
import sys
import time

from skyraster.operators.cook import cook
from skyraster.operators.pixel_stats import q1
from skyraster.operators.regrid import regrid
from skyraster.plans import fixtures as fx
from skyraster.plans.fixtures import sky_tables
from skyraster.session import build_session
from skyraster.sources import generator, layout, raster_text

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def main() -> None:
    target = sys.argv[1]
    images = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    side = int(sys.argv[3]) if len(sys.argv) > 3 else 1000
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench-images",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": "32", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"{target}/checkpoint"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sky = sky_tables(spark, FOLDER)
    times = spark.range(images).withColumnRenamed("id", "t")
    corners = generator.positions(times, images, side, side * 6 // 5)
    raster_text.image_catalog(corners, side).write.parquet(f"{target}/images")
    catalog = spark.read.parquet(f"{target}/images")
    seconds = {}

    def clock(name: str, run) -> None:
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)

    def consume(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    rows, tiles = fx.TILE_ROWS, sky.base_tiles.filter("tile_set = 0").drop("tile_set")
    pixels = generator.gen_pixels(corners, tiles, side, fx.COLUMNS, rows, fx.X_REPEAT, rows + fx.GAP_Y, tasks=64)
    clock("generate_and_store", lambda: layout.write_raster(pixels, catalog, f"{target}/raster"))
    raster = layout.read_raster(spark, f"{target}/raster")
    for name, run in {
        "q1_all": lambda: consume(q1(raster, catalog, 0, "pix")),
        "q1_box": lambda: consume(q1(raster, catalog, 0, "pix", (side // 10, side // 10, side // 10, side // 10))),
        "q3_area": lambda: consume(regrid(raster, catalog, 0)),
        "q3_compat": lambda: consume(regrid(raster, catalog, 0, mode="compat")),
        "q2_cook": lambda: consume(cook(raster, catalog, 14000)),
    }.items():
        clock(name, run)
    total = images * side * side
    print(json.dumps({"pixels": total, "seconds": seconds, "pixels_per_second": {k: round(total / v) for k, v in seconds.items()}}))


if __name__ == "__main__":
    main()
