import random

import pytest
from pyspark.sql import functions as F

from skyraster.functions.bench_random import bench_rand, bench_rand_norm
from skyraster.functions.tiles import box_tile_ranges, in_tile_ranges, tile_of
from skyraster.operators.cutouts import cutouts
from skyraster.operators.pixel_stats import merge_partials, q1, q1_partials
from skyraster.operators.regrid import regrid
from skyraster.plans.fixtures import COLUMNS, TILE_SIZE, sky_tables
from skyraster.plans.registry import queries
from skyraster.schema import PIXEL_ATTRS
from skyraster.session import materialize
from skyraster.sources import layout, raster_binary, raster_text

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pixels(spark):
    return materialize(sky_tables(spark, FOLDER).pixels, "test-raster")


@pytest.fixture(scope="module")
def images(spark):
    return materialize(sky_tables(spark, FOLDER).images, "test-catalog")


def lcg_uniform(t):
    for _ in range(10):
        t = (1103515245 * t + 12345) & 0x3FFFFFFF
    return t / float(1 << 30)


def test_random_numbers_step_by_step(spark):
    rng = random.Random(1)
    values = [0, 1, 65358 * 6 + 6, (1 << 30) - 1] + [rng.randrange(1 << 22) for _ in range(200)]
    frame = spark.createDataFrame([(v,) for v in values], "t long")
    rows = frame.select("t", bench_rand(F.col("t")).alias("u"), bench_rand_norm(F.col("t")).alias("n"),
                        bench_rand_norm(F.col("t"), 6, 5).alias("m")).collect()
    for r in rows:
        assert r.u == lcg_uniform(r.t)
        assert r.n == sum(lcg_uniform(r.t * 12 + i) for i in range(12)) - 6
        assert r.m == sum(lcg_uniform((6 * r.t + 5) * 12 + i) for i in range(12)) - 6


@pytest.mark.parametrize("rect", [(0, 100, 0, 100), (7, 40, 13, 65), (95, 10, 199, 2), (0, 1, 0, 1), (5, 0, 0, 3)])
def test_tile_ranges_cover_the_box(spark, rect):
    xs, xl, ys, yl = rect
    ranges = box_tile_ranges(rect)
    need = {(y // 100) * 1000 + x // 100 for x in range(xs, xs + xl) for y in range(ys, ys + yl)}
    assert {t for low, high in ranges for t in range(low, high + 1)} == need
    frame = spark.range(4000).select(F.col("id").cast("int").alias("tile"))
    kept = {r.tile for r in frame.filter(in_tile_ranges(F.col("tile"), ranges)).collect()}
    assert kept == need


def test_partials_merge_to_the_global_average(pixels, images):
    direct = q1(pixels, images, 1, "pix").first()
    assert merge_partials(q1_partials(pixels, images, 1, "pix", 3)).first() == direct


def test_average_of_nothing(pixels, images):
    assert tuple(q1(pixels, images, 999, "pix").first()) == (0, 0, None)


def test_area_regrid_keeps_the_sum(pixels, images):
    before = {r.imageid: r.s * 9 for r in pixels.groupBy("imageid").agg(F.sum(F.col("pix").cast("long")).alias("s")).collect()}
    after = regrid(pixels, images).groupBy("imageid").agg(F.sum("pixavg").alias("s")).collect()
    assert {r.imageid: round(r.s * 100) for r in after} == before


def test_regrid_fills_missing_cells(pixels, images):
    few = pixels.filter((F.col("x") < 10) & (F.col("y") < 10))
    rows = regrid(few, images.filter("imageid = 0")).collect()
    assert len(rows) == 20 * 31
    assert all(r.pixavg == 0 and r.valid_and == 0 for r in rows if r.x > 3 or r.y > 3)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_text_round_trip(spark, pixels, tmp_path):
    path = str(tmp_path / "text")
    raster_text.write_raster_csv(pixels, path)
    assert rows_of(raster_text.scan_raster_csv(spark, path)) == rows_of(pixels)


@pytest.mark.parametrize("file_layout", ["record", "attribute"])
@pytest.mark.parametrize("slice_bytes", [1000, 1 << 26])
def test_binary_round_trip(spark, pixels, tmp_path, file_layout, slice_bytes):
    path = str(tmp_path / "binary")
    raster_binary.write_raster_binary(pixels, path, COLUMNS, file_layout, band_rows=30).count()
    found = raster_binary.scan_raster_binary(
        spark, path, COLUMNS, file_layout, tile_size=TILE_SIZE, slice_bytes=slice_bytes
    )
    assert rows_of(found) == rows_of(pixels)


def test_binary_bands_without_pixels(spark, tmp_path):
    """With the catalog, rows without pixels come back as 0, at the end of a band and in whole bands."""
    some = spark.createDataFrame([(1, 0, 1, *[5] * 11)], "imageid int, x int, y int, " + ", ".join(f"{a} int" for a in PIXEL_ATTRS))
    images = spark.createDataFrame([(1, 10, 20), (2, 0, 3)], "imageid int, ystart int, yend int")
    written = raster_binary.write_raster_binary(some, str(tmp_path / "all"), 2, band_rows=4, images=images).collect()
    assert sorted(tuple(r) for r in written) == [(1, 0, 4), (1, 4, 4), (1, 8, 2), (2, 0, 3)]
    rows = raster_binary.scan_raster_binary(spark, str(tmp_path / "all"), 2).collect()
    assert sorted((r.imageid, r.x, r.y, r.pix) for r in rows) == sorted(
        (i, x, y, 5 if (i, x, y) == (1, 0, 1) else 0) for i, high in ((1, 10), (2, 3)) for x in range(2) for y in range(high)
    )
    wide = some.withColumn("x", F.lit(2))
    with pytest.raises(Exception, match="outside its 2 columns"):
        raster_binary.write_raster_binary(wide, str(tmp_path / "wide"), 2).count()


def test_binary_whole_image_file(spark, tmp_path):
    """A file without a row suffix starts at row 0; records are 11 little-endian integers."""
    import numpy as np

    data = np.arange(6 * 11, dtype="<i4")
    (tmp_path / "bench_0012").write_bytes(data.tobytes())
    rows = raster_binary.scan_raster_binary(spark, str(tmp_path), 3).orderBy("y", "x").collect()
    assert [(r.imageid, r.x, r.y) for r in rows] == [(12, x, y) for y in range(2) for x in range(3)]
    assert [r.pix for r in rows] == [11 * i for i in range(6)]
    assert rows[5].v6 == 65


def test_incomplete_attribute_files_are_refused(spark, tmp_path):
    (tmp_path / "bench_0001_pix").write_bytes(b"\0" * 16)
    with pytest.raises(Exception, match="incomplete"):
        raster_binary.scan_raster_binary(spark, str(tmp_path), 2, "attribute", ["pix", "var"]).count()


def test_stored_raster_prunes(spark, pixels, images, tmp_path):
    path = str(tmp_path / "raster")
    layout.write_raster(pixels, images, path)
    stored = layout.read_raster(spark, path)
    assert rows_of(stored.drop("cycle", "band")) == rows_of(pixels)
    chosen = stored.filter("cycle = 1 and imageid = 2 and tile between 1001 and 1003").select("pix")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cycle" in plan and "GreaterThanOrEqual(tile,1001)" in plan
    assert "ReadSchema: struct<tile:int,pix:int>" in plan


def test_queries_prune_the_stored_raster(spark):
    """Q1 and Q3 read the folders of their cycle and band; Q8 and Q9 those that their tiles lie in."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    for name in ("q1_stored", "q3_stored", "q8_stored", "q9_stored"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        scan = next(line for line in plan.splitlines() if "fixture-raster" in line)
        filters = scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
        assert "band" in filters, (name, filters)
        if name in ("q8_stored", "q9_stored"):
            assert "dynamicpruningexpression(band" in filters, (name, filters)
        if name == "q1_stored":
            assert "cycle" in filters, (name, filters)


def test_images_are_placed_round_robin(pixels):
    placed = layout.place_images(pixels, 3).withColumn("part", F.spark_partition_id())
    rows = placed.select("imageid", "node", "part").distinct().collect()
    assert all(r.node == r.imageid % 3 for r in rows)
    assert len({r.imageid for r in rows}) == len(rows)


def test_cutouts_against_plain_python(spark, images):
    catalog = images.filter("imageid < 2")
    frames = {r.imageid: r for r in catalog.collect()}
    rng = random.Random(3)
    held = {(i, x, y): 1 + (x * 31 + y) % 97 for i in frames for x in range(64) for y in range(100) if rng.random() < 0.8}
    raster = spark.createDataFrame(
        [(i, x, y, p) for (i, x, y), p in held.items()], "imageid int, x int, y int, pix int"
    ).withColumn("tile", tile_of(F.col("x"), F.col("y"), 10))
    centres = [(n, rng.randrange(-8, 110), rng.randrange(-8, 130)) for n in range(25)]
    obs = spark.createDataFrame(centres, "obsid long, centerx int, centery int")
    expected, known = set(), set()
    for n, cx, cy in centres:
        for i, frame in frames.items():
            for x in range(max(0, cx - frame.xstart - 6), min(64, cx - frame.xstart + 6)):
                for y in range(max(0, cy - frame.ystart - 6), min(100, cy - frame.ystart + 6)):
                    row = (n, i, x + frame.xstart, y + frame.ystart, held.get((i, x, y), 0))
                    expected.add(row)
                    if (i, x, y) in held:
                        known.add(row)
    filled = cutouts(obs.select("obsid"), obs, catalog, raster, 6, tile_size=10, cell=50)
    assert rows_of(filled) == sorted(expected)
    present = cutouts(obs.select("obsid"), obs, catalog, raster, 6, fill=False, tile_size=10, cell=50)
    assert rows_of(present) == sorted(known)


def test_text_raster_keeps_long_ids_and_nulls(spark, tmp_path):
    """Image numbers of five digits are not cut, and a NULL does not shift the columns after it."""
    from skyraster.schema import PIXELS
    from skyraster.sources.raster_text import scan_raster_csv, write_raster_csv

    width = len(PIXELS.fieldNames()) - 1
    rows = [(i, *range(width)) for i in (7, 9999, 10000, 12340, 12345)]
    rows += [(12345, *[None if k == 3 else k + 1 for k in range(width)])]
    pixels = spark.createDataFrame(rows, PIXELS)
    write_raster_csv(pixels, str(tmp_path / "raster"))
    read = scan_raster_csv(spark, str(tmp_path / "raster"))
    assert sorted(map(str, read.collect())) == sorted(map(str, pixels.collect()))


def test_observation_file_keeps_full_doubles_and_nulls(spark, tmp_path):
    from skyraster.schema import OBSERVATIONS
    from skyraster.sources.observation_text import read_obs, write_obs

    scalars = [f for f in OBSERVATIONS.fields if f.name != "polygon"]
    names = [f.name for f in scalars]

    def row(distance, pixel_sum):
        values = {name: k for k, name in enumerate(names)}
        values |= {"averageDist": distance, "pixelSum": pixel_sum, "polygon": [(1, 2), (3, 4), (5, 6)]}
        return tuple(values[name] for name in OBSERVATIONS.fieldNames())

    obs = spark.createDataFrame([row(1 / 3, 5), row(None, None)], OBSERVATIONS)
    write_obs(obs, str(tmp_path / "obs"))
    assert sorted(map(str, read_obs(spark, str(tmp_path / "obs")).collect())) == sorted(map(str, obs.collect()))
