import random

import pytest
from brute import first_pixel, regions, walk
from pyspark.sql import functions as F

from skyraster.operators.components import label, label_runs
from skyraster.operators.cook import cook, cook_with_vertices, dedup_obs, number_objects, object_stats
from skyraster.operators.merge import merge_pieces
from skyraster.operators.outline import outline, region_boxes, short_outlines
from skyraster.session import materialize


def noise(width, height, share, seed):
    rng = random.Random(seed)
    return {(x, y) for x in range(width) for y in range(height) if rng.random() < share}


def snake(width, height):
    """One long region that winds through many bands."""
    bright = {(x, y) for y in range(0, height, 2) for x in range(width)}
    return bright | {((width - 1) if (y // 2) % 2 == 0 else 0, y) for y in range(1, height - 1, 2)}


def comb(width, height):
    return {(x, y) for x in range(0, width, 2) for y in range(height)} | {(x, height - 1) for x in range(width)}


def ring(size):
    return {(x, y) for x in range(size) for y in range(size) if x in (0, size - 1) or y in (0, size - 1)}


SHAPES = {
    0: noise(30, 40, 0.35, 1),
    1: noise(40, 30, 0.45, 2),
    2: noise(25, 25, 0.2, 3),
    3: snake(21, 33),
    4: comb(31, 17),
    5: {(x, y) for x in range(20) for y in range(20)},
    6: ring(18) | {(9, 9)},
    7: {(5, 5)},
    8: {(i, i) for i in range(30)} | {(i, 29 - i) for i in range(30)},
    9: {(x, 3) for x in range(90)},
    10: noise(70, 70, 0.62, 5),
}


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(image, x, y, 100 + (x * 7 + y * 3) % 50) for image, shape in SHAPES.items() for x, y in shape]
    dim = [(0, x, 50, 10) for x in range(30)]
    return materialize(spark.createDataFrame(rows + dim, "imageid int, x int, y int, pix int"), "test-pixels")


@pytest.fixture(scope="module")
def images(spark):
    rows = [(image, 1000 * image, 10 * image, 1000 * image + 100, 10 * image + 100, image, image // 3) for image in SHAPES]
    return spark.createDataFrame(rows, "imageid int, xstart int, ystart int, xend int, yend int, time int, cycle int")


@pytest.fixture(scope="module")
def expected():
    return {(image, *first_pixel(r)): r for image, shape in SHAPES.items() for r in regions(shape)}


@pytest.mark.parametrize("band_rows", [1, 4, 128])
def test_labels(pixels, expected, band_rows):
    found = {}
    for row in label(pixels, 100, band_rows).collect():
        found.setdefault((row.imageid, row.first_y, row.first_x), set()).add((row.x, row.y))
    assert found == expected


def outlines_of(frame):
    found = {}
    for row in frame.collect():
        found.setdefault((row.imageid, row.label >> 32, row.label & 0xFFFFFFFF), {})[row.ord] = (row.x, row.y)
    return {key: [v[i] for i in range(len(v))] for key, v in found.items()}


@pytest.fixture(scope="module")
def labelled(pixels):
    return materialize(label_runs(pixels, 100, 8), "test-labels")


@pytest.mark.parametrize("small_side", [0, 6, 62])
def test_outline(labelled, expected, small_side):
    """Walking in batches, by link doubling, and both together give the same vertices."""
    found = outlines_of(outline(labelled, small_side=small_side))
    assert found == {key: walk(region) for key, region in expected.items()}


@pytest.mark.parametrize("limit", [4, 50, 200])
def test_short_outlines(labelled, expected, limit):
    found = {
        (r.imageid, r.label >> 32, r.label & 0xFFFFFFFF): [(p.x, p.y) for p in r.polygon]
        for r in short_outlines(labelled, region_boxes(labelled), limit).collect()
    }
    walks = {key: walk(region) for key, region in expected.items()}
    assert found == {key: path for key, path in walks.items() if len(path) <= limit}


def test_outline_box_is_pixel_box(expected):
    for region in expected.values():
        path = walk(region)
        for axis in (0, 1):
            assert min(p[axis] for p in path) == min(p[axis] for p in region)
            assert max(p[axis] for p in path) == max(p[axis] for p in region)


def test_ids_are_dense_and_in_raster_order(labelled, expected):
    boxes = region_boxes(labelled)
    rows = number_objects(boxes, start_id=11).orderBy("obsid").collect()
    assert [r.obsid for r in rows] == list(range(11, 11 + len(expected)))
    keys = [(r.imageid, r.label) for r in rows]
    assert keys == sorted(keys)


def test_cook_one_image_and_world_shift(pixels, images, expected):
    assert {r.boxxstart for r in cook(pixels, images, 100, imageid=6).collect()} == {6009}
    rows = cook(pixels, images, 100, max_vertices=70, imageid=6).collect()
    square = next(r for r in rows if r.boxxstart == 6000)
    assert [(p.x, p.y) for p in square.polygon] == [(x + 6000, y + 60) for x, y in walk(ring(18))]
    spot = next(r for r in rows if r.boxxstart == 6009)
    assert (spot.centerx, spot.centery, spot.averageDist, spot.time, spot.cycle) == (6009, 69, 0.0, 6, 2)


def test_vertices_without_limit(pixels, images, expected):
    obs, vertices = cook_with_vertices(pixels, images, 100, max_vertices=None)
    assert obs.count() == len(expected)
    assert vertices.count() == sum(len(walk(r)) for r in expected.values())


@pytest.mark.parametrize("hot_pixels", [30, 4_000_000])
def test_statistics(labelled, expected, hot_pixels):
    def value(x, y):
        return 100 + (x * 7 + y * 3) % 50

    found = {(r.imageid, r.label >> 32, r.label & 0xFFFFFFFF): r for r in object_stats(labelled, hot_pixels).collect()}
    assert set(found) == set(expected)
    for key, region in expected.items():
        total = sum(value(*p) for p in region)
        cx, cy = (sum(value(*p) * p[i] for p in region) / total for i in (0, 1))
        spread = sum(value(x, y) * ((x - cx) ** 2 + (y - cy) ** 2) ** 0.5 for x, y in region) / total
        row = found[key]
        assert (row.n, row.pixelSum, row.centerx, row.centery) == (len(region), total, int(cx), int(cy))
        assert row.averageDist == pytest.approx(spread, abs=1e-9)


def test_pieces_with_id_blocks_merge_to_the_whole(pixels, images):
    """Images cooked by two nodes, each with its own block of ids, one image cooked twice."""
    whole = cook(pixels, images, 100)
    low = cook(pixels.filter("imageid < 4"), images, 100)
    first = low.count() + 1
    high = cook(pixels.filter("imageid >= 4"), images, 100, start_id=first)
    again = cook(pixels.filter("imageid < 2"), images, 100)
    merged = merge_pieces([low, high, again], ["obsid"])
    columns = [c for c in whole.columns if c != "averageDist"]

    def rows(frame):
        return sorted(str(r) for r in frame.select(*columns).collect())

    assert rows(merged) == rows(whole)


def test_dedup_keeps_first_of_many_copies(spark):
    rows = spark.range(20000).select((F.col("id") % 3 * 0 + 1).alias("obsid"), (20000 - F.col("id")).alias("line"))
    assert [tuple(r) for r in dedup_obs(rows, ["line"]).collect()] == [(1, 1)]
