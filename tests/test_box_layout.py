"""Stored boxes: the curve, what a slab returns, and how little of the files it reads."""

import random

import pytest
from pyspark.sql import functions as F

from skyraster.functions.curve import hilbert_key, key_ranges
from skyraster.functions.geometry import box_inside, box_overlaps, point_in_rect
from skyraster.sources import box_layout

BOX = ["minx", "miny", "maxx", "maxy"]


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_curve(spark, bits):
    """Every number once, neighbours on the curve are neighbours in the grid, and at any depth."""
    side = 1 << bits
    cells = spark.range(side * side).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    rows = cells.withColumn("key", hilbert_key(F.col("x"), F.col("y"), F.lit(bits))).orderBy("key").collect()
    assert [r.key for r in rows] == list(range(side * side))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))
    place = {(r.x, r.y): r.key for r in rows}
    rng = random.Random(bits)
    for most in (1, 3, 100):
        for _ in range(30):
            x0, y0 = rng.randrange(side), rng.randrange(side)
            x1, y1 = rng.randrange(x0, side), rng.randrange(y0, side)
            found = key_ranges((x0, y0, x1, y1), bits, most)
            wanted = sorted(place[x, y] for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
            assert len(found) <= most and all(any(a <= k <= b for a, b in found) for k in wanted)
            if most == 100:
                assert [k for a, b in found for k in range(a, b + 1)] == wanted
    assert key_ranges((1, 1, 0, 0), bits) == []


@pytest.fixture(scope="module")
def boxes(spark, tmp_path_factory):
    """Mostly small boxes, some large, negative corners, centres outside of their box, and rows without one."""
    side = F.when(F.col("id") % 97 == 0, 3000).when(F.col("id") % 11 == 0, 0).otherwise(F.col("id") % 60)
    x = F.pmod(F.col("id") * 7919, F.lit(20000)) - 5000
    y = F.pmod(F.col("id") * 104729, F.lit(20000)) - 5000
    rows = spark.range(60_000).select(
        "id", (F.col("id") % 3).alias("cycle"), x.cast("int").alias("minx"), y.cast("int").alias("miny"), (x + side).cast("int").alias("maxx"),
        (y + side * 2).cast("int").alias("maxy"), (x + F.col("id") % 200 - 50).cast("int").alias("cx"), (y + 3).cast("int").alias("cy"),
    )
    rows = rows.withColumn("minx", F.when(F.col("id") % 5000 != 7, F.col("minx")))
    path = str(tmp_path_factory.mktemp("boxes"))
    box_layout.write_boxes(rows, path, BOX, [("cx", "cy")], ["cycle"], row_group_bytes=1 << 15)
    return rows, path


@pytest.mark.parametrize("rect", [(0, 300, 0, 300), (-5100, 50, -5100, 40), (14000, 4000, -100, 0), (1, 0, 1, 0), (-9000, 90000, -9000, 90000)])
def test_slab(spark, boxes, rect):
    rows, path = boxes
    near = box_layout.meeting(spark, path, rect)
    assert near.columns == [c for c in rows.columns if c != "cycle"] + ["cycle"]
    box = [F.col(c) for c in BOX]
    for term in (box_overlaps(*box, rect), box_inside(*box, rect), point_in_rect(F.col("cx"), F.col("cy"), rect)):
        term = term & F.col("minx").isNotNull()
        assert sorted(r.id for r in near.filter(term).collect()) == sorted(r.id for r in rows.filter(term).collect())
    assert box_layout.read_boxes(spark, path).count() == 60_000


def scanned(frame):
    """Rows that the scan of an executed query gave."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    return total


def test_a_slab_reads_its_part(spark, boxes):
    """A hundredth of the sky reads a small part of the row groups, and of one folder only."""
    _, path = boxes
    rect = (2000, 2000, 2000, 2000)
    found = box_layout.meeting(spark, path, rect).filter(F.col("cycle") == 1).select("minx", "cycle")
    own = found.count()
    assert 100 < own < 1000
    assert scanned(found.select("minx")) < 20_000 / 4
    assert scanned(box_layout.read_boxes(spark, path).select("minx")) == 60_000


def test_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "minx int, miny int, maxx int, maxy int")
    box_layout.write_boxes(rows, str(tmp_path / "b"), BOX)
    assert box_layout.meeting(spark, str(tmp_path / "b"), (0, 1, 0, 1)).count() == 0
    with pytest.raises(ValueError):
        box_layout.meeting(spark, str(tmp_path / "none"), (0, 1, 0, 1))


def test_hilbert_key_in_batches(spark):
    """Numbers of cells in a grid of any width, equal to the walk bit by bit; rows are not walked one by one in the plan."""
    import random

    def plain(x, y, bits):
        key = flip = swap = 0
        for bit in range(bits - 1, -1, -1):
            one, other = (y, x) if swap else (x, y)
            rx, ry = (one >> bit & 1) ^ flip, (other >> bit & 1) ^ flip
            key, flip, swap = key * 4 + (rx * 3 ^ ry), flip ^ (rx & (1 - ry)), swap ^ (1 - ry)
        return key

    rng = random.Random(3)
    cells = [(rng.randrange(1 << b), rng.randrange(1 << b), b) for b in [*range(1, 32)] * 10] + [(None, 1, 5), (1, None, 5)]
    frame = spark.createDataFrame(cells, "x long, y long, bits int").withColumn("key", hilbert_key(F.col("x"), F.col("y"), F.col("bits")))
    for r in frame.collect():
        assert r.key == (None if r.x is None or r.y is None else plain(r.x, r.y, r.bits))
    assert "lambdafunction" not in frame._jdf.queryExecution().optimizedPlan().toString()
