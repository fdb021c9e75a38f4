"""Cutouts where all centres lie in one cell and all windows on few tiles."""

import pytest
from pyspark.sql import functions as F

from skyraster.functions.tiles import tile_of
from skyraster.operators import cutouts


@pytest.mark.parametrize("fill", [True, False])
def test_a_crowd_is_dealt_to_parts(spark, monkeypatch, fill):
    monkeypatch.setattr(cutouts, "HOT_ROWS", 4)
    monkeypatch.setattr(cutouts, "TILE_WINDOWS", 16)
    obs = spark.range(200).select("id", (F.col("id") + 1).alias("obsid"), (F.col("id") % 3 + 48).cast("int").alias("centerx"), F.lit(50).alias("centery"))
    images = spark.createDataFrame(
        [(i, 20 + i, 30 - i, 60 + i, 70 - i) for i in range(6)], "imageid int, xstart int, ystart int, xend int, yend int"
    )
    spots = spark.range(40 * 40).select((F.col("id") % 40).cast("int").alias("x"), F.floor(F.col("id") / 40).cast("int").alias("y"))
    pixels = images.select("imageid").join(spots, F.col("x") % 7 != F.col("imageid"))
    pixels = pixels.select("imageid", tile_of(F.col("x"), F.col("y"), 10).alias("tile"), "x", "y", (F.col("x") * 100 + F.col("y") + F.col("imageid")).alias("pix"))
    made = []
    keep = cutouts.materialize_counted
    monkeypatch.setattr(cutouts, "materialize_counted", lambda *a, **k: (lambda out: (made.append(out[1]), out)[1])(keep(*a, **k)))
    found = cutouts.cutouts(obs.select("obsid"), obs, images, pixels, 3, fill, tile_size=10, cell=64)
    got = sorted(map(tuple, found.select("obsid", "imageid", "x", "y", "pix").collect()))
    held = {(r.imageid, r.x, r.y): r.pix for r in pixels.collect()}
    expected = []
    for o in obs.collect():
        for i in images.collect():
            for x in range(max(0, o.centerx - i.xstart - 3), min(o.centerx - i.xstart + 3, 40)):
                for y in range(max(0, o.centery - i.ystart - 3), min(o.centery - i.ystart + 3, 40)):
                    if fill or (i.imageid, x, y) in held:
                        expected.append((o.obsid, i.imageid, x + i.xstart, y + i.ystart, held.get((i.imageid, x, y), 0)))
    assert got == sorted(expected)
    assert made[-1]["most"] >= 5  # the windows on one tile came in so many parts
