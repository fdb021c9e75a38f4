"""Outlines: the clockwise walk around a region.

The walk starts at the pixel with the lowest x, then lowest y, with the direction up-left, and at
every pixel takes the first neighbour found clockwise, beginning 45 degrees left of the last move
(90 degrees after a diagonal one).  It ends when start pixel and first direction come together
again; a walk of more than 2 + 2n steps is an error.  A one-pixel region has one vertex.

Two ways produce the same vertices.  Regions with short sides are walked in Arrow batches, all
regions of a batch in step.  Wide regions never come together in one task: their walk is a linked
list of (pixel, direction) states, and doubling the links gives each state its position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, materialize_counted

# The eight directions clockwise (y grows downward), from straight up.
DX = [0, 1, 1, 1, 0, -1, -1, -1]
DY = [-1, -1, 0, 1, 1, 1, 0, -1]
START_DIRECTION = 7

#: Regions up to this many pixels per side are walked as one row (an 8-byte mask per image row).
SMALL_SIDE = 62
#: Regions walked together in one step of the vectorised walk.
WALK_BATCH = 2048


def _first_search(direction: np.ndarray) -> np.ndarray:
    return (direction - np.where(direction % 2 == 1, 2, 1)) % 8


def _walk(masks: list[np.ndarray], limits: np.ndarray) -> list[np.ndarray]:
    """Vertices (relative x, y) of each region; ``masks`` are row bit masks, bit i = column i."""
    k = len(masks)
    height = max(len(m) for m in masks)
    rows = np.zeros((k, height), dtype=np.int64)
    for i, mask in enumerate(masks):
        rows[i, : len(mask)] = mask
    width = int(np.bitwise_or.reduce(rows.ravel())).bit_length()
    grid = np.zeros((k, height + 2, width + 2), dtype=bool)
    grid[:, 1:-1, 1:-1] = (rows[:, :, None] >> np.arange(width)) & 1
    turns = np.arange(8)
    dx, dy = np.array(DX), np.array(DY)
    # The first column is never empty; the start is its topmost pixel.
    x = np.ones(k, dtype=np.int64)
    y = np.argmax(grid[:, :, 1], axis=1)
    single = grid.sum(axis=(1, 2)) == 1

    def choose(which: np.ndarray, px: np.ndarray, py: np.ndarray, direction: np.ndarray) -> np.ndarray:
        order = (_first_search(direction)[:, None] + turns) % 8
        hit = grid[which[:, None], py[:, None] + dy[order], px[:, None] + dx[order]]
        return order[np.arange(len(which)), np.argmax(hit, axis=1)]

    path: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.arange(k), x - 1, y - 1)]
    active = np.flatnonzero(~single)
    cx, cy = x[active], y[active]
    move = choose(active, cx, cy, np.full(len(active), START_DIRECTION))
    sx, sy, smove = cx, cy, move
    steps = 1
    while len(active):
        cx, cy = cx + dx[move], cy + dy[move]
        move = choose(active, cx, cy, move)
        on = (cx != sx) | (cy != sy) | (move != smove)
        if (on & (steps > limits[active])).any():
            raise RuntimeError("the walk around a region does not close")
        active, cx, cy, move = active[on], cx[on], cy[on], move[on]
        sx, sy, smove = sx[on], sy[on], smove[on]
        path.append((active, cx - 1, cy - 1))
        steps += 1
    owner = np.concatenate([p[0] for p in path])
    order = np.argsort(owner, kind="stable")
    points = np.stack([np.concatenate([p[1] for p in path]), np.concatenate([p[2] for p in path])], axis=1)[order]
    return np.split(points, np.cumsum(np.bincount(owner, minlength=k))[:-1])


def _walk_batches(max_vertices: int | None):
    """Arrow function: one region per input row, one region with its vertex arrays per output row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, WALK_BATCH):
                batch = whole.slice(start, WALK_BATCH)
                lists = batch.column("masks")
                offsets = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)
                masks = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                sizes = batch.column("n").to_numpy()
                paths = _walk(masks, 2 + 2 * sizes)
                keep = np.array([max_vertices is None or len(p) <= max_vertices for p in paths], dtype=bool)
                minx = batch.column("minx").to_numpy()
                miny = batch.column("miny").to_numpy()
                xs = [(p[:, 0] + ox).astype(np.int32) for p, ox, k in zip(paths, minx, keep) if k]
                ys = [(p[:, 1] + oy).astype(np.int32) for p, oy, k in zip(paths, miny, keep) if k]
                lengths = np.array([0] + [len(v) for v in xs], dtype=np.int64)
                ends = pa.array(np.cumsum(lengths), pa.int32())

                def column(parts: list[np.ndarray]) -> pa.ListArray:
                    joined = np.concatenate(parts) if parts else np.array([], dtype=np.int32)
                    return pa.ListArray.from_arrays(ends, pa.array(joined, pa.int32()))

                chosen = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [chosen.column("imageid"), chosen.column("label"), column(xs), column(ys)],
                    names=["imageid", "label", "px", "py"],
                )

    return run


def _region_rows(labelled: DataFrame, boxes: DataFrame) -> DataFrame:
    """Row masks of each region, top to bottom; rows of a region are at most SMALL_SIDE."""
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("xe") - F.col("xs") + 1)) - F.lit(1)
    return (
        labelled.join(boxes.select("imageid", "label", "minx", "miny", "n"), ["imageid", "label"])
        .withColumn("_bits", F.call_function("shiftleft", bits, F.col("xs") - F.col("minx")))
        .groupBy("imageid", "label", "minx", "miny", "n", "y")
        .agg(F.bit_or("_bits").alias("_mask"))
        .groupBy("imageid", "label", "minx", "miny", "n")
        .agg(F.sort_array(F.collect_list(F.struct("y", "_mask")))["_mask"].alias("masks"))
    )


def _small_outlines(labelled: DataFrame, boxes: DataFrame, max_vertices: int | None) -> DataFrame:
    walked = _region_rows(labelled, boxes).mapInArrow(
        _walk_batches(max_vertices), "imageid int, label long, px array<int>, py array<int>"
    )
    return walked.select(
        "imageid",
        "label",
        F.arrays_zip(F.col("px").alias("x"), F.col("py").alias("y")).alias("polygon"),
    )


def _turn(mask: Column, direction: Column) -> Column:
    """First direction, clockwise from the search start, in which the neighbour mask has a bit."""
    start = F.pmod(direction - F.when(direction % 2 == 1, 2).otherwise(1), F.lit(8)).cast("int")
    rotated = (
        F.call_function("shiftright", mask, start).bitwiseOR(F.call_function("shiftleft", mask, F.lit(8) - start))
    ).bitwiseAND(F.lit(255))
    lowest = F.bit_count(rotated.bitwiseAND(-rotated) - 1)
    return F.pmod(start + lowest, F.lit(8)).cast("int")


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _wide_outlines(labelled: DataFrame, boxes: DataFrame) -> DataFrame:
    """Vertices (imageid, label, ord, x, y) of wide regions by link doubling."""
    key = ["imageid", "label"]
    pixels = (
        labelled.join(boxes.select(*key), key, "left_semi")
        .select(*key, "y", F.explode(F.sequence("xs", "xe")).alias("x"))
    )
    marks = F.array(
        F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0).alias("bit"), F.lit(1).alias("own")),
        *[
            F.struct(F.lit(-DX[k]).alias("dx"), F.lit(-DY[k]).alias("dy"), F.lit(1 << k).alias("bit"), F.lit(0).alias("own"))
            for k in range(8)
        ],
    )
    # Each pixel tells its neighbours that it is there; only pixels with a free side can be walked.
    border = materialize(
        pixels.withColumn("m", F.explode(marks))
        .select(*key, (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), "m.bit", "m.own")
        .groupBy(*key, "x", "y")
        .agg(F.bit_or("bit").alias("mask"), F.max("own").alias("own"))
        .filter((F.col("own") == 1) & (F.col("mask") != 255))
        .drop("own"),
        "outline-border",
    )
    first = border.groupBy(*key).agg(F.min(F.struct("x", "y", "mask")).alias("f"))
    starts = first.select(
        *key, F.col("f.x").alias("x"), F.col("f.y").alias("y"), _turn(F.col("f.mask"), F.lit(START_DIRECTION)).alias("k")
    )

    def state(x: Column, y: Column, k: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), k.cast("int").alias("k"))

    moves = border.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).filter(
        F.call_function("shiftright", F.col("mask"), F.col("k")).bitwiseAND(F.lit(1)) == 1
    )
    stepped = moves.select(
        *key,
        state(F.col("x"), F.col("y"), F.col("k")).alias("at"),
        F.col("k").alias("_k"),
        (F.col("x") + _at(DX, F.col("k"))).alias("x"),
        (F.col("y") + _at(DY, F.col("k"))).alias("y"),
    ).join(border, [*key, "x", "y"])
    links = stepped.select(
        *key, "at", state(F.col("x"), F.col("y"), _turn(F.col("mask"), F.col("_k"))).alias("to")
    )
    # A state that no move leads to is not part of a walk, the start aside.
    ends = starts.select(*key, state(F.col("x"), F.col("y"), F.col("k")).alias("to"))
    entered = links.select(*key, "to").unionByName(ends).distinct().withColumnRenamed("to", "at")
    links = links.join(entered, [*key, "at"], "left_semi")
    # The walk ends in front of its start, which turns the ring into a list.
    links = links.join(ends, [*key, "to"], "left_anti")
    limits = boxes.select(*key, (F.col("n") * 2 + 3).alias("limit"))
    placed = starts.join(limits, key).select(
        *key, state(F.col("x"), F.col("y"), F.col("k")).alias("at"), F.lit(0).cast("long").alias("ord"), "limit"
    )
    links = materialize(links, "outline-links")
    placed = materialize(placed, "outline-placed")
    reach = 1
    while True:
        further = (
            placed.join(links, [*key, "at"])
            .select(*key, F.col("to").alias("at"), (F.col("ord") + reach).alias("ord"), "limit")
        )
        over = F.sum(F.when(F.col("ord") >= F.col("limit"), 1).otherwise(0))
        further, seen = materialize_counted(further, "outline-placed", {"over": over})
        if seen["over"]:
            raise RuntimeError("the walk around a region does not close")
        if seen["rows"] == 0:
            break
        placed = placed.unionByName(further)
        hop = links.select(*key, F.col("at").alias("to"), F.col("to").alias("_far"))
        links = materialize(
            links.join(hop, [*key, "to"]).select(*key, "at", F.col("_far").alias("to")), "outline-links"
        )
        reach *= 2
    return placed.select(*key, F.col("ord").cast("int").alias("ord"), F.col("at.x").alias("x"), F.col("at.y").alias("y"))


def box_columns() -> list[Column]:
    """Pixel count and bounding box, as aggregates of runs."""
    return [
        F.sum(F.col("xe") - F.col("xs") + 1).alias("n"),
        F.min("xs").alias("minx"),
        F.max("xe").alias("maxx"),
        F.min("y").alias("miny"),
        F.max("y").alias("maxy"),
    ]


def region_boxes(labelled: DataFrame) -> DataFrame:
    """Pixel count and bounding box of each region."""
    return labelled.groupBy("imageid", "label").agg(*box_columns())


def short_outlines(labelled: DataFrame, boxes: DataFrame, max_vertices: int) -> DataFrame:
    """Polygons of the regions whose outline has at most ``max_vertices`` vertices.

    A closed walk that reaches both ends of a side of s pixels has at least 2(s - 1) vertices, so
    longer regions are ruled out by their box before anything is walked.
    """
    side = min(max_vertices // 2 + 1, SMALL_SIDE)
    if max_vertices // 2 + 1 > SMALL_SIDE:
        vertices = outline(labelled, boxes)
        return (
            vertices.groupBy("imageid", "label")
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") <= max_vertices)
            .join(vertices, ["imageid", "label"])
            .groupBy("imageid", "label")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))), lambda v: F.struct(v["x"], v["y"])).alias("polygon"))
        )
    near = (F.col("maxx") - F.col("minx") < side) & (F.col("maxy") - F.col("miny") < side)
    return _small_outlines(labelled, boxes.filter(near), max_vertices)


def outline(labelled: DataFrame, boxes: DataFrame | None = None, small_side: int = SMALL_SIDE) -> DataFrame:
    """Outline vertices of every region: imageid, label, ord, x, y."""
    near = (F.col("maxx") - F.col("minx") < small_side) & (F.col("maxy") - F.col("miny") < small_side)
    boxes = region_boxes(labelled) if boxes is None else boxes
    boxes, seen = materialize_counted(boxes, "region-boxes", {"near": F.sum(near.cast("long"))})
    walked = _small_outlines(labelled, boxes.filter(near), None).select(
        "imageid", "label", F.posexplode("polygon").alias("ord", "p")
    ).select("imageid", "label", "ord", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    if seen["rows"] == (seen["near"] or 0):
        return walked
    return walked.unionByName(_wide_outlines(labelled, boxes.filter(~near)))
