"""Weights of points below and to the left of other points, by strips along both axes.

The weight of the points (qx <= x, qy <= y) is split in three.  Points are cut into strips along x and into bands along y
of about equal numbers.  Strips wholly left of x and bands wholly below y give a sum of cells of a small table, strips
by bands.  What is left of the strips before x's own lies in y's own band, and what lies in x's own strip: both are
counted inside of one strip or band, by sorted order and a binary search tree on the other coordinate that is
descended for all questions at once.  So a crowd costs no more than as many points elsewhere, and no pair of points
is ever made.

A strip is cut inside of a column of equal x too, since its borders are (x, y) pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_counted

#: Points of a strip or band, about.
STRIP_POINTS = 250_000
#: Strips along an axis, at most; the table of their sums has as many entries squared.
MAX_STRIPS = 1024
#: Coordinates have 32 bits.
_SHIFT = 1 << 31


def sums_below(order: np.ndarray, value: np.ndarray, weight: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Sum of the weights with order <= end and value <= limit, for every (end, limit).

    The points are put in order; their ranks by value are split bit by bit from the top, keeping the order (a
    wavelet matrix), so each question is a walk of one step per bit.
    """
    if not len(order):
        return np.zeros(len(end), dtype=np.int64)
    place = np.argsort(order, kind="stable")
    rank = np.empty(len(value), dtype=np.int64)
    by_value = np.argsort(value, kind="stable")
    rank[by_value] = np.arange(len(value))
    rank, weight = rank[place], weight[place].astype(np.int64)
    upto = np.searchsorted(order[place], end, side="right")
    below = np.searchsorted(value[by_value], limit, side="right")
    bits = max(1, int(len(value)).bit_length())
    low, high = np.zeros(len(end), dtype=np.int64), upto.astype(np.int64)
    total = np.zeros(len(end), dtype=np.int64)
    for bit in reversed(range(bits)):
        one = rank >> bit & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        sums = np.concatenate([[0], np.cumsum(weight * (1 - one))])
        up = below >> bit & 1 == 1
        total += np.where(up, sums[high] - sums[low], 0)
        low, high = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (low, high))
        place = np.argsort(one, kind="stable")
        rank, weight = rank[place], weight[place]
    return total


_ROWS = "axis int, part int, rank long, value long, weight long, sign int, px int, py int"
_SUMS = "px int, py int, n long"


def _pair(first: np.ndarray, second: np.ndarray | int) -> np.ndarray:
    """Two 32-bit numbers as one long in the order of (first, second)."""
    return first.astype(np.int64) * (1 << 32) + (second + _SHIFT)


class _Cuts:
    """Borders of strips along x and bands along y, as pairs, and where points and questions lie."""

    def __init__(self, strips: list[int], bands: list[int]):
        self.strips, self.bands = np.array(strips, dtype=np.int64), np.array(bands, dtype=np.int64)

    def of_points(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.strips, _pair(x, y.astype(np.int64)), "right"), np.searchsorted(self.bands, _pair(y, x.astype(np.int64)), "right")

    def of_questions(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All points of lower strips or bands lie at or below x or y."""
        last = _SHIFT - 1
        return np.searchsorted(self.strips, _pair(x, last), "right"), np.searchsorted(self.bands, _pair(y, last), "right")


def _corners(x: np.ndarray, y: np.ndarray, half: int):
    """(x, y, sign) of the four questions of a box around each point."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    for dx, a in ((half, 1), (-half - 1, -1)):
        for dy, b in ((half, 1), (-half - 1, -1)):
            yield x + dx, y + dy, a * b


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c).cast(types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _spread(cuts: _Cuts, half: int):
    """Points and questions by the strip and, where there are several, by the band that counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, w = (batch.column(c).to_numpy() for c in ("px", "py", "weight"))
            strip, band = cuts.of_points(x, y)
            axes = [(0, strip, x, y, w, 0)] + ([(1, band, strip, y, w, 0)] if len(cuts.strips) else [])
            for qx, qy, sign in _corners(x, y, half):
                s, b = cuts.of_questions(qx, qy)
                axes.append((0, s, qx, qy, 0, sign))
                if len(cuts.strips):
                    axes.append((1, b, s - 1, qy, 0, sign))
            for axis, part, rank, value, weight, sign in axes:
                fill = lambda v: v if isinstance(v, np.ndarray) else np.full(len(x), v)
                yield _batch(_ROWS, [fill(axis), part, rank, value, fill(weight), fill(sign), x, y])

    return run


def _from_table(cuts: _Cuts, half: int, table: np.ndarray):
    """Sums of the cells of lower strips and lower bands."""
    upto = np.zeros((table.shape[0] + 1, table.shape[1] + 1), dtype=np.int64)
    upto[1:, 1:] = table.cumsum(axis=0).cumsum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("px", "py"))
            total = np.zeros(len(x), dtype=np.int64)
            for qx, qy, sign in _corners(x, y, half):
                total += sign * upto[cuts.of_questions(qx, qy)]
            yield _batch(_SUMS, [x, y, total])

    return run


def _answered(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial sums of the questions of one strip or band."""
    c = {name: rows.column(name).to_numpy() for name in ("rank", "value", "weight", "sign", "px", "py")}
    asked = c["sign"] != 0
    found = sums_below(c["rank"][~asked], c["value"][~asked], c["weight"][~asked], c["rank"][asked], c["value"][asked])
    return pa.Table.from_batches([_batch(_SUMS, [c["px"][asked], c["py"][asked], found * c["sign"][asked]])])


def box_sums(points: DataFrame, half: int, strip_points: int = STRIP_POINTS) -> DataFrame:
    """(px, py, n): for every point of ``points(px, py, weight)``, distinct in (px, py), the weight within ``half``
    on both axes, its own included."""
    points, seen = materialize_counted(points.select("px", "py", F.col("weight").cast("long").alias("weight")), "points")
    strips = min(MAX_STRIPS, ceil(seen["rows"] / strip_points))
    found = [[], []]
    if strips > 1:
        share = [n / strips for n in range(1, strips)]
        long = lambda a, b: F.col(a).cast("long") * F.lit(1 << 32) + (F.col(b).cast("long") + F.lit(_SHIFT))
        cuts = [F.percentile_approx(long(a, b), share, strips * 20).alias(a) for a, b in (("px", "py"), ("py", "px"))]
        row = points.agg(*cuts).first()
        found = [sorted(set(row["px"])), sorted(set(row["py"]))]
    cuts = _Cuts(*found)
    rows = points.mapInArrow(_spread(cuts, half), _ROWS)
    sums = rows.groupBy("axis", "part").applyInArrow(_answered, _SUMS)
    if strips > 1:

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, w = (batch.column(c).to_numpy() for c in ("px", "py", "weight"))
                yield _batch("strip int, band int, weight long", [*cuts.of_points(x, y), w])

        table = np.zeros((len(cuts.strips) + 1, len(cuts.bands) + 1), dtype=np.int64)
        counted = points.mapInArrow(cells, "strip int, band int, weight long").groupBy("strip", "band").agg(F.sum("weight").alias("weight"))
        for r in counted.collect():
            table[r.strip, r.band] = r.weight
        sums = sums.unionByName(points.mapInArrow(_from_table(cuts, half, table), _SUMS))
    return sums.groupBy("px", "py").agg(F.sum("n").alias("n"))
