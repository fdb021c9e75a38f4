"""Motion pairs followed in tiles of the sky, many times in one job.

A pair moves ``d2`` per step of time at most.  So what reaches an observation within a span of times comes from within
``d2`` times that span of it: a tile with a margin so wide holds all of it, and a task follows the tile by itself.  Rows
are dealt to their tile and to those whose margin they lie in; a tile returns only what lies in it without the margin.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import cell_of
from .pairs import MotionPairs

#: Times that are followed in one job; the first that leaves no tile more than ``TILE_ROWS`` observations.
SPANS = (32, 8)
TILE_ROWS = 200_000
#: A tile is so many margins wide, but not less than ``LEAST_SIDE``.
TILE_MARGINS = 4
LEAST_SIDE = 64
#: Wider margins would leave the numbers that places are compared with.
MOST_MARGIN = 1 << 28
#: Blocks of groups followed together in a tile, and numbers held at once while their members are.
TILE_BLOCKS = 64
CHUNK = 2_000_000

KEY = ["_slice", "_tx", "_ty"]
PLACE = ["obsid", "time", "centerx", "centery"]
ROW = ["block", *PLACE, "bits"]
ROW_SCHEMA = "block long, obsid long, time int, centerx int, centery int, bits long"


def meetings(xn, yn, xe, ye, limit: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of new and existing places at most ``limit`` apart, ordered by the new one within what comes at once.

    Existing places are sorted by strip and x, so a place looks at one range in each of at most two strips.
    """
    reach = math.floor(limit)
    height = 2 * reach + 1
    low, high = xe.min(), xe.max()
    width = high - low + 2
    strip = ye // height
    lowest = strip.min()
    key = (strip - lowest) * width + xe - low
    order = np.argsort(key, kind="stable")
    key = key[order]
    below, above = (yn - reach) // height, (yn + reach) // height
    for strips, chosen in ((below, np.arange(len(xn))), (above, np.flatnonzero(above != below))):
        at = (strips[chosen] - lowest) * width - low
        start = np.searchsorted(key, at + np.clip(xn[chosen] - reach, low, high + 1), "left")
        stop = np.searchsorted(key, at + np.clip(xn[chosen] + reach, low - 1, high), "right")
        found = start < stop
        chosen, start, stop = chosen[found], start[found], stop[found]
        total = np.cumsum(stop - start)
        done = 0
        while done < len(chosen):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, "right")))
            count = (stop - start)[done:upto]
            i = np.repeat(chosen[done:upto], count)
            j = np.arange(count.sum()) + np.repeat(start[done:upto] - np.cumsum(count) + count, count)
            j = order[j]
            dx, dy = xn[i] - xe[j], yn[i] - ye[j]
            near = (dx * dx + dy * dy).astype("float64") <= limit * limit
            yield i[near], j[near]
            done = upto


@dataclass(frozen=True)
class _Tile:
    """Places of a tile with its margin, each id once."""

    ids: np.ndarray
    time: np.ndarray
    x: np.ndarray
    y: np.ndarray
    own: np.ndarray

    def met(self, d2: float, t: int, times: range, held: Callable, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (new, existing) of pairs, by the later time; ``held`` chooses those existing rows that count."""
        order = np.argsort(self.time, kind="stable")
        values, start = np.unique(self.time[order], return_index=True)
        at = dict(zip(values.tolist(), np.split(order, start[1:])))
        for now in values.tolist():
            if now not in times:
                continue
            new = np.sort(at[now])
            for step in range(1, t + 1):
                if now - step not in at:
                    continue
                old = held(np.sort(at[now - step]))
                if len(old):
                    places = self.x[new], self.y[new], self.x[old], self.y[old]
                    for i, j in meetings(*places, float(d2) * float(step), most):
                        if len(i):
                            yield new[i], old[j]


def _tile(key: tuple, table: pa.Table, side: int) -> tuple[_Tile, np.ndarray]:
    obsid, time, x, y = (table[c].to_numpy().astype("int64") for c in PLACE)
    ids, at, number = np.unique(obsid, return_index=True, return_inverse=True)
    time, x, y = time[at], x[at], y[at]
    own = (x // side == key[1].as_py()) & (y // side == key[2].as_py())
    return _Tile(ids, time, x, y, own), number


@dataclass(frozen=True)
class Tiling:
    """Tiles and slices of time for :class:`MotionPairs`; ``first`` is the first time, a slice is ``span`` times long."""

    d2: float
    t: int
    since: int | None
    until: int | None
    first: int
    span: int

    @property
    def margin(self) -> int:
        return math.floor(self.d2 * (self.span - 1 + self.t)) + 1

    @property
    def side(self) -> int:
        return max(TILE_MARGINS * self.margin, LEAST_SIDE)

    def times(self, number: int) -> range:
        low = self.first + number * self.span
        return range(low, low + self.span)

    def later(self, number: int) -> range:
        """Times of the slice at which observations are the later ones of pairs."""
        own = self.times(number)
        low = own.start if self.since is None else max(own.start, self.since)
        return range(low, own.stop if self.until is None else min(own.stop, self.until))

    def slice_of(self, time):
        return F.floor((time - F.lit(self.first)) / F.lit(self.span)).cast("int")

    def dealt(self, rows: DataFrame, margin: int) -> DataFrame:
        """Rows of a slice once for each tile that they lie in or in the margin of."""
        for name, value in (("_tx", F.col("centerx")), ("_ty", F.col("centery"))):
            value = value.cast("long")
            rows = rows.withColumn(name, F.explode(F.sequence(cell_of(value - margin, self.side), cell_of(value + margin, self.side))))
        return rows

    def ends(self, places: DataFrame) -> DataFrame:
        """(obsid, end, met): ``end`` 1 has a predecessor, 2 a successor, 3 both; ``met`` pairs lead to it."""
        side, d2, t, later = self.side, self.d2, self.t, self.later

        def follow(key, table):
            tile, _ = _tile(key, table, side)
            before, after = np.zeros(len(tile.ids), "int64"), np.zeros(len(tile.ids), bool)
            for new, old in tile.met(d2, t, later(key[0].as_py()), lambda rows: rows, CHUNK):
                before += np.bincount(new, minlength=len(before))
                after[old] = True
            chosen = np.flatnonzero(tile.own & ((before > 0) | after))
            end = (before[chosen] > 0) + 2 * after[chosen]
            return pa.table({"obsid": tile.ids[chosen], "end": end.astype("int32"), "met": before[chosen]})

        slices = F.explode(F.sequence(self.slice_of(F.col("time")), self.slice_of(F.col("time") + t)))
        rows = self.dealt(places.select(*PLACE, slices.alias("_slice")), math.floor(d2 * t) + 1)
        found = rows.groupBy(*KEY).applyInArrow(follow, "obsid long, end int, met long")
        return found.groupBy("obsid").agg(F.bit_or("end").alias("end"), F.sum("met").alias("met"))

    def members(self, number: int, places: DataFrame, held: DataFrame) -> DataFrame:
        """Memberships (``ROW``) of a slice's observations: ``held`` of them and of the ``t`` times before, passed on."""
        side, d2, t = self.side, self.d2, self.t
        own, later = self.times(number), self.later(number)

        def follow(key, table):
            tile, row = _tile(key, table, side)
            block, bits = table["block"].to_numpy(), table["bits"].to_numpy().astype("int64").view("uint64")
            known = np.flatnonzero(bits != 0)
            blocks, column = np.unique(block[known], return_inverse=True)
            row, bits = row[known], bits[known]
            mine = np.flatnonzero(tile.own & (tile.time >= own.start) & (tile.time < own.stop))
            found = []
            for start in range(0, len(blocks) if len(mine) else 0, TILE_BLOCKS):
                width = min(TILE_BLOCKS, len(blocks) - start)
                part = (column >= start) & (column < start + width)
                held = np.zeros((len(tile.ids), width), "uint64")
                np.bitwise_or.at(held, (row[part], column[part] - start), bits[part])
                grouped = lambda rows, held=held: rows[held[rows].any(axis=1)]
                for new, old in tile.met(d2, t, later, grouped, CHUNK // width):
                    cut = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
                    held[new[cut]] |= np.bitwise_or.reduceat(held[old], cut, axis=0)
                i, j = np.nonzero(held[mine])
                found.append((mine[i], blocks[start + j], held[mine[i], j].view("int64")))
            i, block, bits = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, "int64"),) * 3
            place = {"time": tile.time, "centerx": tile.x, "centery": tile.y}
            place = {name: values[i].astype("int32") for name, values in place.items()}
            return pa.table({"block": block, "obsid": tile.ids[i], **place, "bits": bits})

        new = places.filter(F.col("time").between(later.start, later.stop - 1))
        none = F.lit(0).cast("long")
        new = new.select(none.alias("block"), *PLACE, none.alias("bits"))
        held = held.filter(F.col("time").between(own.start - t, own.stop - 1)).select(*ROW)
        rows = self.dealt(new.unionByName(held).withColumn("_slice", F.lit(number)), self.margin)
        return rows.groupBy(*KEY).applyInArrow(follow, ROW_SCHEMA)


def tiling(pairs: MotionPairs, places: DataFrame, times: list[int]) -> Tiling | None:
    """Tiles that a task can hold; None where observations lie too close for that, or pairs reach too far."""
    if not times or pairs.d2 < 0 or pairs.t < 1:
        return None
    for span in SPANS:
        tiles = Tiling(pairs.d2, pairs.t, pairs.since, pairs.until, times[0], span)
        if pairs.t > span or tiles.margin > MOST_MARGIN:
            continue
        rows = tiles.dealt(places.withColumn("_slice", tiles.slice_of(F.col("time"))), tiles.margin)
        most = rows.groupBy(*KEY).count().agg(F.max("count")).first()[0]
        if most <= TILE_ROWS:
            return tiles
    return None


#: How members are folded: ``count``, ``sum``, ``min`` or ``max`` of a column, or ``least``, the named one of the least row.
Fold = tuple[str, tuple[str, ...], str | None]


def _bits(bits: np.ndarray) -> np.ndarray:
    """Whether each bit is set, a column for each."""
    return (bits.view("uint64")[:, None] >> np.arange(64, dtype="uint64") & np.uint64(1)).astype(bool)


def _fold(how: str, held: np.ndarray, start: np.ndarray, columns: list[np.ndarray], named: np.ndarray | None) -> np.ndarray:
    """One value for each run of rows from ``start`` on and each bit."""
    if how == "count":
        return np.add.reduceat(held, start, axis=0, dtype="int64")
    if how == "sum":
        return np.add.reduceat(held * columns[0][:, None], start, axis=0)
    if how == "least":
        order = np.lexsort(columns[::-1])
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        first = np.minimum.reduceat(np.where(held, rank[:, None], len(order)), start, axis=0)
        return named[order[np.minimum(first, len(order) - 1)]]
    edge = np.iinfo("int64").max if how == "min" else np.iinfo("int64").min
    return (np.minimum if how == "min" else np.maximum).reduceat(np.where(held, columns[0][:, None], edge), start, axis=0)


def fold_blocks(rows: DataFrame, folds: dict[str, Fold]) -> DataFrame:
    """Folds of packed members (block, bits, columns without null) by block and bit (``_bit``), as rows to be folded again:
    a block that goes over the end of a batch comes twice."""
    names = sorted({c for _, of, named in folds.values() for c in (*of, *([named] if named else ()))})
    types = dict(rows.dtypes)
    kept = {n: "bigint" if how in ("count", "sum") else types[named or of[0]] for n, (how, of, named) in folds.items()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"bigint": pa.int64(), "int": pa.int32()}
        for batch in batches:
            if not batch.num_rows:
                continue
            block, bits, *values = (batch[c].to_numpy().astype("int64") for c in ("block", "bits", *names))
            values = dict(zip(names, values))
            start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            held = _bits(bits)
            run, bit = np.nonzero(np.logical_or.reduceat(held, start, axis=0))
            found = {"block": pa.array(block[start[run]]), "_bit": pa.array(bit.astype("int32"))}
            for name, (how, of, named) in folds.items():
                result = _fold(how, held, start, [values[c] for c in of], values[named] if named else None)
                found[name] = pa.array(result[run, bit]).cast(arrow[kept[name]])
            yield pa.RecordBatch.from_pydict(found)

    schema = ", ".join(["block bigint", "_bit int", *[f"{n} {t}" for n, t in kept.items()]])
    return rows.select("block", "bits", *names).repartition("block").sortWithinPartitions("block").mapInArrow(fold, schema)
