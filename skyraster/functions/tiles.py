"""Tile and region arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_SIZE = 100
TILE_RATIO = 1000
REGION_SIZE = 1000
#: Tile rows of one folder of a stored raster.
BAND_TILES = 8


def idiv(value: Column, divisor: int | Column) -> Column:
    """Integer division that truncates toward zero (BIGINT)."""
    return F.call_function("div", value, divisor if isinstance(divisor, Column) else F.lit(divisor))


def cell_of(value: Column, size: int | Column) -> Column:
    """Grid cell of a coordinate: floor division, so negative coordinates are safe."""
    return F.floor(value / (size if isinstance(size, Column) else F.lit(size)))


def tile_of(x: Column, y: Column, tile_size: int = TILE_SIZE, ratio: int = TILE_RATIO) -> Column:
    """Number of the tile that holds a pixel."""
    return (idiv(y, tile_size) * ratio + idiv(x, tile_size)).cast("int")


def tile_x(tile: Column, ratio: int = TILE_RATIO) -> Column:
    return (tile % ratio).cast("int")


def tile_y(tile: Column, ratio: int = TILE_RATIO) -> Column:
    return idiv(tile, ratio).cast("int")


def band_of(tile: Column, ratio: int = TILE_RATIO) -> Column:
    """Band of tile rows, the finest folder of a stored raster."""
    return idiv(tile, ratio * BAND_TILES).cast("int")


def region_of(x: Column, y: Column, region_size: int = REGION_SIZE) -> Column:
    """Coarse region number used to bucket observations: y region in the high bits."""
    return (F.shiftleft(idiv(y, region_size), 16) + idiv(x, region_size)).cast("int")


def box_tile_ranges(
    rect: tuple[int, int, int, int], tile_size: int = TILE_SIZE, ratio: int = TILE_RATIO
) -> list[tuple[int, int]]:
    """(first tile, last tile) of each tile row that a pixel box touches.

    The last tile comes from the last coordinate, so unaligned boxes are covered in full.
    """
    xs, xl, ys, yl = rect
    if xl <= 0 or yl <= 0:
        return []
    first, last = xs // tile_size, (xs + xl - 1) // tile_size
    rows = range(ys // tile_size, (ys + yl - 1) // tile_size + 1)
    return [(row * ratio + first, row * ratio + last) for row in rows]


def in_tile_ranges(tile: Column, ranges: list[tuple[int, int]], ratio: int = TILE_RATIO) -> Column:
    """Pruning predicate for :func:`box_tile_ranges` as two plain ranges.

    All ranges of one box share their columns, so the test is a range on the tile number (which
    reaches the Parquet row-group statistics) plus a range on the column part.
    """
    if not ranges:
        return F.lit(False)
    low, high = ranges[0][0], ranges[-1][1]
    return tile.between(low, high) & (tile % ratio).between(low % ratio, high % ratio)


def in_box(x: Column, y: Column, rect: tuple[int, int, int, int]) -> Column:
    """Closed pixel box [xs, xs+xl-1] x [ys, ys+yl-1]."""
    xs, xl, ys, yl = rect
    return x.between(xs, xs + xl - 1) & y.between(ys, ys + yl - 1)
