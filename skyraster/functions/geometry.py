"""Rectangle predicates on integer coordinates.  ``rect`` is (xstart, xlen, ystart, ylen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rect = tuple[int, int, int, int]


def corners(rect: Rect) -> tuple[int, int, int, int]:
    """(xstart, ystart, xend, yend); the far corner lies at start + length."""
    xs, xl, ys, yl = rect
    return xs, ys, xs + xl, ys + yl


def point_in_rect(x: Column, y: Column, rect: Rect) -> Column:
    """Point inside the rectangle, border included."""
    xs, ys, xe, ye = corners(rect)
    return x.between(xs, xe) & y.between(ys, ye)


def box_overlaps(minx: Column, miny: Column, maxx: Column, maxy: Column, rect: Rect) -> Column:
    xs, ys, xe, ye = corners(rect)
    return (minx <= xe) & (maxx >= xs) & (miny <= ye) & (maxy >= ys)


def box_inside(minx: Column, miny: Column, maxx: Column, maxy: Column, rect: Rect) -> Column:
    xs, ys, xe, ye = corners(rect)
    return (minx >= xs) & (maxx <= xe) & (miny >= ys) & (maxy <= ye)


def long_square(value: Column) -> Column:
    wide = value.cast("long")
    return wide * wide


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt((long_square(dx) + long_square(dy)).cast("double"))


def int_distance(dx: Column, dy: Column) -> Column:
    """Euclidean distance truncated to an integer."""
    return distance(dx, dy).cast("int")


def polygon_bbox(polygon: Column) -> dict[str, Column]:
    """Bounding box of an array of (x, y) structs."""
    xs = F.transform(polygon, lambda p: p["x"])
    ys = F.transform(polygon, lambda p: p["y"])
    return {
        "boxxstart": F.array_min(xs),
        "boxystart": F.array_min(ys),
        "boxxend": F.array_max(xs),
        "boxyend": F.array_max(ys),
    }


def shift_polygon(polygon: Column, dx: Column, dy: Column) -> Column:
    """Move every vertex of a polygon by (dx, dy)."""
    return F.transform(
        polygon,
        lambda p: F.struct((p["x"] + dx).cast("int").alias("x"), (p["y"] + dy).cast("int").alias("y")),
    )
