"""Hilbert curve: neighbouring cells of a grid mostly have neighbouring numbers.

The number of a cell is read off the bits of x and y from the top.  A quadrant's place on the curve depends on how
the curve lies in the square around it: mirrored in both axes (flip), with axes exchanged (swap), or both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert_key(x: Column, y: Column, bits: Column) -> Column:
    """Number of cell (x, y), 0 <= x, y < 2^bits, as a long; up to 31 bits.

    Computed for many rows at a time.  All 32 bits are read; each bit above the first is 0 on both sides and exchanges
    the axes, so the start is chosen to be plain at the first bit.
    """

    @F.pandas_udf("long")
    def number(xs, ys, sizes):
        x, y, swap = xs.to_numpy(), ys.to_numpy(), sizes.to_numpy() & 1
        key, flip = np.zeros_like(x), np.zeros_like(x)
        for bit in range(31, -1, -1):
            bx, by = x >> bit & 1, y >> bit & 1
            other = (bx ^ by) * swap
            rx, ry = bx ^ other ^ flip, by ^ other ^ flip
            key = key << 2 | rx * 3 ^ ry
            flip, swap = flip ^ rx & 1 - ry, swap ^ 1 - ry
        return pd.Series(key)

    def whole(value: Column) -> Column:
        return F.coalesce(value.cast("long"), F.lit(0).cast("long"))

    known = x.isNotNull() & y.isNotNull() & bits.isNotNull()
    return F.when(known, number(whole(x), whole(y), whole(bits)))


def key_ranges(box: tuple[int, int, int, int], bits: int, most: int = 32) -> list[tuple[int, int]]:
    """At most ``most`` ranges of numbers, ends included, that hold all cells of (x0, y0, x1, y1), ends included.

    Squares that lie across the border are split from the largest down while that is cheap; then the smallest gaps
    between ranges are closed.
    """
    x0, y0, x1, y1 = box
    if x0 > x1 or y0 > y1:
        return []
    done, open_ = [], [(0, 0, 0, 0, 0)]  # key, x, y, flip, swap of a square of side 2^left
    for left in range(bits, -1, -1):
        side, inner = (1 << left) - 1, []
        for key, x, y, flip, swap in open_:
            xs, ys = x << left, y << left
            if xs > x1 or xs + side < x0 or ys > y1 or ys + side < y0:
                continue
            inside = x0 <= xs and xs + side <= x1 and y0 <= ys and ys + side <= y1
            if inside or left == 0 or len(open_) > 8 * most:
                done.append((key << 2 * left, (key + 1 << 2 * left) - 1))
                continue
            for digit in range(4):
                rx, ry = digit >> 1, (digit ^ digit >> 1) & 1
                bx, by = (ry ^ flip, rx ^ flip) if swap else (rx ^ flip, ry ^ flip)
                inner.append((key * 4 + digit, x * 2 + bx, y * 2 + by, flip ^ (rx & (1 - ry)), swap ^ (1 - ry)))
        open_ = inner
    merged: list[tuple[int, int]] = []
    for low, high in sorted(done):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    gaps = sorted(range(1, len(merged)), key=lambda n: merged[n][0] - merged[n - 1][1], reverse=True)
    cuts = sorted(gaps[: most - 1])
    return [(merged[a][0], merged[b - 1][1]) for a, b in zip([0, *cuts], [*cuts, len(merged)], strict=True) if merged]
