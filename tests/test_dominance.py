"""Box sums by strips against plain counting."""

import numpy as np
import pytest

from skyraster.operators.dominance import box_sums, sums_below


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_sums_below(n):
    rng = np.random.default_rng(n)
    order, value, weight = rng.integers(-9, 9, n), rng.integers(-9, 9, n), rng.integers(1, 1 << 40, n)
    end, limit = rng.integers(-12, 12, 200), rng.integers(-12, 12, 200)
    got = sums_below(order, value, weight, end, limit)
    assert got.tolist() == [int(weight[(order <= e) & (value <= v)].sum()) for e, v in zip(end, limit)]


@pytest.mark.parametrize("half, strip", [(0, 40), (3, 40), (60, 25), (100_000, 30), (5, 10_000)])
def test_box_sums(spark, half, strip):
    rng = np.random.default_rng(half)
    # A crowd, a column and a row of many points, and far corners.
    points = {(int(x), int(y)) for x, y in rng.integers(-20, 20, (150, 2))} | {(5, int(y)) for y in rng.integers(-500, 500, 120)}
    points |= {(int(x), -7) for x in rng.integers(-500, 500, 120)} | {(2**31 - 1 - 100_001, -(2**31) + 100_002)}
    rows = [(x, y, 1 + (x + y) % 5) for x, y in sorted(points)]
    frame = spark.createDataFrame(rows, "px int, py int, weight long")
    got = {(r.px, r.py): r.n for r in box_sums(frame, half, strip).collect()}
    assert got == {(x, y): sum(w for a, b, w in rows if abs(a - x) <= half and abs(b - y) <= half) for x, y, _ in rows}
