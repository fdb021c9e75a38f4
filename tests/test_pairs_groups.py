import random

import pytest
from brute import grow_groups
from pyspark.sql import functions as F

from skyraster.functions.ordinals import running_offset
from skyraster.operators.cook import obs_vertices
from skyraster.operators.gridjoin import GridDim, grid_join
from skyraster.operators import groups
from skyraster.operators.groups import _swept, accumulate, center_traj, group_members, polygon_traj
from skyraster.operators.obs_queries import q6_neighbours
from skyraster.operators.pairs import BAND_GROWTH, motion_pairs, similar_pairs, step_bands
from skyraster.session import materialize
from skyraster.sources import observation_text

OBS = "obsid long, time int, cycle int, centerx int, centery int"


@pytest.fixture(scope="module")
def crowd():
    """A third of the observations in one small spot."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        x, y = (rng.randrange(30), rng.randrange(30)) if i % 3 == 0 else (rng.randrange(-200, 800), rng.randrange(-200, 800))
        rows.append((i + 1, rng.randrange(12), 0, x, y))
    return rows


@pytest.fixture(scope="module")
def obs(spark, crowd):
    return materialize(spark.createDataFrame(crowd, OBS), "test-crowd")


def near_pairs(rows, d2, t):
    return {
        (n[0], e[0])
        for n in rows
        for e in rows
        if 1 <= n[1] - e[1] <= t and (n[3] - e[3]) ** 2 + (n[4] - e[4]) ** 2 <= (d2 * (n[1] - e[1])) ** 2
    }


@pytest.mark.parametrize("hot_rows", [None, 3, 40, 10_000])
@pytest.mark.parametrize("d2,t", [(3, 3), (2.5, 4), (0, 2)])
def test_motion_pairs(obs, crowd, d2, t, hot_rows):
    rows = [(r.new_obsid, r.existing_obsid) for r in motion_pairs(obs, obs, d2, t, hot_rows=hot_rows).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == near_pairs(crowd, d2, t)


@pytest.mark.parametrize("hot_rows", [None, 5])
@pytest.mark.parametrize("mode", ["batch", "radius"])
def test_similar_pairs(spark, crowd, mode, hot_rows):
    rows = [(*r, (r[0] * 37) % 60, (r[0] % 90) / 10) for r in crowd[:500]]
    frame = spark.createDataFrame(rows, OBS + ", pixelSum long, averageDist double")
    expected = set()
    for n in rows:
        for e in rows:
            radius = int(7 * (n[1] / 2.5 - e[1] / 2.5))
            distance = ((n[3] - e[3]) ** 2 + (n[4] - e[4]) ** 2) ** 0.5
            close = (int(distance) if mode == "batch" else distance) <= radius
            if e[1] < n[1] and close and abs(n[6] - e[6]) <= 3 and abs(n[5] - e[5]) <= 8:
                expected.add((n[0], e[0]))
    assert expected
    found = similar_pairs(frame, t=2.5, d2=7, d_radius=3, d_sum=8, mode=mode, hot_rows=hot_rows)
    assert sorted((r.new_obsid, r.existing_obsid) for r in found.collect()) == sorted(expected)


def test_longer_history_keeps_the_cells_of_short_steps():
    """Bands, and so the cells of their rows, of short steps do not depend on the longest one."""
    assert step_bands(7) == [(1, 7)]
    for longest in (8, 17, 1000, 100_000):
        bands = step_bands(longest)
        assert bands[0] == (1, 7)
        assert [low for low, _ in bands[1:]] == [high + 1 for _, high in bands[:-1]] and bands[-1][1] == longest
        assert all(high < BAND_GROWTH * low for low, high in bands)
    assert step_bands(0) == []


def test_grid_join_with_equal_key_and_slices(spark):
    left = spark.createDataFrame([(i, i % 2, i) for i in range(60)], "a int, k int, v int")
    right = spark.createDataFrame([(i, i % 2, i % 20) for i in range(60)], "b int, j int, w int")
    dims = [GridDim(F.col("v") - 2, F.col("v") + 2, F.col("w"), 5)]
    for hot_rows in (None, 2):
        found = grid_join(left, right, dims, F.abs(F.col("v") - F.col("w")) <= 2, equal=[("k", "j")], hot_rows=hot_rows)
        rows = sorted((r.a, r.b) for r in found.collect())
        assert rows == sorted(
            (a, b) for a in range(60) for b in range(60) if a % 2 == b % 2 and abs(a - b % 20) <= 2
        )


@pytest.mark.parametrize("box,threshold", [(20, 4), (41, 9), (2500, 300)])
def test_neighbours(obs, crowd, box, threshold):
    """Small boxes and one as wide as the sky."""
    half = box // 2
    counts = {
        a[0]: sum(abs(a[3] - b[3]) <= half and abs(a[4] - b[4]) <= half for b in crowd) for a in crowd
    }
    found = {r.obsid: r.counts for r in q6_neighbours(obs, 0, box, threshold).collect()}
    assert found == {i: n for i, n in counts.items() if n >= threshold}


def test_neighbours_of_identical_centres(spark):
    rows = spark.range(30_000).select(
        (F.col("id") + 1).alias("obsid"), F.lit(0).alias("cycle"), F.lit(7).alias("centerx"), F.lit(9).alias("centery")
    )
    found = q6_neighbours(rows, 0, 10, 5).agg(F.count(F.lit(1)), F.min("counts"), F.max("counts")).first()
    assert tuple(found) == (30_000, 30_000, 30_000)


def random_pairs(seed, n=60, edges=90):
    rng = random.Random(seed)
    times = {i: rng.randrange(12) for i in range(n)}
    pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(edges)) if times[a] > times[b]}
    return sorted(pairs), times


def members_of(frame):
    rows = [(r.obsgroupid, r.obsid) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,hops", [(1, 1), (2, 2), (3, 4)])
def test_groups_equal_order_driven_rule(spark, seed, hops):
    pairs, times = random_pairs(seed)
    frame = spark.createDataFrame(pairs, "new_obsid long, existing_obsid long")
    assert members_of(accumulate(frame, hops=hops)) == grow_groups(pairs, times)
    everything = spark.createDataFrame([(i,) for i in times], "obsid long")
    alone = {(i, i) for i in times} - {(a, a) for a, _ in pairs}
    assert members_of(accumulate(frame, singletons_of=everything)) == grow_groups(pairs, times) | alone


def test_groups_long_chain(spark):
    pairs = [(i + 1, i) for i in range(25)]
    frame = spark.createDataFrame(pairs, "new_obsid long, existing_obsid long")
    assert members_of(accumulate(frame)) == {(0, i) for i in range(26)}


def timed(spark, pairs, times):
    rows = [(a, b, times[a], times[b]) for a, b in pairs]
    return spark.createDataFrame(rows, "new_obsid long, existing_obsid long, new_time int, existing_time int")


@pytest.mark.parametrize("seed,steps", [(1, 1), (2, 2), (3, 5), (4, 50)])
def test_groups_by_a_sweep_in_time(spark, seed, steps):
    pairs, times = random_pairs(seed, 60, 120)
    frame = timed(spark, pairs, times)
    assert members_of(_swept(frame, None, None, False, steps)) == grow_groups(pairs, times)
    everything = spark.createDataFrame([(i,) for i in times], "obsid long")
    alone = {(i, i) for i in times} - {(a, a) for a, _ in pairs}
    assert members_of(_swept(frame, None, everything, False, steps)) == grow_groups(pairs, times) | alone
    members = known = None
    for low, high in ((0, 5), (5, 8), (8, 12)):
        part = timed(spark, [p for p in pairs if low <= times[p[0]] < high], times)
        new = members_of(_swept(part, members, None, True, steps))
        assert known is None or not new & known
        members = _swept(part, members, None, False, steps)
        known = members_of(members)
    assert known == grow_groups(pairs, times)


def test_a_sweep_needs_times_in_order(spark):
    with pytest.raises(ValueError):
        accumulate(timed(spark, [(1, 2)], {1: 4, 2: 4}))
    assert accumulate(timed(spark, [(1, 2)], {1: 4, 2: 3}).limit(0)).count() == 0


def test_a_sweep_joins_a_membership_a_fixed_number_of_times(spark, monkeypatch):
    """Rows written while groups grow are in proportion to the memberships, whatever the length of the chain."""
    written = []
    counted = groups.materialize_counted
    monkeypatch.setattr(groups, "materialize_counted", lambda *a, **k: (lambda out: (written.append(out[1]["rows"]), out)[1])(counted(*a, **k)))
    monkeypatch.setattr(groups, "materialize", lambda *a, **k: groups.materialize_counted(*a, **k)[0])
    pairs = [(i + 1 + 1000 * k, i + 1000 * k) for i in range(39) for k in range(3)]
    members = members_of(accumulate(timed(spark, pairs, {i + 1000 * k: i for i in range(40) for k in range(3)})))
    assert members == {(1000 * k, i + 1000 * k) for i in range(40) for k in range(3)}
    assert sum(written) <= 3 * len(members)


def test_groups_in_steps_equal_one_shot(spark):
    pairs, times = random_pairs(7, 80, 160)
    schema = "new_obsid long, existing_obsid long"
    members = None
    for low, high in ((0, 5), (5, 8), (8, 12)):
        part = [p for p in pairs if low <= times[p[0]] < high]
        members = accumulate(spark.createDataFrame(part, schema), members=members)
    assert members_of(members) == grow_groups(pairs, times)


def test_running_offset_matches_plain_order(spark):
    rows = [(i % 2, i // 7, i, 1 + i % 3) for i in range(100)]
    frame = spark.createDataFrame(rows, "k int, b int, o int, w int")
    found = {r.o: (r.at, r.total) for r in running_offset(frame, ["k"], ["b"], ["o"], F.col("w"), "at", "total").collect()}
    for key in (0, 1):
        mine = [r for r in rows if r[0] == key]
        for i, r in enumerate(mine):
            assert found[r[2]] == (sum(x[3] for x in mine[:i]), sum(x[3] for x in mine))


def test_members_in_parts(spark):
    members = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 5)], "obsgroupid long, obsid long")
    rows = {(r.obsgroupid, r.part): r.obsids for r in group_members(members, chunk=10).collect()}
    assert rows == {(1, 0): list(range(10)), (1, 1): list(range(10, 20)), (1, 2): list(range(20, 25)), (2, 0): [5]}


@pytest.fixture(scope="module")
def trajectory(spark):
    obs = spark.createDataFrame(
        [(i, i // 2, 10 * i, 5 * i, [(10 * i, 5 * i), (10 * i + 1, 5 * i), (10 * i, 5 * i + 2)][: 1 + i % 3]) for i in range(12)],
        "obsid long, time int, centerx int, centery int, polygon array<struct<x:int,y:int>>",
    )
    members = spark.createDataFrame([(0, i) for i in range(12)] + [(3, i) for i in (3, 8, 9)], "obsgroupid long, obsid long")
    return members, obs, obs_vertices(obs)


def test_polygon_trajectory_ring(trajectory):
    members, obs, vertices = trajectory
    shapes = {r.obsid: [(p.x, p.y) for p in r.polygon] for r in obs.collect()}
    found = {}
    for r in polygon_traj(members, obs, vertices).collect():
        found.setdefault((r.obsgroupid, r.fromtime, r.totime), {})[r.ord] = (r.x, r.y)
    assert len(found) == 5 + 1
    ring = shapes[3] + shapes[8] + shapes[9]
    step = found[(3, 1, 4)]
    assert [step[i] for i in range(len(step))] == ring + ring[:1]


@pytest.mark.parametrize("per_line", [2, 1000])
def test_group_files(spark, trajectory, tmp_path, per_line):
    members, obs, vertices = trajectory
    path = str(tmp_path / "groups")
    observation_text.write_groups(members, obs, vertices, path, per_line)
    points = {tuple(r) for r in observation_text.read_trajectories(spark, path).collect()}
    assert points == {tuple(r) for r in center_traj(members, obs).select("obsgroupid", "ord", "x", "y").collect()}
    steps = {tuple(r) for r in observation_text.read_steps(spark, path).collect()}
    assert steps == {tuple(r) for r in polygon_traj(members, obs, vertices).collect()}
    assert observation_text.read_members(spark, path).count() == members.count()
