"""Packed memberships: the same rows as unpacked ones, from fewer rows sent."""

import random

from brute import grow_groups
from pyspark.sql import functions as F

from skyraster.operators import groups
from skyraster.operators.cook import obs_vertices
from skyraster.sources import observation_text


def crowd(spark, seed=3, n=90, edges=1500):
    rng = random.Random(seed)
    times = {i: i % 9 for i in range(n)}
    pairs = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(edges)) if 0 < times[a] - times[b] <= 3})
    frame = spark.createDataFrame(
        [(a, b, times[a], times[b]) for a, b in pairs], "new_obsid long, existing_obsid long, new_time int, existing_time int"
    )
    obs = spark.createDataFrame(
        [(i, times[i], i * 7 % 50, i * 3 % 40, [(i, i), (i + 1, i), (i, i + 2)][: 1 + i % 3]) for i in range(n)],
        "obsid long, time int, centerx int, centery int, polygon array<struct<x:int,y:int>>",
    )
    return frame, obs, grow_groups(pairs, times)


def rows_of(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def test_packed_members_answer_as_plain_ones(spark, tmp_path, monkeypatch):
    pairs, obs, expected = crowd(spark)
    packed = groups.pack(pairs)
    plain = spark.createDataFrame(sorted(expected), "obsgroupid long, obsid long")
    assert rows_of(packed.expand()) == rows_of(plain)
    # Groups that meet share rows: fewer are joined and sent than there are memberships.
    assert 3 * packed.rows.count() < len(expected)
    some = plain.select("obsgroupid").distinct().filter(F.col("obsgroupid") % 2 == 0)
    shapes = obs_vertices(obs)
    calls = [
        lambda m: groups.group_summary(m, obs),
        lambda m: groups.members_of(m, some),
        lambda m: groups.groups_of(m, obs.filter("obsid < 40")),
        lambda m: groups.center_traj(m, obs),
        lambda m: groups.polygon_traj(m, obs, shapes),
        lambda m: groups.group_members(m),
        lambda m: groups.group_members(m, chunk=5),
        lambda m: observation_text.trajectory_lines(m, obs, 3),
        lambda m: observation_text.step_lines(m, obs, shapes, 4),
    ]
    wanted = [rows_of(call(plain)) for call in calls]
    assert [rows_of(call(packed)) for call in calls] == wanted
    # Blocks beyond the bounds of a list go the way of plain rows.
    monkeypatch.setattr(groups, "LIST_ROWS", 2)
    monkeypatch.setattr(groups, "LIST_POINTS", 4)
    assert [rows_of(calls[i](packed)) for i in (3, 4)] == [wanted[i] for i in (3, 4)]


def test_packed_groups_grow(spark):
    pairs, _, expected = crowd(spark)
    first = groups.pack(pairs.filter("new_time < 5"))
    later = pairs.filter("new_time >= 5")
    both = groups.pack(later, members=first)
    assert rows_of(both.expand().select("obsgroupid", "obsid")) == rows_of(
        spark.createDataFrame(sorted(expected), "obsgroupid long, obsid long")
    )


def test_many_times_are_followed_in_rounds(spark, monkeypatch):
    written = []
    counted = groups.materialize_counted
    monkeypatch.setattr(groups, "materialize_counted", lambda *a, **k: (written.append(a[1]), counted(*a, **k))[1])
    rows = [(2 * i + 1, 2 * i, 10 * i + 1, 10 * i) for i in range(200)]
    pairs = spark.createDataFrame(rows, "new_obsid long, existing_obsid long, new_time int, existing_time int")
    assert groups.accumulate(pairs).count() == 400
    # One job per slice would be 500.
    assert len(written) < 5
