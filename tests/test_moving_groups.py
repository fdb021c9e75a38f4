"""Groups of motion pairs that are found where they are followed: the same rows, without a table of pairs."""

import random
from dataclasses import replace

import pytest
from brute import grow_groups

from skyraster.operators import groups, sweep
from skyraster.operators.pairs import MotionPairs

SCHEMA = "obsid long, time int, centerx int, centery int"
D2, T = 2.0, 3


def crowd(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(6), 1000 * (i % 4) + rng.randrange(14), rng.randrange(14)) for i in range(n)]
    pairs = [
        (a[0], b[0])
        for a in rows
        for b in rows
        if 0 < a[1] - b[1] <= T and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= (D2 * (a[1] - b[1])) ** 2
    ]
    expected = sorted(grow_groups(pairs, {r[0]: r[1] for r in rows}), key=str)
    # A row that comes twice, and rows without a time or a place, change nothing.
    odd = [rows[0], rows[5], (n, None, 3, 3), (n + 1, 4, None, 3)]
    obs = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    return MotionPairs(obs, D2, T), pairs, expected


def memberships(frame):
    return sorted((tuple(r) for r in frame.select("obsgroupid", "obsid").collect()), key=str)


@pytest.fixture
def written(monkeypatch):
    """(name, rows) of the tables that groups write; few pairs count as many."""
    tables, write = [], groups.materialize_counted

    def counted(df, name, *args, **kwargs):
        found = write(df, name, *args, **kwargs)
        tables.append((name, found[1]["rows"]))
        return found

    monkeypatch.setattr(groups, "materialize_counted", counted)
    monkeypatch.setattr(groups, "LISTED_PAIRS", 0)
    return tables


def test_pairs_are_followed_without_a_table_of_them(spark, written):
    moving, pairs, expected = crowd(spark)
    packed = groups.pack(moving)
    assert memberships(packed.expand()) == expected
    # Every table is smaller than that of the pairs; a row holds many memberships.
    assert "edges" not in {name for name, _ in written}
    assert 4 * max(rows for _, rows in written) < len(pairs)
    assert 4 * packed.rows.count() < len(expected)
    assert memberships(groups.accumulate(moving)) == expected


def test_moving_groups_grow(spark, written):
    moving, _, expected = crowd(spark)
    first = groups.pack(replace(moving, until=3))
    both = groups.pack(replace(moving, since=3), members=first)
    assert memberships(both.expand()) == expected
    assert "edges" not in {name for name, _ in written}


def test_moving_groups_with_singletons(spark, written):
    moving, pairs, expected = crowd(spark)
    obs = moving.obs
    later = {a for a, _ in pairs}
    alone = {r["obsid"] for r in obs.collect()} - later - {g for g, _ in expected}
    assert memberships(groups.accumulate(moving, singletons_of=obs)) == sorted(expected + [(i, i) for i in alone], key=str)


def test_few_pairs_and_moved_ids_are_listed(spark, written, monkeypatch):
    moving, _, expected = crowd(spark)
    monkeypatch.setattr(groups, "LISTED_PAIRS", 1_000_000)
    assert memberships(groups.accumulate(moving)) == expected
    assert "edges" in {name for name, _ in written}
    monkeypatch.setattr(groups, "LISTED_PAIRS", 0)
    written.clear()
    # An id that is seen at two places, or none, cannot be swept by time alone.
    for row in ((7, 5, 50, 50), (None, 4, 3, 3)):
        moved = replace(moving, obs=moving.obs.unionByName(spark.createDataFrame([row], SCHEMA)))
        assert memberships(groups.accumulate(moved)) == memberships(groups.accumulate(moved.rows()))


def test_members_alike_are_folded_before_they_are_listed(spark, monkeypatch):
    held = [(0, i, 7 if i >= 10 else 1 << i % 3) for i in range(100)]
    packed = groups.PackedMembers(
        spark.createDataFrame(held, "block long, obsid long, bits long"),
        spark.createDataFrame([(0, [0, 1, 2])], "block long, names array<long>"),
    )
    expected = [(g, i) for _, i, bits in held for g in range(3) if bits >> g & 1]
    plain = spark.createDataFrame(expected, "obsgroupid long, obsid long")
    columns = "obsid long, time int, centerx int, centery int, boxxstart int, boxystart int, boxxend int, boxyend int"
    obs = spark.createDataFrame([(i, i % 2, i * 7 % 50, i * 3 % 40, i - 9, i % 8, i + 3, i % 8 + 5) for i in range(100)], columns)
    listed, expand = [], groups.PackedMembers.expand

    def seen(self, rows=None):
        listed.append(expand(self, rows))
        return listed[-1]

    monkeypatch.setattr(groups.PackedMembers, "expand", seen)
    for query in (groups.group_summary, groups.group_bbox):
        assert sorted(query(packed, obs).collect()) == sorted(query(plain, obs).collect())
    # Two times of four sets of groups, of 280 memberships.
    assert [rows.count() for rows in listed] == [12, 6]


def test_slices_of_time_and_crowded_tiles(spark, written, monkeypatch):
    moving, _, expected = crowd(spark)
    # Three jobs of time, not one a time, and a table of many tiles.
    monkeypatch.setattr(sweep, "SPANS", (3,))
    assert memberships(groups.accumulate(moving)) == expected
    monkeypatch.setattr(sweep, "TILE_ROWS", 0)
    monkeypatch.setattr(sweep, "CHUNK", 64)
    assert sweep.tiling(moving, moving.obs.na.drop(), list(range(6))) is None
    assert memberships(groups.accumulate(moving)) == expected


def test_times_of_a_slice_are_swept_in_one_job(spark, written, monkeypatch):
    moving, _, expected = crowd(spark)
    jobs, write = [], groups.materialize

    def stored(df, name, *args, **kwargs):
        jobs.append(name)
        return write(df, name, *args, **kwargs)

    monkeypatch.setattr(groups, "materialize", stored)
    monkeypatch.setattr(sweep, "TILE_BLOCKS", 1)
    monkeypatch.setattr(sweep, "CHUNK", 64)
    assert memberships(groups.accumulate(moving)) == expected
    assert jobs.count("group-time") == 1 and "group-time" not in {name for name, _ in written}


def test_many_packed_rows_are_folded_by_bit(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(block, i, rng.getrandbits(64) - (1 << 63)) for block in (-5, 64) for i in range(150)]
    names = [(block, [block * 1000 + k for k in range(64)]) for block in (-5, 64)]
    packed = groups.PackedMembers(
        spark.createDataFrame(rows, "block long, obsid long, bits long"), spark.createDataFrame(names, "block long, names array<long>")
    )
    plain = [(block * 1000 + k, i) for block, i, bits in rows for k in range(64) if bits >> k & 1]
    plain = spark.createDataFrame(plain, "obsgroupid long, obsid long")
    columns = "obsid long, time int, centerx int, centery int, boxxstart int, boxystart int, boxxend int, boxyend int"
    places = [(i, i % 7, *[rng.randrange(-90, 90) for _ in range(6)]) for i in range(150)]
    odd = [(3, None, 5, 5, 1, 1, 2, 2), (4, 2, None, 900, 1, None, 2, 2), places[8]]
    obs = spark.createDataFrame(places + odd, columns)
    expected = [sorted(query(plain, obs).collect()) for query in (groups.group_summary, groups.group_bbox)]
    monkeypatch.setattr(groups, "LISTED_ROWS", 0)
    listed, expand = [], groups.PackedMembers.expand

    def seen(self, rows=None):
        listed.append(expand(self, rows))
        return listed[-1]

    monkeypatch.setattr(groups.PackedMembers, "expand", seen)
    assert [sorted(query(packed, obs).collect()) for query in (groups.group_summary, groups.group_bbox)] == expected
    # Only the odd rows are listed.
    assert all(rows.select("obsgroupid").distinct().count() < 128 and rows.count() < 300 for rows in listed)
