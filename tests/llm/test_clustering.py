"""Clusters against plain k-means in whole numbers."""

import hashlib
from math import floor

import numpy as np
import pytest

from skyraster.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, dim, k, rounds):
    """Assignments and centroids by comparing every vector with every centroid."""
    data = [(i, [floor(64 * x) for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in data if i is not None)
    cents = [v for _, v in named[:k]]
    if not cents:
        return []
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in data]
        if step < rounds:
            for n in range(len(cents)):
                own = [v for (_, v), (_, c) in zip(data, found) if c == n]
                if own:
                    cents[n] = [sum(x) // len(own) for x in zip(*own)]
    inertia = [sum(d for d, c in found if c == n) for n in range(len(cents))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, inertia[c], sum(inertia), shas[c]) for (i, _), (d, c) in zip(data, found)]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("k", [1, 2, 7])
def test_small_and_tied(spark, k):
    rng = np.random.default_rng(k)
    # A coarse lattice makes many ties; copies, clashing names and rows that take no part.
    rows = [(i, [float(x) / 64 for x in rng.integers(-3, 4, 3)]) for i in range(120)]
    rows += [(i, rows[5][1]) for i in range(200, 260)] + [(7, rows[7][1]), (None, rows[0][1])]
    rows += [(300, None), (301, [1.0, 2.0]), (302, [1.0, None, 2.0]), (303, [float("nan"), 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0])]
    rows += [(305, [])]
    frame = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    got = clustering.clustering_digest(frame, dim=3, k=k)
    assert ordered(got.collect()) == ordered(plain(rows, 3, k, 3))
    assert clustering.clustering_digest(frame.limit(0), dim=3, k=k).count() == 0
    few = [r for r in rows if r[0] in (1, 2)]
    assert ordered(clustering.clustering_digest(frame.filter("vec_id in (1, 2)"), dim=3, k=k).collect()) == ordered(plain(few, 3, k, 3))


def test_large_components(spark):
    rows = [(i, [float(x) * 2.0**50, float(i)]) for i, x in enumerate([1, 1, 2, 9, 9, 10, -8, -9])]
    got = clustering.clustering_digest(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), dim=2, k=3)
    cut = [(*r[:2], *(min(x, (1 << 63) - 1) for x in r[2:5]), r[5]) for r in plain(rows, 2, 3, 3)]
    assert ordered(got.collect()) == ordered(cut)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_tables(spark, folder):
    frame = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert ordered(clustering.clustering_digest(frame).collect()) == ordered(plain(rows, 64, 16, 3))


def test_looks_are_saved():
    """Vectors far from every border keep their centroid without a look."""
    rng = np.random.default_rng(3)
    cents = [[0, 0], [1000, 0], [0, 1000], [1000, 1000]]
    v = np.repeat(np.array(cents), 50, axis=0) + rng.integers(-20, 21, (200, 2))
    seen = []
    moved = clustering.Centroids([[x + 5, y] for x, y in cents], cents)
    first, second, upper, lower = clustering.shallot(
        v, clustering.Centroids(cents), np.zeros(200, int), np.ones(200, int), np.full(200, np.inf), np.zeros(200)
    )
    look = moved.distances
    moved.distances = lambda x, c: (seen.append(len(x)), look(x, c))[1]
    assert (clustering.shallot(v, moved, first, second, upper, lower)[0] == np.repeat(range(4), 50)).all()
    assert sum(seen) == 0
