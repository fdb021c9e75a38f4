"""Exact k-means on integer vectors with Shallot search (Borgelt, "Even Faster Exact k-Means Clustering", 2020).

Every vector remembers its nearest and its second-nearest centroid, a bound from above of the distance to the
first and a bound from below of the distance to any other.  When the centroids have moved, the bounds move by
as much; a vector whose upper bound stays below the lower one, or below half of the way to the next centroid,
keeps its centroid without a look at any.  For the others the distances to the two remembered centroids are
computed, and the search starts at the closer one: its neighbours come in order of their distance from it,
and the scan ends at the first that lies beyond the distance to the start plus the second-best distance so far.
That ball shrinks while the scan goes on.  Bounds are floating point with slack towards a look; whatever is
looked at is compared by whole squared distances and then by number, so the result is exact, ties included.

Vectors and bounds are a table that every round writes once; centroids are ``k`` rows and the sums that make
the next ones are aggregated before they reach the driver, so nothing there grows with the number of vectors.

Vectors that are null, of another length than ``dim``, or hold null or non-finite components take no part.
Repeated rows count each.  Rows with a null vec_id are clustered, but never seeds.  Fewer vectors than ``k`` make
fewer centroids, an empty table none.  Components beyond 64 bits and distances and sums beyond them are cut to
64 bits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize_counted

_SLACK = 1e-9
_LONG = (1 << 63) - 1
_STATE = "vec_id long, v array<long>, cluster int, second int, upper double, lower double, distance long"


def quantised(vectors: DataFrame, dim: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & finite)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class Centroids:
    """Centroids with their distances from one another, and how far they have moved."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows, self.k = rows, len(rows)
        large = max((abs(c) for row in rows for c in row), default=0)
        self.large = large
        exact = np.array(rows, dtype=object)
        apart = [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in rows] for p in rows]
        self.apart = np.sqrt(np.array(apart, dtype=np.float64)).reshape(self.k, self.k)
        self.exact = exact if large > 1 << 62 else exact.astype(np.int64)
        off = self.apart + np.diag(np.full(self.k, np.inf))
        self.half_gap = off.min(axis=1, initial=np.inf) / 2
        #: Neighbours of each centroid in order of distance, without itself.
        self.near = np.argsort(off, axis=1, kind="stable")[:, : self.k - 1]
        self.near_apart = np.take_along_axis(off, self.near, axis=1)
        moved = [float(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) ** 0.5 for p, q in zip(rows, before or rows, strict=True)]
        self.moved = np.array(moved)
        others = [max((m for j, m in enumerate(moved) if j != i), default=0.0) for i in range(self.k)]
        self.others_moved = np.array(others)

    def distances(self, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whole squared distances of the vectors from one centroid each."""
        limit = (int(np.abs(v).max(initial=0)) if v.dtype != object else 1 << 63) + self.large
        if v.dtype == object or limit * limit * max(v.shape[1], 1) >= 1 << 62:
            d = v.astype(object) - np.asarray(self.exact, dtype=object)[which]
            return (d * d).sum(axis=1)
        d = v - self.exact[which]
        return np.einsum("ij,ij->i", d, d)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def shallot(v: np.ndarray, cents: Centroids, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """New (first, second, upper, lower) after the centroids moved."""
    first, second = first.copy(), second.copy()
    upper = (upper + cents.moved[first]) * (1 + _SLACK)
    lower = (lower - cents.others_moved[first]) * (1 - _SLACK)

    def unsure(rows: np.ndarray) -> np.ndarray:
        safe = np.maximum(lower[rows], cents.half_gap[first[rows]] * (1 - _SLACK))
        return rows[~(upper[rows] < safe)]

    rows = unsure(np.arange(len(v)))
    if not len(rows):
        return first, second, upper, lower
    upper[rows] = _root(cents.distances(v[rows], first[rows])) * (1 + _SLACK)
    rows = unsure(rows)
    if not len(rows):
        return first, second, upper, lower
    x, a, b = v[rows], first[rows], second[rows]
    d1, d2 = cents.distances(x, a), cents.distances(x, b)
    swap = (d2 < d1) | ((d2 == d1) & (b < a))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, other, reach = a.copy(), b.copy(), _root(d1)
    live = np.arange(len(rows))
    for step in range(cents.k - 1):
        ball = (reach[live] + _root(d2[live])) * (1 + _SLACK)
        live = live[cents.near_apart[start[live], step] <= ball]
        if not len(live):
            break
        c = cents.near[start[live], step]
        seen = live[c != other[live]]
        c = c[c != other[live]]
        d = cents.distances(x[seen], c)
        best = (d < d1[seen]) | ((d == d1[seen]) & (c < a[seen]))
        better = ~best & ((d < d2[seen]) | ((d == d2[seen]) & (c < b[seen])))
        top, runner = seen[best], seen[better]
        b[top], d2[top] = a[top], d1[top]
        a[top], d1[top] = c[best], d[best]
        b[runner], d2[runner] = c[better], d[better]
    first[rows], second[rows] = a, b
    upper[rows], lower[rows] = _root(d1) * (1 + _SLACK), _root(d2) * (1 - _SLACK)
    return first, second, upper, lower


def _assign(cents: Centroids, dim: int, final: bool, chunk: int = 8192):
    names = [c.split()[0] for c in _STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, chunk) for b in batches for at in range(0, b.num_rows, chunk)):
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            if np.abs(v.astype(np.float64)).max(initial=0) > 1 << 62:
                v = v.astype(object)
            state = [batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower")]
            first, second, upper, lower = shallot(v, cents, *state)
            distance = cents.distances(v, first) if final else np.zeros(len(v), dtype=np.int64)
            if distance.dtype == object:
                distance = np.array([min(d, _LONG) for d in distance], dtype=np.int64)
            columns = [batch.column("vec_id"), batch.column("v"), *map(pa.array, (first, second, upper, lower, distance))]
            columns[2:4] = [pa.array(c, pa.int32()) for c in (first, second)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _means(state: DataFrame, dim: int, exact: str, cents: list[list[int]]) -> list[list[int]]:
    """Floors of the means of the clusters; empty ones keep their centroid."""
    sums = [F.sum(F.get("v", F.lit(i)).cast(exact)).alias(f"s{i}") for i in range(dim)]
    found = {r["cluster"]: r for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    return [[int(found[c][f"s{i}"]) // found[c]["n"] for i in range(dim)] if c in found else own for c, own in enumerate(cents)]


def seeds(data: DataFrame, k: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids; rows of one id in order of their components."""
    named = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = data.filter(F.col("vec_id").isNotNull()).select(named.alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r.v) for r in first.collect()]


def cluster(data: DataFrame, dim: int = 64, k: int = 16, rounds: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of ``quantised`` vectors after ``rounds`` updates, and the centroids."""
    size = F.greatest(F.array_max("v"), -F.array_min("v").cast("decimal(20,0)"))
    data, seen = materialize_counted(data, "vectors", {"size": F.max(size)})
    cents = seeds(data, k)
    if not cents:
        nothing = data.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.filter(F.lit(False)), cents
    # Sums fit 64 bits if as many of the largest components do; else they are kept in decimals.
    exact = "long" if int(seen["size"] or 0) * seen["rows"] < 1 << 62 else "decimal(38,0)"
    start: list[Column] = [F.lit(0).alias("cluster"), F.lit(min(1, len(cents) - 1)).alias("second")]
    start += [F.lit(float("inf")).alias("upper"), F.lit(0.0 if len(cents) > 1 else float("inf")).alias("lower")]
    state, before = data.select("*", *start), None
    for step in range(rounds + 1):
        found = state.mapInArrow(_assign(Centroids(cents, before), dim, step == rounds), _STATE)
        state, _ = materialize_counted(found, "clusters")
        if step < rounds:
            before, cents = cents, _means(state, dim, exact, cents)
    return state.select("vec_id", "cluster", "distance"), cents


def clustering_digest(vectors: DataFrame, dim: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, cents = cluster(quantised(vectors, dim), dim, k, rounds)
    spark = vectors.sparkSession
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = min(sum(int(r.s) for r in sums), _LONG)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    told = spark.createDataFrame(
        [(r.cluster, min(int(r.s), _LONG), whole, hashes[r.cluster]) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
