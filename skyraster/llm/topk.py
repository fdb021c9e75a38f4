"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each the mean m and the deviation s (root of the mean squared
distance from m) are kept.  For segments of length L, the squared distance of two vectors is at least
the sum of L ((m - m')^2 + (s - s')^2), so with the vectors' own lengths known their inner product is
at most the sum of L (m m' + s s').  That bound is a small matrix product; it is taken coarse to fine
(1, 4, 16 segments), each level only while pairs remain, against the k-th best score so far of every
query.  Exact scores are computed for the survivors.

Queries and candidates are dealt into blocks by hash; a task compares one block of either.  Vectors
that are null, or hold null or non-finite components, take no part, nor do null ids; vectors of
different lengths are never compared.  Rows that repeat a vec_id are candidates each, but never for a
query of their own id, and a repeated query is answered once.  Scores beyond 64 bits are cut to them.
An empty table, or one without queries, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize_counted

LEVELS = (1, 4, 16)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>, dim) of the vectors that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim")
    )


def _summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose product with another's row bounds the inner product from above."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    means = np.stack([x[:, p].mean(axis=1) * np.sqrt(len(p)) for p in parts], axis=1)
    spread = np.stack([x[:, p].std(axis=1) * np.sqrt(len(p)) for p in parts], axis=1)
    return np.concatenate([means, spread], axis=1)


def _magnitude(q: np.ndarray, x: np.ndarray) -> int:
    """Bound of the inner products' absolute values."""
    largest = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))), 1) for m in (q, x)]
    return largest[0] * largest[1] * max(q.shape[1], 1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products as int64."""
    if _magnitude(q, x) < 1 << 62:
        return np.einsum("ij,ij->i", q, x)
    sums = (sum(map(int.__mul__, a, b)) for a, b in zip(q.tolist(), x.tolist(), strict=True))
    return np.array([min(max(s, 1 - (1 << 63)), (1 << 63) - 1) for s in sums], dtype=np.int64)


def best_of(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, chunk: int = 1024
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the k best of every query, by score and then id; x in the order of its ids."""
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    q_sums = [_summary(qf, s) for s in LEVELS]
    x_sums = [_summary(xf, s) for s in LEVELS]
    slack = 1.0 + 1e-9 * (np.linalg.norm(qf, axis=1) * np.linalg.norm(xf, axis=1).max(initial=0.0))
    row, ids, score = (np.zeros(0, dtype=np.int64) for _ in range(3))
    floor = np.full(len(q), -np.inf)
    dense_exact = _magnitude(q, x) < 1 << 53
    ends = [0, *range(min(64, len(x)), len(x), chunk), len(x)]
    for at, end in zip(ends, ends[1:], strict=False):
        part, dense = slice(at, end), len(q) * (end - at) // 8
        # Scores are whole numbers and ids ascend: a later candidate needs one more than the k-th best.
        need = (floor + 1 - slack)[:, None]
        alive = q_sums[0] @ x_sums[0][part].T >= need
        pairs = None
        for a, b in zip(q_sums[1:], x_sums[1:], strict=True):
            if pairs is None and np.count_nonzero(alive) > dense:
                alive &= a @ b[part].T >= need
                continue
            i, j = np.nonzero(alive) if pairs is None else pairs
            left = np.einsum("ij,ij->i", a[i], b[part][j]) >= need[i, 0]
            pairs = i[left], j[left]
        if pairs is None and dense_exact and np.count_nonzero(alive) > dense:
            exact = qf @ xf[part].T
            i, j = np.nonzero(alive & (exact > floor[:, None]))
            found, j = exact[i, j].astype(np.int64), j + at
        else:
            i, j = np.nonzero(alive) if pairs is None else pairs
            j = j + at
            found = [_exact(q[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)]
            found = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        own = q_ids[i] != x_ids[j]
        i, j, found = i[own], j[own], found[own]
        better = found > floor[i]
        row = np.concatenate([row, i[better]])
        ids = np.concatenate([ids, x_ids[j[better]]])
        score = np.concatenate([score, found[better]])
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < k
        last = place == k - 1
        floor[row[last]] = score[last]
        row, ids, score = row[top], ids[top], score[top]
    return row, ids, score


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return flat.reshape(len(ids), -1)[order], ids[order]


def _block_search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if candidates.num_rows and queries.num_rows:
            x, x_ids = _matrix(candidates)
            q, q_ids = _matrix(queries)
            row, ids, score = best_of(q, q_ids, x, x_ids, k)
            return pa.table({"query_id": q_ids[row], "vec_id": ids, "score": score})
        empty = pa.array([], pa.int64())
        return pa.table({"query_id": empty, "vec_id": empty, "score": empty})

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = 8192, candidate_block: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``quantised`` vectors for those that are queries."""
    data, seen = materialize_counted(
        vectors.withColumn("is_query", is_query), "vectors", {"queries": F.sum(is_query.cast("long"))}
    )
    q_blocks = max(1, ceil((seen["queries"] or 0) / query_block))
    c_blocks = max(1, ceil(seen["rows"] / candidate_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    cands = data.select("dim", "vec_id", "v", place(c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    queries = data.filter("is_query").select("dim", "vec_id", "v").distinct()
    queries = queries.select("dim", "vec_id", "v", place(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    keys = ["dim", "qb", "cb"]
    found = cands.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(
        _block_search(k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def topk_digest(vectors: DataFrame) -> DataFrame:
    return search(quantised(vectors), F.col("vec_id") % 20 == 0)
