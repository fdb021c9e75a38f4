"""SimHash near-duplicates by covering locality-sensitive hashing.

Pagh, "CoveringLSH: Locality-Sensitive Hashing without False Negatives" (2016): every bit position
gets a vector m(i) of radius + 1 bits, and every non-zero vector v gives a mask of the positions with
an odd m(i) . v.  The at most ``radius`` positions in which two fingerprints differ do not span the
whole space, so some v is orthogonal to all of them: in that table the masked fingerprints are equal.
A pair within the radius therefore always meets, in one of 2^(radius+1) - 1 tables.

Equal fingerprints are folded first.  The rows of a table are sorted by masked key; keys that only
one fingerprint has are skipped.  Inside a key the pairs are compared by bits in array operations,
and what leaves the task is a spanning forest of the links, never all pairs.  A key with more than
``crowd`` fingerprints is not compared in one task: its fingerprints are keyed again by the choices of
blocks of the other bits that a pair within the radius must share (also without false negatives), and
what is still crowded then is compared slice against slice, in as many tasks as there are slice pairs.

A null text counts as one without words; its fingerprint is zero and links like any other.  Rows
with a null doc_id take part and get the smallest doc_id of their component, null if it has none.  Repeated rows are
one class.  An empty table gives no rows.  A text is hashed whole, in parts of 65,536 shingles at a time for the bits.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, materialize_counted
from .common import LOWER_ASCII, WORD
from .graph import components

BITS = 64
SEED = 42


def _fingerprint(text: str | None, shingle: int) -> int:
    words = WORD.findall((text or "").translate(LOWER_ASCII))
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [" ".join(words)]
    else:
        grams = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return int(bits.astype(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, into: str = "fingerprint") -> DataFrame:
    """Add the 64-bit SimHash of the words' shingles as a long."""

    @F.pandas_udf("long")
    def fingerprint(texts):
        return texts.map(lambda t: _fingerprint(t if isinstance(t, str) else None, shingle))

    return docs.withColumn(into, fingerprint(F.col(text).cast("string")))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask per non-zero v; the vectors m(i) go through all non-zero ones in turn."""
    space = 1 << (radius + 1)
    vectors = [1 + i % (space - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, space)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _keys(fp: Column, masks: list[int]) -> Column:
    """array<struct<t, key>>: masked fingerprints of all tables."""
    return F.array(
        *[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]
    )


def _sub_masks(masks: list[int], radius: int, parts: int) -> list[tuple[int, int]]:
    """(t, mask): the bits outside mask t are dealt to ``parts`` blocks, of which a pair within the
    radius shares parts - radius; one mask for each choice."""
    out = []
    for t, mask in enumerate(masks):
        free = [i for i in range(BITS) if not mask >> i & 1]
        blocks = [sum(1 << i for i in free[p::parts]) for p in range(parts)]
        out += [(t, sum(chosen)) for chosen in itertools.combinations(blocks, parts - radius)]
    return out


def _forest(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each group of a sorted array; ``group`` numbers the groups."""
    ends = np.searchsorted(group, group, side="right")
    here = np.arange(len(fps))
    lead, shift = here.copy(), 1
    while True:
        left = np.flatnonzero(here + shift < ends)
        if not len(left):
            break
        near = np.bitwise_count(fps[left] ^ fps[left + shift]) <= radius
        _union(lead, left[near], left[near] + shift)
        shift += 1
    moved = np.flatnonzero(lead != here)
    return fps[moved], fps[lead[moved]]


def _union(lead: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of a and b in place; leaders are the smallest positions."""
    while len(a):
        ra, rb = lead[a], lead[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(lead, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(jumped := lead[lead], lead):
            lead[:] = jumped


def _links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def _sorted_links(radius: int):
    """mapInArrow function over rows (t, key, fp) sorted by (t, key): links inside equal (t, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows, rest = rest, None
            else:
                rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
            if rows is None or not rows.shape[1]:
                continue
            fresh = np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)
            group = np.concatenate([[0], np.cumsum(fresh)])
            if batch is not None:  # the last group may go on in the next batch
                cut = np.searchsorted(group, group[-1])
                rest, rows, group = rows[:, cut:], rows[:, :cut], group[:cut]
            shared = np.bincount(group, minlength=1)[group] > 1
            u, v = _forest(rows[2, shared].view(np.uint64), group[shared], radius)
            if len(u):
                yield _links(u, v)

    return run


def _slice_links(radius: int, block: int = 512):
    """applyInArrow function: links between two slices (side 0 and 1) of one crowded key."""

    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        a, b = np.sort(fps[side == 0]), np.sort(fps[side == 1])
        if not len(b):
            b = a
        both = np.concatenate([a, b])
        lead = np.arange(len(both))
        for at in range(0, len(a), block):
            near = np.bitwise_count(a[at : at + block, None] ^ b[None, :]) <= radius
            i, j = np.nonzero(near)
            _union(lead, i + at, j + len(a))
        moved = np.flatnonzero(both != both[lead])
        return pa.Table.from_batches([_links(both[moved], both[lead[moved]])])

    return run


def _compare(rows: DataFrame, radius: int) -> DataFrame:
    return (
        rows.select("t", "key", "fp")
        .repartition("t", "key")
        .sortWithinPartitions("t", "key", "fp")
        .mapInArrow(_sorted_links(radius), "u long, v long")
    )


def _crowded(rows: DataFrame, crowd: int) -> DataFrame:
    return rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)


def links(fps: DataFrame, radius: int, crowd: int = 4096, parts: int = 6) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp``; their components are those of all pairs
    within the radius."""
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("k")).select("k.t", "k.key", "fp")
    hot, seen = materialize_counted(_crowded(keyed, crowd), "crowded-keys")
    if not seen["rows"]:
        return _compare(keyed, radius)
    # Keys with one fingerprint only never reach the crowd, so hot is small against the table; both
    # joins are on its keys and skewed partitions may be split.
    easy = keyed.join(hot.select("t", "key"), ["t", "key"], "left_anti")
    dense = keyed.join(hot.select("t", "key"), ["t", "key"], "left_semi")
    finer = F.array(
        *[
            F.struct(
                F.lit(t).alias("t"),
                F.lit(n).alias("choice"),
                F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("sub"),
            )
            for n, (t, m) in enumerate(_sub_masks(masks, radius, parts))
        ]
    )
    wanted = F.filter(finer, lambda x: x["t"] == F.col("t"))
    dense = dense.select("key", "fp", F.explode(wanted).alias("k")).select(
        F.col("k.choice").alias("t"), F.xxhash64("key", "k.sub").alias("key"), "fp"
    )
    dense = materialize(dense.distinct(), "crowded-fingerprints")
    still, seen = materialize_counted(_crowded(dense, crowd), "crowded-again")
    found = _compare(easy, radius)
    if not seen["rows"]:
        return found.unionByName(_compare(dense, radius))
    found = found.unionByName(_compare(dense.join(still.select("t", "key"), ["t", "key"], "left_anti"), radius))
    slices = F.ceil(F.col("n") / crowd).cast("int")
    sliced = dense.join(still, ["t", "key"]).select(
        "t", "key", "fp", slices.alias("slices"), F.pmod(F.xxhash64("fp"), slices).cast("int").alias("own")
    )
    pairs = sliced.select(
        "t", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    ).select(
        "t",
        "key",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        "fp",
    )
    return found.unionByName(
        pairs.groupBy("t", "key", "a", "b").applyInArrow(_slice_links(radius), "u long, v long")
    )


def _classes(rows: DataFrame, radius: int, crowd: int) -> DataFrame:
    """(fp, first_id, component_key) of the distinct fingerprints of ``rows(doc_id, fingerprint)``."""
    distinct = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first_id"))
    distinct = materialize(distinct, "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius, crowd))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("component_key")
    )
    return materialize(labelled, "fingerprint-components")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, crowd: int = 4096
) -> DataFrame:
    """(doc_id, fingerprint long, component_id, component_key) of every row of ``docs``.

    ``component_id`` is the smallest doc_id of the component, ``component_key`` its smallest fingerprint.
    """
    rows = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle)
    rows = materialize(rows.select("doc_id", "fingerprint"), "fingerprints")
    labelled = _classes(rows, radius, crowd)
    least = labelled.groupBy("component_key").agg(F.min("first_id").alias("component_id"))
    classes = labelled.drop("first_id").join(least, "component_key")
    return rows.join(classes.withColumnRenamed("fp", "fingerprint"), "fingerprint").select(
        "doc_id", "fingerprint", "component_id", "component_key"
    )


def one_of_each(docs: DataFrame, radius: int = 3, shingle: int = 3, crowd: int = 4096) -> DataFrame:
    """The row with the smallest doc_id of every component; one of equal rows.

    The texts are shuffled once, by fingerprint and doc_id, so that a crowd of copies spreads out.
    """
    rows = materialize(with_fingerprint(docs, "text", shingle, "_fp"), "fingerprinted")
    labelled = _classes(rows.select("doc_id", F.col("_fp").alias("fingerprint")), radius, crowd)
    return keep_first(rows, labelled, docs.columns)


def keep_first(rows: DataFrame, labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Of ``rows`` with their class ``_fp``, one of smallest doc_id per component of ``labelled``."""
    first = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("fp").alias("fp"))
    kept = labelled.groupBy("component_key").agg(F.min(first).alias("k"))
    kept = kept.select(F.col("k.fp").alias("_fp"), F.col("k.id").alias("_keep"))
    same = (rows["_fp"] == kept["_fp"]) & rows["doc_id"].eqNullSafe(kept["_keep"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["_fp", "doc_id"]).select(*columns)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def component_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id",
        hex_fingerprint(F.col("fingerprint")).alias("fingerprint"),
        "component_id",
    )
