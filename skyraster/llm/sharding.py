"""K-d tree sharding: shards of near-equal bytes whose rows are close in their metadata.

A node of the tree holds rows for some number of shards.  It is split along the metadata dimension in
which its rows spread widest, at the weighted quantile of bytes that divides the shards in two halves,
until each leaf is one shard.  Quantiles of all nodes of a level are found together: a histogram of
bytes over each node's range, then one over the bin that holds the quantile, and so on until that bin
weighs next to nothing.  Only histograms (nodes times bins) come to the driver.  Ties of a dimension are
broken by a hash, so one value may hold any share of the rows and still be split.

The tree is a conditional expression over the row, so it needs no join.  Null metadata come first in
their dimension; a null text has no bytes.  Repeated rows may lie in one shard or several.  An empty
table gives no rows; shards are empty where there are fewer rows than shards.  A text longer than a shard's share
makes its shard as much larger, as rows are not cut.  Other columns of any name are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordinals import running_offset
from ..session import materialize, materialize_counted

CODE_BITS, TIE_BITS = 31, 31
ROW_BYTES = 16


@dataclass
class Node:
    """Shards first .. first + count - 1; inner nodes send keys of ``dim`` below ``cut`` to the left."""

    first: int
    count: int
    dim: str = ""
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def expression(self) -> Column:
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(self.dim) < F.lit(self.cut), self.left.expression()).otherwise(self.right.expression())

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()


def _codes(rows: DataFrame, dims: list[str]) -> dict[str, Column]:
    """Every dimension as a whole number below 2^31, null as 0: numbers by their place in the range,
    other values by a hash."""
    kinds = dict(rows.dtypes)
    numeric = [d for d in dims if kinds[d] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    value = lambda d: F.nanvl(F.col(d).cast("double"), F.lit(None))
    ends = [f(value(d)).alias(f"{name}{i}") for i, d in enumerate(numeric) for name, f in (("lo", F.min), ("hi", F.max))]
    found = rows.agg(*ends).first() if ends else None
    out = {}
    top = (1 << CODE_BITS) - 2
    for d in dims:
        if d in numeric:
            low, high = found[f"lo{numeric.index(d)}"], found[f"hi{numeric.index(d)}"]
            wide = (high - low) if low is not None and high > low else 1.0
            code = 1 + F.floor((value(d) - F.lit(low or 0.0)) / F.lit(wide) * (top - 1))
        else:
            code = F.shiftright(F.crc32(F.col(d).cast("string")), 1)
        out[d] = F.coalesce(F.least(code.cast("long"), F.lit(top)), F.lit(0)).cast("long")
    return out


def keyed(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Add ``_k0``, ``_k1``, ...: code of each dimension, then a hash of the row that breaks its ties."""
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 64 - TIE_BITS)
    codes = _codes(rows, dims)
    return rows.select("*", *[(F.shiftleft(codes[d], TIE_BITS) + tie).alias(f"_k{i}") for i, d in enumerate(dims)])


def grow(rows: DataFrame, keys: list[str], shards: int, bins: int = 1024, tolerance: float = 0.001) -> Node:
    """The tree over ``rows`` with columns ``size`` and ``keys``."""
    root = Node(0, shards)
    while open_nodes := {n.first: n for n in root.leaves() if n.count > 1}:
        here = rows.withColumn("_node", root.expression()).filter(F.col("_node").isin(*open_nodes))
        ends = [f(k).alias(f"{name}{k}") for k in keys for name, f in (("lo", F.min), ("hi", F.max))]
        search = {}
        for r in here.groupBy("_node").agg(F.sum("size").alias("bytes"), *ends).collect():
            node = open_nodes[r["_node"]]
            node.dim = max(keys, key=lambda k: (r[f"hi{k}"] >> TIE_BITS) - (r[f"lo{k}"] >> TIE_BITS))
            half = node.count // 2
            # low and high end of the searched keys, bytes still to go below the cut, byte tolerance
            search[node.first] = [r[f"lo{node.dim}"], r[f"hi{node.dim}"] + 1, r["bytes"] * half / node.count, tolerance * r["bytes"] / node.count]
        while search:
            place = F.lit(None).cast("long")
            for first, (low, high, _, _) in search.items():
                dim = open_nodes[first].dim
                width = (high - low + bins - 1) // bins
                place = F.when(
                    (F.col("_node") == first) & (F.col(dim) >= F.lit(low)) & (F.col(dim) < F.lit(high)),
                    F.expr(f"({dim} - {low}L) div {width}L"),
                ).otherwise(place)
            histogram: dict[int, list] = {}
            counted = here.withColumn("_bin", place).filter(F.col("_bin").isNotNull())
            for r in counted.groupBy("_node", "_bin").agg(F.sum("size").alias("bytes")).collect():
                histogram.setdefault(r["_node"], []).append((r["_bin"], r["bytes"]))
            for first in list(search):
                low, high, wanted, small = search[first]
                width = (high - low + bins - 1) // bins
                for at, weight in sorted(histogram[first]):
                    if weight >= wanted:
                        break
                    wanted -= weight
                start = low + at * width
                if width == 1 or weight <= small:
                    open_nodes[first].cut = start + width if 2 * wanted > weight else start
                    del search[first]
                else:
                    search[first] = [start, min(start + width, high), wanted, small]
        for node in open_nodes.values():
            half = node.count // 2
            node.dim = node.dim or keys[0]
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.count - half)
    return root


def shard(
    docs: DataFrame,
    shards: int = 40,
    dims: tuple[str, ...] = ("doc_id", "n_chars", "source", "lang"),
    slice_rows: int = 50_000,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shard of every row, and its place there from 0."""
    body = F.coalesce(F.col("text"), F.lit(""))
    names = [d for d in dims if d in docs.columns]
    rows = docs.select(
        "doc_id",
        *[F.col(d).alias(f"_d{i}") for i, d in enumerate(names)],
        (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows, seen = materialize_counted(rows, "shard-rows")
    rows = materialize(keyed(rows, [f"_d{i}" for i in range(len(names))]), "shard-keys")
    tree = grow(rows, [f"_k{i}" for i in range(len(names))], shards)
    slices = max(1, -(-seen["rows"] // (shards * slice_rows)))
    placed = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        tree.expression().alias("shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slices)).alias("_bucket"),
    )
    return running_offset(placed, ["shard"], ["_bucket"], ["doc_id", "text_crc32"], name="slot").drop("_bucket")


def shard_digest(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
