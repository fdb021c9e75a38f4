"""Mixing sources to target weights by Poisson replication.

Every source gets the rate at which its documents must repeat so that its share of the mixture is its
share of the weights.  A document's number of copies is Poisson with that mean: a hash of the seed and
its doc_id gives a uniform number, which the source's cumulative distribution is inverted at.  So no
state is kept, a lost task repeats the same counts, and repeated rows of one doc_id get equal counts.
The copies are then put in the order of a second hash over the whole mixture; that hash is uniform, so
its ranges are known without sampling the data.

A large rate (a small source must fill its share) is split into draws of a bounded mean with hashes of their own,
whose sum has the same distribution, so a source's table has a bounded length at any rate.

A null source is a source of its own and a null text counts as empty; an empty table gives an empty
mixture.  A source that the weights do not name has the default weight; weight 0 leaves it out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize_counted
from .common import let

#: A greater rate is the sum of several draws of this mean at most, so that no table of a source is long.
DRAW_RATE = 64.0
#: Source tables with up to this many entries (8 bytes each) are broadcast; larger ones are joined by source and salt.
BROADCAST_SOURCES = 1 << 20
SALTS = 32


def uniform_hash(digits: int, *parts: Column) -> Column:
    """The first hex digits of an MD5 of the joined parts, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below the resolution of the hash; for rates up to ``DRAW_RATE``."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(
            log.alias("log"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + F.exp(log))).alias("cdf")
        )

    return F.when(
        rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])
    ).otherwise(F.array(F.lit(1.0)))


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, default: float = 1.0, epochs: float = 1.0
) -> DataFrame:
    """(source, size, rate): bytes of text plus one per document, and the mean number of copies.

    The mixture is expected to hold ``epochs`` times the bytes of ``docs``.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    weight = F.lit(float(default))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source") == name, float(value)).otherwise(weight)
    sizes, seen = materialize_counted(
        sizes.withColumn("weight", weight), "source-sizes", {"bytes": F.sum("size"), "weights": F.sum("weight")}
    )
    share = F.col("weight") / F.lit(seen["weights"] or 1.0)
    return sizes.select("source", "size", (share * F.lit(float(epochs * (seen["bytes"] or 0))) / F.col("size")).alias("rate"))


def replicate(docs: DataFrame, rates: DataFrame, seed: int = 11) -> DataFrame:
    """Add ``n_copies`` and ``copy`` (from 1) and repeat each row by its Poisson count."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW_RATE)).cast("int")
    tables = rates.select(F.col("source").alias("of"), draws.alias("draws"), (F.col("rate") / draws).alias("mean"))
    tables = tables.select("of", "draws", poisson_cdf(F.col("mean")).alias("cdf"))
    tables, seen = materialize_counted(tables, "source-tables", {"entries": F.sum(F.size("cdf"))})
    rows = docs.select(F.struct("*").alias("row"), "source", "doc_id")
    if (seen["entries"] or 0) <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(tables), F.col("source").eqNullSafe(F.col("of")))
    else:
        spread = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(
            spread, F.col("source").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt"))
        )

    def copies(hashed: Column) -> Column:
        """The smallest k with cdf(k) >= draw is the number of entries below the draw."""
        return let((hashed + 0.5) / float(1 << 52), lambda draw: F.size(F.filter("cdf", lambda p: p < draw)))

    more = F.aggregate(
        F.sequence(F.lit(1), F.col("draws") - 1),
        F.lit(0).cast("long"),
        lambda total, n: total + copies(uniform_hash(13, F.lit(seed), F.col("doc_id"), n)),
    )
    first = copies(uniform_hash(13, F.lit(seed), F.col("doc_id"))).cast("long")
    counted = joined.withColumn("n_copies", F.when(F.col("draws") > 1, first + more).otherwise(first))
    return (
        counted.filter(F.col("n_copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
        .select("row.*", "n_copies", "copy")
    )


def shuffled(rows: DataFrame, seed: int = 11, into: str = "mix_key") -> DataFrame:
    """Global order by a uniform 60-bit hash of (seed, doc_id, copy)."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn(into, uniform_hash(15, F.lit(seed), F.col("doc_id"), F.col("copy")))
    place = F.shiftright(F.shiftright(into, 30) * count, 30).cast("int")
    return keyed.repartitionById(count, place).sortWithinPartitions(into, "doc_id", "copy")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    default: float = 1.0,
    epochs: float = 1.0,
    seed: int = 11,
) -> DataFrame:
    """The shuffled mixture: rows of ``docs`` with ``n_copies``, ``copy`` and ``mix_key``.

    Columns of these names in ``docs`` are replaced.
    """
    own = docs.drop("n_copies", "copy", "mix_key")
    return shuffled(replicate(own, source_rates(own, weights, default, epochs), seed), seed)
