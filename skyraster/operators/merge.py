"""Loading into an existing table: duplicate policies, merging of pieces, id sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one_per_key(rows: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (
        rows.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*rows.columns)
    )


def load_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Add rows; a key that exists already keeps its row.  ``order`` says which of several incoming
    rows of one key comes first (without it incoming keys must be unique)."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)
    if order:
        fresh = _one_per_key(fresh, keys, order, last=False)
    return existing.unionByName(fresh)


def load_replace(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Add rows; an incoming row takes the place of one with the same key, the last one wins."""
    latest = _one_per_key(incoming, keys, order, last=True) if order else incoming
    kept = existing.join(latest.select(*keys), keys, "left_anti").select(*existing.columns)
    return kept.unionByName(latest)


def merge_pieces(pieces: list[DataFrame], keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One table of the outputs of several pieces; for a repeated key the earliest piece wins.

    ``order`` ranks repeated rows inside a piece; without it the rows of one piece have distinct keys.
    """
    tagged = [piece.withColumn("_piece", F.lit(i)) for i, piece in enumerate(pieces)]
    everything = reduce(DataFrame.unionByName, tagged)
    return _one_per_key(everything, keys, ["_piece", *(order or [])], last=False).drop("_piece")


def distinct_ids(rows: DataFrame, column: str) -> DataFrame:
    """Distributed id set for semi joins."""
    return rows.select(F.col(column).alias("id")).distinct()


def overwrite_result(result: DataFrame, path: str) -> DataFrame:
    """Replace a stored result table and read it back.

    Only for paths the result itself does not read from.
    """
    result.write.mode("overwrite").parquet(path)
    return result.sparkSession.read.schema(result.schema).parquet(path)
