"""Small helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Upper to lower case of the 26 ASCII letters only.
LOWER_ASCII = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores in front of it as make it a column that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column, block: int = 256) -> Column:
    """Sum of the elements before each element of an integer array.

    Blocks are summed on their own and then shifted, so that long arrays are not copied per element.
    """

    def append(sums: Column, more: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + more))

    def blocks(array: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(block))
        return F.transform(starts, lambda at: F.slice(array, at, block))

    zero = F.array(F.lit(0).cast("int"))
    inner = F.transform(let(values, blocks), lambda part: F.aggregate(part, zero, append))

    def shifted(parts: Column) -> Column:
        totals = F.aggregate(F.transform(parts, lambda x: F.element_at(x, -1)), zero, append)
        return F.flatten(
            F.zip_with(
                parts,
                F.slice(totals, 1, F.size(parts)),
                lambda part, base: F.transform(F.slice(part, 1, F.size(part) - 1), lambda x: x + base),
            )
        )

    return let(inner, shifted)


def by_size(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        yield batch.slice(start)
