"""Motion pairs as a stream-stream join whose state is bounded by the back-tracking limit."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tiles import cell_of
from ..operators.sweep import CHUNK, meetings

#: Time step 0 of the event clock.
EPOCH = "2024-01-01 00:00:00"
#: A cell is so many search windows wide.
CELL_WINDOWS = 8
#: Observations of one cell and time are packed in rows of so many; so many are looked through for one cell at a time.
PACK = 1024
BUFFER = 500_000
#: Rows of packs that a task takes at a time.
BATCH_PACKS = 256

_PACKED = "time int, cx bigint, cy bigint, obsid array<bigint>, x array<int>, y array<int>"
_PAIRS = "new_obsid bigint, existing_obsid bigint, new_time int, existing_time int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (obsid, time, x, y, cx, cy) of a task as one row per cell and time, or several of at most ``PACK``."""

    def packed(table: pa.Table) -> pa.RecordBatch:
        keys = [table[c].to_numpy() for c in ("placed", "cx", "cy", "time")]
        order = np.lexsort(keys)
        keys = [k[order] for k in keys]
        cut = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
        start = np.flatnonzero(cut)
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        start = np.flatnonzero(place % PACK == 0)
        ends = pa.array(np.r_[start, len(order)].astype("int32"))
        placed, cx, cy, time = (k[start] for k in keys)
        rows = table.take(pa.array(order)).combine_chunks()
        lists = {c: pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in ("obsid", "x", "y")}
        # Observations without a place move the watermark, but meet nobody.
        cells = {c: pa.array(v, pa.int64(), mask=~placed.astype(bool)) for c, v in (("cx", cx), ("cy", cy))}
        return pa.RecordBatch.from_pydict({"time": pa.array(time, pa.int32()), **cells, **lists})

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER:
            yield packed(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield packed(pa.Table.from_batches(held))


def _side(stream: DataFrame, prefix: str, delay: str, reach: int, size: int) -> DataFrame:
    """Packed observations under a prefix, in the cells that ``reach`` touches, with event time = EPOCH + time days and a
    watermark."""
    x, y = F.col("centerx").cast("int"), F.col("centery").cast("int")
    placed = x.isNotNull() & y.isNotNull()
    rows = stream.filter(F.col("time").isNotNull()).select(
        F.col("obsid").cast("long").alias("obsid"),
        F.col("time").cast("int").alias("time"),
        *[F.when(placed, c).otherwise(0).alias(n) for n, c in (("x", x), ("y", y))],
        placed.cast("int").alias("placed"),
    )
    for name, value in (("cx", F.col("x").cast("long")), ("cy", F.col("y").cast("long"))):
        rows = rows.withColumn(name, F.explode(F.sequence(cell_of(value - reach, size), cell_of(value + reach, size))))
    packed = rows.repartition("cx", "cy", "time").mapInArrow(_pack, _PACKED)
    event_time = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.col("time").cast("long") * 86400)
    return packed.select(
        event_time.alias(f"{prefix}_at"), *[F.col(c).alias(f"{prefix}_{c}") for c in packed.columns]
    ).withWatermark(f"{prefix}_at", delay)


def _unpack(d2: float):
    """Pairs of the observations of two packs, by exact distance."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[batch[p + c] for c in ("time", "obsid", "x", "y")] for p in ("n_", "e_")]
            steps = sides[0][0].to_numpy().astype("int64") - sides[1][0].to_numpy()
            values = [[s[2].values.to_numpy().astype("int64"), s[3].values.to_numpy().astype("int64")] for s in sides]
            ends = [s[1].offsets.to_numpy() for s in sides]
            found, rows = [], 0
            for row, step in enumerate(steps.tolist()):
                n, e = (slice(at[row], at[row + 1]) for at in ends)
                places = [v[part] for v, part in zip((*values[0], *values[1]), (n, n, e, e))]
                for i, j in meetings(*places, d2 * float(step), CHUNK):
                    if len(i):
                        found.append((i + n.start, j + e.start, np.full(len(i), row)))
                        rows += len(i)
                if found and (rows >= CHUNK or row + 1 == len(steps)):
                    i, j, at = (pa.array(np.concatenate(c)) for c in zip(*found))
                    columns = sides[0][1].values.take(i), sides[1][1].values.take(j), sides[0][0].take(at), sides[1][0].take(at)
                    yield pa.RecordBatch.from_arrays(list(columns), ["new_obsid", "existing_obsid", "new_time", "existing_time"])
                    found, rows = [], 0

    return pairs


def motion_pair_stream(
    new: DataFrame, history: DataFrame, d2: float, t: int, delay: str = "1 day"
) -> DataFrame:
    """(new, existing) pairs of two streams of observations.

    Equality on grid cells and a range on event time: rows older than ``t`` days plus ``delay`` can
    no longer match and leave the state.  Observations of a cell and time are one row of the state and of the join; the
    pairs in two such rows are found by the task that holds them.
    """
    reach = int(d2 * t)
    size = CELL_WINDOWS * (2 * reach + 1)
    left, right = _side(new, "n", delay, reach, size), _side(history, "e", delay, 0, size)
    on = (
        (F.col("n_cx") == F.col("e_cx"))
        & (F.col("n_cy") == F.col("e_cy"))
        & (F.col("e_at") >= F.col("n_at") - F.expr(f"INTERVAL {int(t)} DAYS"))
        & (F.col("e_at") < F.col("n_at"))
    )
    met = left.join(right, on).select(*[f"{p}_{c}" for p in ("n", "e") for c in ("time", "obsid", "x", "y")])
    return met.mapInArrow(_unpack(float(d2)), _PAIRS)


def stream_pairs(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    path: str,
    d2: float,
    t: int,
    files_per_batch: int | None = 1,
    partitions: int | None = None,
) -> DataFrame:
    """Run all new files of ``source`` through the join and return the pairs written so far.

    Observations that arrive more than the watermark's delay behind the newest one find no partners
    any more: that bounds the state.  Their number is counted and warned of.  A batch takes
    ``files_per_batch`` files, or all that are new with ``None``.

    The number of state partitions is fixed for the life of a stream; ``partitions`` sets it for
    this stream only (default: the session's shuffle partitions).
    """
    session = spark.newSession()
    session.conf.set(
        "spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    )

    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_PACKS))

    def stream() -> DataFrame:
        reader = session.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(source)

    pairs = motion_pair_stream(stream(), stream(), d2, t)
    query = (
        pairs.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/pairs")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for step in query.recentProgress for op in step.stateOperators)
    if late:
        warnings.warn(f"{late} packs of late observations were dropped", stacklevel=2)
    return spark.read.schema(pairs.schema).parquet(f"{path}/pairs")
