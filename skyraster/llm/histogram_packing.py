"""Best-fit packing planned on the histogram of lengths.

Documents are encoded once; what is kept of a piece is its length, its checksum and its rank among the
pieces of that length in its task.  The histogram of lengths has at most ``window`` rows at any size of the
input, so the plan is made of counts: lengths are placed from the longest down, all pieces of a length at
once, each into the open sequences with the least room that holds it.  Sequences that were filled alike are
one run of sequence numbers with a count, never single sequences.  Only runs are split, twice per length at
most, so the number of runs and the size of the plan depend on the window and not on the number of documents.

Pieces of a length then take the planned slots by their rank: the ranks of a task start where those of the
tasks before it end (sums over tasks by length), and the slot of a rank is found in the plan's ranges.  So a
length that a third of all documents have is never sorted or gathered.

A null text counts as empty and gives one piece with the end id only; repeated rows are packed once each and
null ids pass through.  Only documents longer than the window are cut, into whole windows and a rest.  Other
columns are ignored; an empty table gives no pieces.  A text is encoded whole, so the longest text bounds the
memory of its task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import by_size
from .packing import encoder

_CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seat long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan(counts: dict[int, int], window: int) -> np.ndarray:
    """Best fit by counts: rows of (length, first rank, first sequence, pieces per sequence, offset, end rank).

    The pieces of a length with ranks from the first to the end lie ``pieces per sequence`` to a sequence, from
    the offset on, in sequences numbered from the first.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of (first sequence, sequences)
    rows, used = [], 0

    def put(length: int, first: int, space: int, each: int, number: int, rank: int) -> None:
        rows.append((length, rank, first, each, window - space, rank + each * number))
        if space > each * length:
            room.setdefault(space - each * length, []).append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for space in sorted(s for s in room if s >= length):
            each = space // length
            while left and room.get(space):
                first, number = room[space].pop()
                full = min(number, left // each)
                if full:
                    put(length, first, space, each, full, rank)
                    left, rank = left - full * each, rank + full * each
                if full < number and left:  # one sequence takes the last pieces, fewer than fit
                    put(length, first + full, space, left, 1, rank)
                    full, left, rank = full + 1, 0, rank + left
                if full < number:
                    room[space].append((first + full, number - full))
            if not room.get(space):
                room.pop(space, None)
            if not left:
                break
        each = window // length
        for per, number in ((each, left // each), (left % each, 1)):
            if per and number:
                put(length, used, window, per, number, rank)
                used, rank = used + number, rank + per * number
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def _cut(path: str, window: int, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seats = encoder(path).encode, np.zeros(window + 1, dtype=np.int64)
        for batch in by_size(batches, "text"):
            rows = []
            part = batch.column("part")[0].as_py()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * window)):
                    own = ids[at : at + 4 * window]
                    length = len(own) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), part, int(seats[length])))
                    seats[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if n in (1, 5) else pa.int64()) for n, c in enumerate(zip(*rows, strict=True))],
                names=[c.split()[0] for c in _CUT.split(", ")],
            )

    return run


def _seated(slots: np.ndarray, window: int):
    """Slot of every (length, rank): the last range of the plan that starts at or before it."""
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    slots = slots[order]
    first_of = np.searchsorted(slots[:, 0], np.arange(window + 2))
    # Ranges of a length follow one another, so positions in (length, rank) order are running sums of pieces.
    starts = np.cumsum(slots[:, 5] - slots[:, 1]) - (slots[:, 5] - slots[:, 1])
    base = np.append(starts, 0)[first_of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = slots[np.searchsorted(starts, base[length] + rank, side="right") - 1]
            turn, seat = np.divmod(rank - slot[:, 1], slot[:, 3])
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            out = out.append_column("sequence_id", pa.array(slot[:, 2] + turn))
            yield out.append_column("offset", pa.array(slot[:, 4] + seat * length))

    return run


def pack_planned(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The histogram (``window`` rows at most) and the plan (see the module) are the only data that pass the driver.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    pieces = materialize(rows.mapInArrow(_cut(tokenizer_path, window, end), _CUT), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("seat"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_seated(plan(histogram, window), window), _PLACED)
