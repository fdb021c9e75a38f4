"""Packing of documents into token windows: bounded-space online best-fit.

Each task keeps a fixed number of open windows.  A document's ids are cut into full windows; what is
left goes to the open window with the least room that holds it, else to a new window, and if none is
free the fullest window is topped up with the head of the rest and emitted.  The windows still open at
the end of a task are written with their ids and merged, some tasks' leftovers at a time, into full
windows; the last one of a merge is cut into powers of two, which need no padding.

Token ids are those of the whole text.  The tokenizer drops white space and no rule of it reaches
across a blank, so texts are encoded by blank-separated piece, with the pieces seen before kept in
bounded dictionaries.  Pieces of plain Latin-1 characters are split as the tokenizer splits them and
their parts go straight to its BPE model; all others go through the whole tokenizer.

A null text counts as empty and gives one piece with the end id only; repeated rows are packed once
each.  A text is encoded whole, so the longest one bounds the memory of its task; an empty table gives no pieces.
Other columns are ignored.  Window numbers come from the number of the input partition, so a
task that runs again gives the same windows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import by_size

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(name.split()[0], pa.int64()) for name in PIECES.split(", ")])
_LEFT = _SCHEMA.append(pa.field("ids", pa.binary()))

#: Characters that the tokenizer's normalizer leaves alone but for the case.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: Its split pattern, for lower-cased text of these characters.
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pieces: int = 400_000, parts: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces, self.max_pieces = {"": b""}, pieces
        self.parts, self.max_parts = {}, parts

    def _part(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            shown = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            known = np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
            if len(self.parts) < self.max_parts:
                self.parts[part] = known
        return known

    def _piece(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece) and "<|" not in piece:
            return b"".join(map(self._part, _PART.findall(piece.lower())))
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        known = self.pieces
        fresh = {w: self._piece(w) for w in set(words) if w not in known}
        if not fresh:
            return b"".join(map(known.__getitem__, words))
        if len(known) + len(fresh) <= self.max_pieces:
            known.update((w, ids) for w, ids in fresh.items() if len(w) <= 64)
        return b"".join([known[w] if w in known else fresh[w] for w in words])


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Packer:
    """Open windows of one task: lists of (doc_id, start, tokens of the document, ids)."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next_id = window, open_windows, first_id
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, tokens, ids in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, zlib.crc32(ids), tokens, self.next_id, offset))
            offset += length
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, at = len(ids) // 4, 0
        while tokens - at >= self.window:
            self.emit([(doc_id, at, tokens, ids[4 * at : 4 * (at + self.window)])])
            at += self.window
        while at < tokens:
            rest = tokens - at
            fits = [w for w in self.open if w[0] + rest <= self.window]
            if fits:
                best, length = max(fits, key=lambda w: w[0]), rest
            elif len(self.open) < self.most:
                best, length = [0, []], rest
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                length = self.window - best[0]
            best[1].append((doc_id, at, tokens, ids[4 * at : 4 * (at + length)]))
            best[0] += length
            at += length
            if best[0] == self.window:
                self.open.remove(best)
                self.emit(best[1])

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _pack_partition(path: str, window: int, open_windows: int, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, partition, encode = None, 0, encoder(path).encode
        for batch in by_size(batches, "text"):
            if packer is None:
                partition = batch.column("partition")[0].as_py()
                packer = _Packer(window, open_windows, partition << 32)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc_id, encode(text.as_py() or "") + end)
            yield _batch([(*row, None) for row in packer.taken()])
        if packer:  # the task's number stands in for the window's until the leftovers are merged
            yield _batch(
                [
                    (doc_id, start, len(ids) // 4, number, tokens, partition, place, ids)
                    for number, (_, pieces) in enumerate(sorted(packer.open, key=lambda w: -w[0]))
                    for place, (doc_id, start, tokens, ids) in enumerate(pieces)
                ]
            )

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _LEFT]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEFT, strict=True)], schema=_LEFT)


def _merge_leftovers(window: int, first_id: int):
    """Windows of some tasks, in order, cut into full windows and powers of two."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("ids_crc32", "ascending"), ("offset", "ascending")])
        rest = int(pc.sum(table.column("length")).as_py())
        sizes = [window] * (rest // window) + [1 << b for b in reversed(range(window.bit_length())) if (rest % window) >> b & 1]
        out = _Packer(window, 0, first_id + (key[0].as_py() << 32))
        sizes.reverse()
        room, pieces = sizes.pop(), []
        for row in table.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            ids, at = row["ids"], 0
            while at < len(ids):
                take = min(4 * room, len(ids) - at)
                pieces.append((row["doc_id"], row["start"] + at // 4, row["doc_tokens"], ids[at : at + take]))
                at, room = at + take, room - take // 4
                if not room:
                    out.emit(pieces)
                    room, pieces = sizes.pop() if sizes else 0, []
        columns = zip(*out.taken(), strict=True)
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 4096,
    open_windows: int = 16,
    end_id: int = 2,
    fan_in: int = 64,
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A merge of leftovers reads ``fan_in`` tasks' open windows, ``fan_in * open_windows * window`` ids
    at most.  ``window`` is a power of two.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("partition"))
    rows = rows.mapInArrow(_pack_partition(tokenizer_path, window, open_windows, end), PIECES + ", ids binary")
    rows = materialize(rows, "packed")
    done = rows.filter(F.col("ids").isNull()).drop("ids")
    left = rows.filter(F.col("ids").isNotNull())
    merged = left.groupBy(F.floor(F.col("sequence_id") / fan_in).alias("_merge")).applyInArrow(
        _merge_leftovers(window, 1 << 62), PIECES
    )
    return done.unionByName(merged)
