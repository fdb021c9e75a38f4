"""Frequent phrases and their collocation scores, by direct-address tiling of pairs of ids.

A task turns its texts into blocks: the words of about ``block_words`` words (all languages of a task together) of one language, numbered as they
come, with a break wherever a phrase must not go on.  The frequent words of a language are ranked by frequency, and
blocks are rewritten in these ranks.  Then each round counts neighbouring pairs of ids in a block: the square of
possible pairs is cut into tiles of 256 x 256 ranks; a tile with many pairs, as those of frequent words are, is
counted in a dense table (``bincount`` at the pair's address), all others together as sorted coordinates.  Frequent
pairs get ids by frequency again and take the place of the first of their two ids.  As a phrase of m + 1 words is
a pair of overlapping phrases of m words, the same round makes phrases of three and four words; what is not
frequent cannot be part of a longer frequent phrase, so blocks shrink from round to round.

What goes through the shuffle is a block's distinct pairs with their counts, packed by place.  A place holds some
tiles, or a lattice of every 2nd, 4th, ... row and column of a tile as there are more blocks, so that no place grows with
the most frequent pair.  The number of places grows with the words of the language.  Where a place is summed, the
ids of its frequent pairs (rank in the place x places + place: dense, and in the order of frequency but for a place's
share) go back to the blocks that hold them.  No dictionary of words or pairs is broadcast or collected.

A null text counts as empty, a null language as ``und``; repeated rows count each.  Other columns, doc_id too, are
ignored.  Texts are cut into pieces as they come: a phrase is never longer than its piece, and a very long text only
makes a larger block.  An empty table gives no phrases.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinals import running_offset
from ..session import materialize, materialize_counted
from .common import by_size

MAX_WORDS = 4
TILE_BITS = 8
#: A tile with at least so many pairs is counted in a dense table.
DENSE = 1 << (2 * TILE_BITS - 4)
_SIDE = (1 << TILE_BITS) - 1
#: Breaks between pieces, as a byte that no UTF-8 text has.
_BREAK = b"\xff"
#: Lower case of A-Z, and a break for every separator.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256)
)
_BLOCK = "block long, lang string, words array<string>, counts array<long>, codes binary"
_SYMBOLS = "block long, lang string, places int, lattice int, codes binary"
_PART = "lang string, place int, places int, block long, a binary, b binary, n binary"
_SUMMED = (
    "block long, a binary, b binary, ids binary, "
    "lang string, found array<struct<left: int, right: int, id: int, f: long>>"
)


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, of which the upper ones compress to little."""
    return np.ascontiguousarray(values, dtype="<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _plain(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, types = zip(*(c.split(" ", 1) for c in schema.split(", ")), strict=True)
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
        "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()),
    }
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names)
    )


def _numbered(block_words: int):
    """Blocks of numbered words; number 0 is a break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[defaultdict, list]] = {}
        total, block = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block
            for lang, (known, parts) in held.items():
                codes = np.concatenate(parts)
                counts = np.bincount(codes, minlength=len(known))
                yield _record(_BLOCK, [(block, lang, [w.decode() for w in list(known)[1:]], counts[1:], _packed(codes))])
                block += 1
            held.clear()

        for batch in by_size(batches, "text"):
            block = batch.column("part")[0].as_py() << 32 if block is None else block
            texts = batch.column("text").cast(pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                words = (text.as_py() or b"").translate(_BYTES).replace(_BREAK, b" \xff ").split()
                if lang not in held:
                    known: defaultdict[bytes, int] = defaultdict()
                    known.default_factory = known.__len__
                    held[lang] = known, []
                    known[_BREAK]  # noqa: B018
                known, parts = held[lang]
                words.append(_BREAK)
                parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
                total += len(words)
                if total >= block_words:
                    yield from flush()
                    total = 0
        yield from flush()

    return run


def _stretches(ids: np.ndarray) -> np.ndarray:
    """Only ids with an id beside them, one -1 between stretches."""
    ok = np.concatenate([[False], ids >= 0, [False]])
    keep = ok[1:-1] & (ok[:-2] | ok[2:])
    ids = np.where(keep, ids, -1)
    return ids[keep | np.concatenate([[False], keep[:-1]])]


def _ranked_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in ranks instead of the words' own numbers."""
    for batch in batches:
        for row in range(batch.num_rows):
            codes = _plain(batch.column("codes")[row].as_py())
            at, ids = (batch.column(c)[row].values.to_numpy() for c in ("at", "ids"))
            ranks = np.full(max(int(codes.max(initial=0)), int(at.max(initial=0))) + 1, -1, dtype=np.int32)
            ranks[at] = ids
            left = _stretches(ranks[codes])
            if len(left):
                head = [batch.column(c)[row].as_py() for c in ("block", "lang", "places", "lattice")]
                yield _record(_SYMBOLS, [(*head, _packed(left))])


def pair_counts(left: np.ndarray, right: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (left, right) with their number or sum of weights."""
    left, right = left.astype(np.int64), right.astype(np.int64)
    tile = (left >> TILE_BITS) << 32 | right >> TILE_BITS
    order = np.argsort(tile, kind="stable")
    left, right, tile = left[order], right[order], tile[order]
    weight = None if weight is None else weight[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, int)
    ends = np.append(starts[1:], len(tile)) if len(starts) else starts
    sparse, out = np.ones(len(tile), dtype=bool), []
    for at, end in zip(starts, ends, strict=True):
        if end - at < DENSE:
            continue
        sparse[at:end] = False
        address = (left[at:end] & _SIDE) << TILE_BITS | right[at:end] & _SIDE
        # Sums in doubles are exact here: they stay below 2^53.
        table = np.bincount(address, None if weight is None else weight[at:end]).astype(np.int64)
        cell = np.flatnonzero(table)
        out.append((left[at] & ~_SIDE | cell >> TILE_BITS, right[at] & ~_SIDE | cell & _SIDE, table[cell]))
    code = left[sparse] << 32 | right[sparse]
    if len(code):
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sums = np.diff(np.append(first, len(code))) if weight is None else np.add.reduceat(weight[sparse][order], first)
        out.append((code[first] >> 32, code[first] & 0xFFFFFFFF, sums))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def place_of(left: np.ndarray, right: np.ndarray, places: int, lattice: int) -> np.ndarray:
    """Place of each pair: its tile and its row and column modulo ``lattice`` (a power of two), hashed."""
    low = np.uint64(lattice - 1)
    left, right = left.astype(np.uint64), right.astype(np.uint64)
    mixed = (left >> np.uint64(TILE_BITS)) * np.uint64(0x9E3779B97F4A7C15) ^ (right >> np.uint64(TILE_BITS)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += ((left & low) * np.uint64(257) + (right & low)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(places)).astype(np.int32)


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            block, lang, places, lattice, codes = (batch.column(c)[row].as_py() for c in ("block", "lang", "places", "lattice", "codes"))
            ids = _plain(codes)
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            a, b, n = pair_counts(ids[:-1][both], ids[1:][both])
            if not len(a):
                continue
            place = place_of(a, b, places, lattice)
            order = np.argsort(place, kind="stable")
            a, b, n, place = a[order], b[order], n[order], place[order]
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            yield _record(
                _PART,
                [
                    (lang, int(place[s]), places, block, _packed(a[s:e]), _packed(b[s:e]), _packed(n[s:e]))
                    for s, e in zip(starts, np.append(starts[1:], len(a)), strict=True)
                ],
            )


def _summed(least: int):
    """Sums of each place: its frequent pairs with new ids, and what each block needs of them."""
    fields = pa.struct([("left", pa.int32()), ("right", pa.int32()), ("id", pa.int32()), ("f", pa.int64())])

    def finish(lang: str, place: int, places: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [(block, _plain(a), _plain(b)) for block, a, b, _ in rows]
        sums = pair_counts(
            np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([_plain(r[3]) for r in rows])
        )
        a, b, f = (c[sums[2] >= least] for c in sums)
        if not len(a):
            return
        order = np.lexsort((b, a, -f))
        a, b, f = a[order], b[order], f[order]
        ids = np.arange(len(a), dtype=np.int64) * places + place
        if ids[-1] >= 1 << 31:
            raise OverflowError(f"more than {1 << 31} frequent phrases of one length in {lang}")
        codes = a << 32 | b
        order = np.argsort(codes)
        codes, ranked = codes[order], ids[order]
        out = []
        for block, x, y in parts:
            own = x.astype(np.int64) << 32 | y
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            hit = codes[at] == own
            if hit.any():
                out.append((block, _packed(x[hit]), _packed(y[hit]), _packed(ranked[at[hit]])))
        names = [c.split(" ")[0] for c in ("block", "a", "b", "ids", "lang", "found")]
        found = [pa.array(c, t) for c, t in zip((a, b, ids, f), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.StructArray.from_arrays(found, fields=list(fields)))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.binary())] * 3, pa.array([lang]), lists], names=names
        )
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(out), pa.string()), pa.nulls(len(out), pa.list_(fields))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                own = r["lang"], r["place"], r["places"]
                if own != key:
                    if rows:
                        yield from finish(*key, rows)
                    key, rows = own, []
                rows.append((r["block"], r["a"], r["b"], r["n"]))
        if rows:
            yield from finish(*key, rows)

    return run


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the ids of their frequent pairs; the rows with a block's pairs come before the block."""
    block, pairs = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["block"] != block:
                block, pairs = r["block"], []
            if r["codes"] is None:
                pairs.append((_plain(r["a"]), _plain(r["b"]), _plain(r["ids"])))
                continue
            if not pairs:
                continue
            a, b, ids = (np.concatenate(c) for c in zip(*pairs, strict=True))
            codes = a.astype(np.int64) << 32 | b
            order = np.argsort(codes)
            codes, ids = codes[order], ids[order]
            own = _plain(r["codes"]).astype(np.int64)
            own = np.where((own[:-1] >= 0) & (own[1:] >= 0), own[:-1] << 32 | own[1:], -1)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            left = _stretches(np.where(codes[at] == own, ids[at], -1))
            if len(left):
                yield _record(_SYMBOLS, [(block, r["lang"], r["places"], r["lattice"], _packed(left))])


def _grown(blocks: DataFrame, least: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Frequent pairs (lang, id, left, right, f) of the blocks' ids, and the blocks in their ids."""
    parts = blocks.mapInArrow(_pairs_of_blocks, _PART)
    placed = parts.repartition("lang", "place").sortWithinPartitions("lang", "place", "block")
    sums = materialize(placed.mapInArrow(_summed(least), _SUMMED), "pairs")
    found = sums.filter(F.col("found").isNotNull()).select("lang", F.explode("found").alias("p")).select("lang", "p.*")
    if last:
        return found, None
    hits = sums.filter(F.col("block").isNotNull()).select("block", "a", "b", "ids", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("places", "int"), ("lattice", "int"), ("codes", "binary"))])
    both = hits.unionByName(blocks.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("a", "b", "ids")]))
    both = both.repartition("block").sortWithinPartitions("block", F.col("codes").isNotNull())
    return found, materialize(both.mapInArrow(_replaced, _SYMBOLS), "blocks")


def _score(a: Column, left: Column, right: Column, cut: int) -> Column:
    whole = [c.cast("decimal(19,0)") for c in (a, left, right)]
    score = F.call_function("div", whole[0] * F.lit(2_000_000).cast("decimal(7,0)"), whole[1] + whole[2])
    return F.struct(score.alias("score"), F.lit(cut).alias("cut"), left.alias("l"), right.alias("r"))


def _described(found: DataFrame, shorter: DataFrame, words: int) -> DataFrame:
    """Texts and part counts of phrases, from those of the phrases that are one word shorter."""
    one = lambda side: shorter.select("lang", F.col("id").alias(side), F.struct("phrase", "last", "f", "head", "tail", "first_f", "last_f").alias(f"_{side}"))
    rows = found.join(one("left"), ["lang", "left"]).join(one("right"), ["lang", "right"])
    x, y = F.col("_left"), F.col("_right")
    first, last = x["first_f"], y["last_f"]
    cuts = {
        2: [(first, last)],
        3: [(first, y["f"]), (x["f"], last)],
        4: [(first, y["f"]), (x["head"], y["tail"]), (x["f"], last)],
    }[words]
    best = F.array_min(F.array(*[_score(F.col("f"), le, ri, n) for n, (le, ri) in enumerate(cuts, 1)]))
    # head and tail: counts of the first and of the last two words.
    head, tail = (F.col("f"), F.col("f")) if words == 2 else (x["head"], y["tail"])
    return rows.select(
        "lang", "id", "left", "right", "f", F.concat_ws(" ", x["phrase"], y["last"]).alias("phrase"), y["last"].alias("last"),
        head.alias("head"), tail.alias("tail"), first.alias("first_f"), last.alias("last_f"), best.alias("best"),
    )


def phrases(docs: DataFrame, least: int = 30, absorbed: int = 80, block_words: int = 1_000_000, place_pairs: int = 1_000_000) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 to 4 words that occur ``least`` times or more.

    A phrase is left out where a longer one that holds it has ``absorbed`` per cent of its occurrences or more.
    """
    rows = docs.select(
        F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.spark_partition_id().alias("part")
    )
    blocks, seen = materialize_counted(rows.mapInArrow(_numbered(block_words), _BLOCK), "words")
    counted = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word"))
    counted = materialize(counted.agg(F.sum("w.counts").alias("f")), "word-counts")
    totals = materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    often = counted.filter(F.col("f") >= least).withColumns({"_down": -F.col("f"), "_salt": F.pmod(F.xxhash64("word"), F.lit(16))})
    often = running_offset(often, ["lang"], ["_down", "_salt"], ["word"], name="id")
    often = materialize(often.select("lang", "word", "f", F.col("id").cast("int").alias("id")), "often")
    lattice = 1
    while lattice < 1 << TILE_BITS and lattice * lattice * 64 < seen["rows"]:
        lattice *= 2
    ranks = blocks.select("block", "lang", F.posexplode("words").alias("at", "word")).join(often, ["lang", "word"])
    ranks = ranks.groupBy("block").agg(F.collect_list(F.struct((F.col("at") + 1).alias("at"), "id")).alias("w"))
    ranks = ranks.select("block", F.col("w.at").alias("at"), F.col("w.id").alias("ids"))
    places = totals.select("lang", F.ceil(F.col("n") / place_pairs).cast("int").alias("places"))
    told = blocks.select("block", "lang", "codes").join(places, "lang").join(ranks, "block").withColumn("lattice", F.lit(lattice))
    current = materialize(told.mapInArrow(_ranked_words, _SYMBOLS), "blocks")
    one = F.col("f")
    shorter = often.select(
        "lang", "id", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), one.alias("head"), one.alias("tail"), one.alias("first_f"), one.alias("last_f")
    )
    levels = []
    for words in range(2, MAX_WORDS + 1):
        found, current = _grown(current, least, words == MAX_WORDS)
        shorter = materialize(_described(found, shorter, words), "phrases")
        levels.append(shorter)
    kept = []
    for own, longer in zip(levels, [*levels[1:], None], strict=True):
        # What lies in a longer phrase lies in one that is a single word longer and at least as frequent.
        if longer is not None:
            over = longer.select("lang", F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("over"))
            over = over.groupBy("lang", "id").agg(F.max("over").alias("over"))
            own = own.join(over, ["lang", "id"], "left").filter(~F.coalesce(F.col("over") * 100 >= F.col("f") * absorbed, F.lit(False)))
        kept.append(own.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", F.col("best.score").alias("score")))
    return kept[0].unionByName(kept[1]).unionByName(kept[2]).join(totals, "lang")


def best_phrases(found: DataFrame, most: int = 2000, slices: int = 64) -> DataFrame:
    """The first ``most`` phrases of every language by score, count and bytes, with their rank."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))
    few = found.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(slices))).withColumn("_rank", part).filter(F.col("_rank") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
