"""Planned packing: the plan against best fit on single pieces, pieces against the tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from skyraster.llm.histogram_packing import pack_planned, plan
from skyraster.llm.registry import tokenizer_path


def best_fit(counts, window):
    """Sequences of best fit by decreasing length, piece by piece."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [n for n, room in enumerate(rooms) if room >= length]
            if fits:
                rooms[min(fits, key=rooms.__getitem__)] -= length
            else:
                rooms.append(window - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 4, 16, 64, 257])
    counts = {n: rng.choice([1, 2, 3, 20, 90]) for n in rng.sample(range(1, window + 1), rng.randint(1, min(window, 20)))}
    slots, used = plan(counts, window).tolist(), defaultdict(list)
    for length, count in counts.items():
        at = 0
        for _, rank, first, each, offset, end in sorted(r for r in slots if r[0] == length):
            assert rank == at
            for turn in range(rank, end):
                used[first + (turn - rank) // each].append((offset + (turn - rank) % each * length, length))
            at = end
        assert at == count
    for own in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= window
    assert len(used) == best_fit(counts, window)


def test_plan_does_not_grow():
    small, large = ({n: many // n + 1 for n in range(1, 513)} for many in (10**4, 10**12))
    assert len(plan(large, 512)) <= 4 * 512 and len(plan(small, 512)) <= 4 * 512
    assert plan({}, 8).shape == (0, 6)


def check(docs, window):
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces, places, tokens = defaultdict(list), defaultdict(list), 0
    for r in pack_planned(docs, tokenizer_path(), window).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    wanted = defaultdict(list)
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        tokens += len(ids)
        for n, at in enumerate(range(0, len(ids), window)):
            own = ids[at : at + window]
            wanted[doc_id].append((n, at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return len(places), -(-tokens // window)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 700), (5, " \t\n")]
    rows += [(n, "same length here") for n in range(10, 400)]
    docs = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id long, text string, seat int, rank int, part string")
    for window in (64, 4096):
        used, least = check(docs.repartition(5), window)
        assert used <= least + 1
    assert pack_planned(docs.limit(0), tokenizer_path()).count() == 0


def test_given_table(spark):
    used, least = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 4096)
    assert used <= least * 1.01
