"""License scan: MinHash bands over overlapping text windows, verified by shingle containment.

Words are lower-cased runs of letters and digits.  Templates are sorted into classes by their number
of shingles: for a class h = 1, 2, 4, ... of up to 2 h + 1 shingles, windows hold 3 h shingle positions and
advance by h, so an occurrence of a template lies inside some window.  Each of ``bands`` hash functions
gives a window its least shingle hash; a band of one row meets a template's with probability J, the
Jaccard similarity.  A window that holds 4 in 5 of a template's shingles has J of 1/4 or more in every
class, so all bands miss it with probability (3/4)^bands at most, 1e-4 for 32.  A band cannot be met
without a shared shingle of five words, so every shingle is first looked up among those of all templates, and
only windows that hold one are hashed, by these shingles alone: what a band would have met it still meets.

Most texts hold no shingle of any template.  They are found many at a time, by sums over the bytes of a batch
(``span_hashes``), without making a string of any word; only the others are split into words.

Candidates are verified by their shingles as words, not hashes: the share of the template's distinct
shingles that lie in the window must be 0.8 or more.  A licence may have several templates.  Of every
(document, licence) all verified occurrences that do not overlap are reported, of overlapping ones that with the
most shared shingles, from the first to the last of them in code points.  Licences whose texts are alike, as
versions of one are, meet in the same words: there the one with the greater containment is reported.

A null, empty or short text matches nothing but a template of fewer than five words that it equals as a
whole sequence; repeated rows are reported each; rows of an empty table are none.  Only doc_id and text are read,
so other columns may have any names.  A text is scanned whole, so the longest one bounds the memory of its task.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import by_size

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
FOUND = "doc_id long, license string, containment double, window_start long, window_end long"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("window_start", pa.int64()), ("window_end", pa.int64())]
)

#: Notices by which works declare their license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "No part of this publication may be reproduced without the prior written permission of the publisher",
}


def _mix(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    pair = rng.integers(1, 1 << 63, (2, n, 1), dtype=np.uint64)
    return pair[0] | np.uint64(1), pair[1]


def _shingle_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Rolling combination of word hashes, one per run of five words (all words, if fewer)."""
    fresh = [w for w in set(words) if w not in known]
    found = {w: xxhash.xxh64_intdigest(w) for w in fresh}
    if len(known) < 400_000:
        known.update(found)
        found = known
    else:
        found = known | found if fresh else known
    h = np.fromiter(map(found.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return out ^ (out >> np.uint64(29))


def _shingles(words: list[str]) -> list[tuple[str, ...]]:
    width = min(SHINGLE, len(words))
    return list(zip(*(words[i:] for i in range(width)), strict=False)) if width else []


#: Letters and digits in lower case, 0 for all other bytes.
_LOWER = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0 for b in range(256)], dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of texts that are looked through together, about.  A text of more than ``SIFT_MOST`` is split into words at once.
SIFT_BYTES = 1 << 17
SIFT_MOST = 1 << 20
#: The one letter outside of ASCII whose lower case is in it.
_KELVIN = "\u212a".encode()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse."""
    both = np.empty((2, n), dtype=np.uint64)
    both[0], both[1] = _BASE, pow(_BASE, -1, 1 << 64)
    both[:, 0] = 1
    return tuple(np.multiply.accumulate(both, axis=1))


def span_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five ASCII words, and the place behind the first word of each.

    Bytes outside of ASCII end a word.  So a word that holds one is taken for others, but a run of words without any is
    found, whatever stands between them.
    """
    low = _LOWER[np.frombuffer(text + b" ", dtype=np.uint8)]
    word = low != 0
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    if len(ends) < SHINGLE:
        return np.zeros(0, dtype=np.uint64), ends[:0]
    word[ends] = True  # a separator of one byte behind each word
    kept = low[word]
    power, inverse = _powers(max(2 * SIFT_MOST, 1 << len(kept).bit_length()))
    sums = np.zeros(len(kept) + 1, dtype=np.uint64)
    np.cumsum((kept + np.uint8(1)) * power[: len(kept)], out=sums[1:])
    behind = np.flatnonzero(kept == 0) + 1
    first = np.append(0, behind[: -SHINGLE])
    return (sums[behind[SHINGLE - 1 :]] - sums[first]) * inverse[first], ends[: len(first)]


def _words(text: str) -> list[str]:
    """Lower-cased words; a letter whose lower case is two characters does not move the words behind it."""
    lower = text.lower()
    return WORD.findall(lower) if len(lower) == len(text) else [w.lower() for w in WORD.findall(text)]


def _listed(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, and a bit for the upper 20 bits of each."""
    every = np.unique(np.concatenate(hashes))
    bits = np.zeros(1 << 20, dtype=bool)
    bits[every >> np.uint64(44)] = True
    return every, bits


def _among(hashes: np.ndarray, every: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the hashes that are in ``every``."""
    at = np.flatnonzero(bits[hashes >> np.uint64(44)])
    if not len(at):
        return at
    near = np.minimum(np.searchsorted(every, hashes[at]), len(every) - 1)
    return at[every[near] == hashes[at]]


def _cuts(ends: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of texts that end at ``ends``, of ``most`` bytes each or of one text."""
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


@dataclass
class Index:
    """MinHash tables of the templates, by length class."""

    templates: Mapping[str, str | Sequence[str]]
    bands: int = 32
    containment: float = 0.8
    shingles: dict[tuple[str, int], Counter] = field(default_factory=dict)
    classes: dict[int, list] = field(default_factory=dict)
    half_of: dict[tuple[str, int], int] = field(default_factory=dict)

    def __post_init__(self):
        self.a, self.b = _mix(self.bands)
        known: dict[str, int] = {}
        members: dict[int, list] = {}
        every, spans = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
        self.short, self.ascii = False, True
        texts = [(name, [text] if isinstance(text, str) else text) for name, text in self.templates.items()]
        for name, text in [((name, n), text) for name, own in texts for n, text in enumerate(own)]:
            words = WORD.findall(text.lower())
            if not words:
                continue
            self.shingles[name] = Counter(_shingles(words))
            half = 1
            while 2 * half + 1 < len(words) - SHINGLE + 1:
                half *= 2
            self.half_of[name] = half
            every.append(_shingle_hashes(words, known))
            self.short |= len(words) < SHINGLE
            self.ascii &= all(w.isascii() for w in words)
            spans.append(span_hashes(" ".join(words).encode())[0])
            members.setdefault(half, []).append((name, (self.a * every[-1] + self.b).min(axis=1)))
        for half, own in members.items():
            names, least = [n for n, _ in own], np.stack([m for _, m in own], axis=1)
            order = np.argsort(least, axis=1, kind="stable")
            self.classes[half] = [names, least, np.take_along_axis(least, order, axis=1), order]
        #: All shingles of templates, and a bit for the upper 20 bits of each.
        self.every, self.bits = _listed(every)
        #: The same of :func:`span_hashes`.
        self.spans, self.span_bits = _listed(spans)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of shingles that some template has."""
        return _among(hashes, self.every, self.bits)

    def sift(self, texts: list[str]) -> np.ndarray:
        """Numbers of the texts that may match: no text that shares a shingle with a template is left out."""
        raw = [t.encode() for t in texts]
        chosen = np.array([len(t) > SIFT_MOST or _KELVIN in t or not (self.ascii or t.isascii()) for t in raw], dtype=bool)
        rest = np.flatnonzero(~chosen)
        ends = np.cumsum([len(raw[i]) + 1 for i in rest])
        for part in _cuts(ends, SIFT_BYTES):
            hashes, places = span_hashes(b"\n".join(raw[i] for i in rest[part]))
            behind = ends[part] - (ends[part.start - 1] if part.start else 0)
            found = np.searchsorted(behind, places[_among(hashes, self.spans, self.span_bits)], "right")
            chosen[rest[part][found]] = True
        if self.short:
            chosen |= [len(t) < 1 << 10 and len(WORD.findall(t)) < SHINGLE for t in texts]
        return np.flatnonzero(chosen)

    def candidates(self, hashes: np.ndarray) -> set[tuple[tuple[str, int], int, int]]:
        """(template, first, last shingle position) of windows that meet a template in a band.

        Only shingles of some template are hashed: a band is met by a shared shingle, so the others could only
        hide one.
        """
        found, at = set(), self.hits(hashes)
        if not len(at):
            return found
        values = self.a * hashes[at] + self.b
        none = np.full((self.bands, 1), np.iinfo(np.uint64).max, dtype=np.uint64)
        for half in sorted(self.classes):
            blocks, first = np.unique(at // half, return_index=True)
            least = np.concatenate([np.minimum.reduceat(values, first, axis=1), none], axis=1)
            windows = np.unique(np.concatenate([blocks, blocks - 1, blocks - 2]))
            windows = windows[windows >= 0]
            low = none
            for step in range(3):
                place = np.searchsorted(blocks, windows + step)
                held = np.append(blocks, -1)[place] == windows + step
                low = np.minimum(low, least[:, np.where(held, place, len(blocks))])
            for name, window in self._met(half, low):
                found.add((name, int(windows[window]) * half, (int(windows[window]) + 3) * half))
        return found

    def _met(self, size: int, low: np.ndarray) -> Iterator[tuple[tuple[str, int], int]]:
        """(template, window) of windows whose least hash equals a template's in some band."""
        names, plain, least, order = self.classes[size]
        if len(names) <= 8:  # few templates: compare with each
            for n, name in enumerate(names):
                for window in np.flatnonzero((low == plain[:, n, None]).any(axis=0)):
                    yield name, int(window)
            return
        for band in range(self.bands):
            place = np.minimum(np.searchsorted(least[band], low[band]), len(names) - 1)
            for window in np.flatnonzero(least[band][place] == low[band]):
                n = place[window]
                while n < len(names) and least[band][n] == low[band][window]:
                    yield names[order[band][n]], int(window)
                    n += 1

    def occurrences(self, name: tuple[str, int], places: list[int], grams: list[tuple[str, ...]]) -> Iterator[tuple[int, float, int, int]]:
        """(shared shingles, containment, first, last) of the template's verified occurrences, none inside another.

        ``places`` are the positions of its shingles.  An occurrence ends where a shingle comes once more than in the
        template after enough of them, or where the next one lies beyond a window.
        """
        wanted, reach = self.shingles[name], 3 * self.half_of[name]
        least = self.containment * len(wanted)
        own: deque[int] = deque()
        times: Counter = Counter()  # without zeros, so its length is the number of distinct shingles

        def shorter() -> None:
            gram = grams[own.popleft()]
            times[gram] -= 1
            if not times[gram]:
                del times[gram]

        def told() -> tuple[int, float, int, int]:
            while times[grams[own[0]]] > wanted[grams[own[0]]]:
                shorter()
            out = len(times), len(times) / len(wanted), own[0], own[-1]
            own.clear()
            times.clear()
            return out

        for at in places:
            if len(times) >= least and (times.get(grams[at], 0) >= wanted[grams[at]] or at - own[0] >= reach):
                yield told()
            while own and at - own[0] >= reach:
                shorter()
            own.append(at)
            times[grams[at]] += 1
        if len(times) >= least:
            yield told()

    def matches(self, text: str, known: dict[str, int]) -> list[tuple[str, float, int, int]]:
        words = _words(text)
        if not words:
            return []
        hits = self.candidates(_shingle_hashes(words, known))
        if not hits:
            return []
        grams = _shingles(words)
        spans = [m.span() for m in WORD.finditer(text)]
        windows: dict[tuple[str, int], set[int]] = {}
        for name, first, last in hits:
            wanted = self.shingles[name]
            windows.setdefault(name, set()).update(i for i in range(first, min(last, len(grams))) if grams[i] in wanted)
        found: dict[str, list[tuple]] = {}
        for name, places in windows.items():
            for count, share, first, last in self.occurrences(name, sorted(places), grams):
                end = spans[min(last + SHINGLE, len(spans)) - 1][1]
                found.setdefault(name[0], []).append((count, share, spans[first][0], end))
        every = [(name, *one[1:]) for name, own in found.items() for one in own]
        out = []
        for name, own in sorted(found.items()):
            taken: list[tuple] = []
            for _, *one in sorted(own, key=lambda one: (-one[0], -one[1], one[2], one[3])):
                apart = all(one[2] <= start or one[1] >= end for _, start, end in taken)
                if apart and not any(_outdoes(other, name, tuple(one)) for other in every):
                    taken.append(tuple(one))
            out += [(name, *one) for one in sorted(taken, key=lambda one: one[1:])]
        return out


def _outdoes(other: tuple, name: str, one: tuple) -> bool:
    """Whether ``other``, of another licence, has a greater containment and covers half of ``one`` or more."""
    rival, share, start, end = other
    common = min(end, one[2]) - max(start, one[1])
    return rival != name and share > one[0] and 2 * common >= one[2] - one[1]


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str | Sequence[str]] = TEMPLATES,
    bands: int = 32,
    containment: float = 0.8,
) -> DataFrame:
    """(doc_id, license, containment, window_start, window_end) of every occurrence of a license in a text.

    ``templates`` has a text or several texts of each license.
    """
    index = Index(templates, bands, containment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in by_size(batches, "text"):
            texts = [t.as_py() or "" for t in batch.column("text")]
            rows = [
                (batch.column("doc_id")[n].as_py(), *match)
                for n in index.sift(texts).tolist()
                for match in index.matches(texts[n], known)
            ]
            columns = zip(*rows, strict=True) if rows else [[] for _ in _SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
