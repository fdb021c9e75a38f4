"""Phrases against plain counting of all word sequences."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyraster.llm import phrases


def plain(rows, least, most=2000, absorbed=80):
    counts, words_of = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            words_of[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(zip(*(words[k:] for k in range(size)), strict=False))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        over = Counter()
        for p, a in often.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    over[p[k : k + size]] = max(over[p[k : k + size]], a)
        own = []
        for p, a in often.items():
            if 100 * over[p] >= absorbed * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(own)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words_of[lang], -score))
    return sorted(out)


def told(spark, rows, least, **how):
    frame = spark.createDataFrame([(n, t, la, 0, "x") for n, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, f int, block string")
    most = how.pop("most", 2000)
    found = phrases.best_phrases(phrases.phrases(frame.repartition(3), least, **how), most)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("how", [{}, {"block_words": 300, "place_pairs": 50}, {"most": 7}])
def test_small(spark, how):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{n}" for n in range(60)] + ["É", "ÄB", "Über x", "日本"]
    rows = []
    for n in range(300):
        words = [vocabulary[min(int(k), 63)] for k in rng.exponential(9, 60)]
        for k in rng.integers(0, 55, 3):
            words[k : k + 4] = ["Very", "common", "set", "phrase"]
        rows.append((["en", "fr", None, "und"][n % 4], "".join(w + [" ", "\t", ". ", "\n", "  "][min(int(rng.integers(0, 12)), 4) if rng.random() < 0.4 else 0] for w in words)))
    rows += [("en", None), (None, ""), ("de", "one two"), ("en", " ,;. "), ("en", "a " * 500), ("fr", "\x1cq  q \x1cq  q " * 20)]
    assert told(spark, rows, 12, **how) == plain(rows, 12, how.get("most", 2000))


def test_nothing(spark):
    assert told(spark, [("en", "a b")], 2) == []
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.best_phrases(phrases.phrases(docs)).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_tables(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(map(tuple, phrases.best_phrases(phrases.phrases(docs)).collect())) == plain(rows, 30)


def test_pair_counts():
    """Dense tiles, sparse pairs and sums of weights alike."""
    rng = np.random.default_rng(2)
    left = np.concatenate([rng.integers(0, 40, 9000), rng.integers(0, 100_000, 3000)])
    right = np.concatenate([rng.integers(250, 300, 9000), rng.integers(0, 1 << 30, 3000)])
    weight = rng.integers(1, 1 << 40, len(left))
    for w in (None, weight):
        want = defaultdict(int)
        for a, b, n in zip(left.tolist(), right.tolist(), weight.tolist()):
            want[a, b] += 1 if w is None else n
        a, b, n = phrases.pair_counts(left, right, w)
        assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want and len(a) == len(want)
