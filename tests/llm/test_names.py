"""Columns of the user keep their values, whatever they are called, and no name makes an operator fail."""

import pytest

from skyraster.llm import mixing, near, quality, secrets
from skyraster.llm.stages import STAGES

NAMES = [
    "_near", "_source", "_cdf", "_stats", "stats", "_fp", "fp", "_secrets", "secrets", "spans", "kept", "rule", "base_failed", "n_words",
    "copy", "n_copies", "mix_key", "_draw", "row", "id", "root", "own", "of", "draws", "cdf", "salt", "key", "a.b", "first",
]
PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from here today"


@pytest.fixture(scope="module")
def docs(spark):
    values = [f"concat('{n}', doc_id) as `{n}`" for n in NAMES]
    texts = [PLAIN, PLAIN + " again", "another text with quite other words in it than the first one has, by far and wide", PLAIN.upper()]
    frame = spark.createDataFrame([(i, t, "s", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    return frame.selectExpr("doc_id", "text", "source", "n_chars", *values)


def held(frame, names=NAMES):
    rows = frame.collect()
    assert rows
    for r in rows:
        for n in names:
            assert r[n] == f"{n}{r.doc_id}"


@pytest.mark.parametrize("name, stage", STAGES[:-1])
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    held(out)


def test_operators(docs):
    held(near.one_of_each(docs))
    made = ("copy", "n_copies", "mix_key")
    held(mixing.mix(docs, epochs=3.0), [n for n in NAMES if n not in made])
    held(quality.with_stats(docs), [n for n in NAMES if n not in quality.NAMES])
    held(secrets.find_secrets(docs), [n for n in NAMES if n != "secrets"])


def test_large_rates(spark):
    """A source of one short text fills half of the mixture, by draws of a bounded mean."""
    rows = [(0, "tiny", "small")] + [(n, "word " * 60, "large") for n in range(1, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixing.source_rates(docs).collect()}
    assert rates["small"] > 100 * mixing.DRAW_RATE
    counts = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert abs(counts[0] - rates["small"]) < 6 * rates["small"] ** 0.5


def test_inversion(spark):
    """Counts by hand: the smallest k with a cumulative probability at the draw or above it."""
    import hashlib
    from math import exp

    docs = spark.createDataFrame([(n, "x" * (n % 9), f"s{n % 3}") for n in range(200)], "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixing.source_rates(docs, {"s1": 5.0}).collect()}
    got = {r.doc_id: r.n_copies for r in mixing.mix(docs, {"s1": 5.0}).select("doc_id", "n_copies").distinct().collect()}
    for n in range(200):
        draw = (int(hashlib.md5(f"11:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rate = rates[f"s{n % 3}"]
        k, p = 0, exp(-rate)
        total = p
        while total < draw:
            k += 1
            p *= rate / k
            total += p
        assert got.get(n, 0) == k
