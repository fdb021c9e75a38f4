"""Verdicts, scores and shards against plain versions on a whole table."""

import math
import zlib
from collections import defaultdict

import pandas as pd

from skyraster.llm import quality, sharding, toxicity

FOLDER = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_quality_verdicts(spark):
    """The conditional expression against the rules applied one by one."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rules = quality.fit(docs, labels)
    assert rules
    got = {r.doc_id: (r.kept, r.rule, r.base_failed) for r in quality.judge(docs, rules).collect()}
    for r in docs.select("doc_id", "text").collect():
        s = dict(zip(quality.NAMES, quality.text_stats(r.text), strict=True))
        per = lambda a, b: s[a] / max(s[b], 1)  # noqa: B023, E731
        row = pd.DataFrame([{
            "n_words": float(s["n_words"]), "symbols_per_char": per("n_symbols", "word_chars"), "chars_per_word": per("word_chars", "n_words"),
            "dup_lines": per("n_dup_lines", "n_lines"), "repeat_words": per("n_repeat_words", "n_words"), "distinct_words": per("n_distinct", "n_words"),
            "upper_share": per("n_upper", "n_letters"), "digits_per_char": per("n_digits", "word_chars"), "marks_per_word": per("n_marks", "n_words"),
            "words_per_line": per("n_words", "n_lines"), "long_words": per("n_long", "n_words"),
        }])
        first = next((n for n, rule in enumerate(rules, 1) if quality._covered(rule, row)[0]), None)
        base = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        assert got[r.doc_id] == (first is None and not base, first, base)


def test_toxicity_scores(spark):
    """Scores by all pairs of terms, written out."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    machine = toxicity.fit(docs, labels, ~toxicity.held_out())
    place = {int(b): n for n, b in enumerate(machine.buckets)}
    scored = docs.select("doc_id", "text", toxicity.score_column(machine).alias("score")).filter("doc_id % 7 = 0")
    for r in scored.collect():
        words = set(toxicity.TERM.findall((r.text or "").lower()))
        active = sorted({place[b] for w in words for b in toxicity._term_buckets(w) if b in place})
        raw = machine.bias + sum(machine.weights[i] for i in active)
        raw += sum(float(machine.factors[i] @ machine.factors[j]) for k, i in enumerate(active) for j in active[k + 1 :])
        assert abs(r.score - 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))) < 1e-6
    held = {r.doc_id: r.held_out for r in toxicity.toxicity_digest(docs, labels).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in held}


def test_shards_of_a_table(spark):
    """Sizes, checksums and slots by hand; sizes of shards near equal."""
    docs = table(spark, "documents")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    shards, slots = defaultdict(int), defaultdict(list)
    for r in sharding.shard_digest(docs).collect():
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "bytes")
        shards[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(shards) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(shards.values()) / 40
    assert max(abs(s - mean) for s in shards.values()) <= max(len(t) + 16 for t in texts.values())
