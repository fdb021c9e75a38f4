"""Quality rules: a learned decision list over statistics of the words of a text.

The statistics of each text are counted in one pass (array operations in a pandas UDF).  From
labelled rows, sequential covering learns an ordered list of rules for bad texts: a rule grows by the
threshold that gains most (FOIL gain), is pruned on rows kept apart, and the rows that it covers leave
before the next rule is learned.  The list is applied as one CASE WHEN expression over the statistics.

A null text has no words.  Labelled rows are sampled by hash, ``bound`` of them at most; a label
of null, of a document that is not there, or that repeats is ignored or counted once.  Without labels
the list is empty and only the fixed base rules reject.  Repeated rows are judged each, whole texts however long they
are; an empty table gives no rows.  Columns of the names that are added are replaced, others keep their values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, free_name

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_distinct long, n_upper long, n_letters long, n_digits long, n_marks long, n_long long"
)
NAMES = [part.split()[0] for part in STATS.split(", ")]
SPACES = [0x20, *range(0x09, 0x0E)]
SYMBOLS = list(b"#*$%&|<>")
MARKS = list(b"!?.,;:")
LONG_WORD = 16


def _repeated(words: list[str], ids: np.ndarray, distinct: int, width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if distinct <= 1 << (60 // width):
        keys = np.zeros(n, dtype=np.int64)
        for i in range(width):
            keys = (keys << (60 // width)) | ids[i : i + n]
    else:  # too many words to be put into one number: rank the windows step by step
        keys = ids[:n]
        for i in range(1, width):
            keys = np.unique(keys * distinct + ids[i : i + n], return_inverse=True)[1]
    order = np.sort(keys)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[place] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``STATS``."""
    text = text or ""
    words = WORD.findall(text)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    raw = np.frombuffer(text.encode(errors="surrogatepass"), dtype=np.uint8)
    count = np.bincount(raw, minlength=256)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    return (
        len(words),
        len(text) - int(count[SPACES].sum()),
        int(count[SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        _repeated(words, ids, len(number)),
        len(lines),
        len(number),
        upper,
        upper + lower,
        int(count[48:58].sum()),
        int(count[MARKS].sum()),
        sum(len(w) >= LONG_WORD for w in words),
    )


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics as columns; columns of these names are replaced."""

    @F.pandas_udf(STATS)
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=NAMES, dtype="int64")

    rest = [c for c in docs.columns if c.lower() not in NAMES]
    own = free_name(docs, "stats")
    rest = [f"`{c}`" for c in rest]
    return docs.select(*rest, stats(F.col(text).cast("string")).alias(own)).select(*rest, f"{own}.*")


def ratios() -> dict[str, Column]:
    """What the rules are written in."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbols_per_char": per("n_symbols", "word_chars"),
        "chars_per_word": per("word_chars", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"),
        "distinct_words": per("n_distinct", "n_words"),
        "upper_share": per("n_upper", "n_letters"),
        "digits_per_char": per("n_digits", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "long_words": per("n_long", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        values = table[self.feature].to_numpy()
        return values >= self.threshold if self.above else values < self.threshold

    def expression(self) -> Column:
        value = ratios()[self.feature]
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, table: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(table), dtype=bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def _best_condition(table: pd.DataFrame, bad: np.ndarray, steps: int) -> tuple[float, Condition | None]:
    """Largest FOIL gain over thresholds midway between neighbouring values, ``steps`` quantiles each."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    base = np.log2(p0 / (p0 + n0))
    best, chosen = 0.0, None
    for feature in table.columns:
        values = table[feature].to_numpy()
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        cuts = np.flatnonzero(ranked[1:] > ranked[:-1])
        if not len(cuts):
            continue
        # Wide gaps and places where the class changes come first, then even quantiles.
        change = cuts[bad[order][cuts] != bad[order][cuts + 1]]
        spread = change[np.unique(np.linspace(0, len(change) - 1, steps).astype(int))] if len(change) else cuts[:0]
        cuts = np.unique(np.concatenate([cuts[np.unique(np.linspace(0, len(cuts) - 1, steps).astype(int))], spread]))
        below = np.cumsum(bad[order])[cuts]
        size = cuts + 1
        for above, p, t in ((False, below, size), (True, p0 - below, p0 + n0 - size)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / t) - base)
            at = int(np.argmax(gain))
            if gain[at] > best + 1e-9:
                best = float(gain[at])
                chosen = Condition(feature, above, float((ranked[cuts[at]] + ranked[cuts[at] + 1]) / 2))
    return best, chosen


def learn_rules(
    table: pd.DataFrame,
    bad: np.ndarray,
    precision: float = 0.95,
    support: int = 5,
    most_rules: int = 16,
    most_conditions: int = 4,
    steps: int = 128,
    seed: int = 7,
) -> list[Rule]:
    """Sequential covering of the bad rows of ``table`` (one column per ratio).

    A rule is taken only if, over all rows not yet covered, ``precision`` of what it covers is bad,
    and ``support`` bad rows are covered.  The first rule that fails ends the list.
    """
    rng = np.random.default_rng(seed)
    left = np.arange(len(table))
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[left].sum() >= support:
        held = rng.random(len(left)) < 1 / 3
        grow, prune = left[~held], left[held]
        inside, rule = grow, ()
        while len(rule) < most_conditions and bad[inside].any() and not bad[inside].all():
            gain, condition = _best_condition(table.iloc[inside], bad[inside], steps)
            if condition is None:
                break
            rule += (condition,)
            inside = inside[condition.holds(table.iloc[inside])]
        if not rule:
            break

        def worth(candidate: Rule, rows: np.ndarray = prune) -> float:
            hit = _covered(candidate, table.iloc[rows])
            p, n = int(bad[rows][hit].sum()), int((~bad[rows])[hit].sum())
            return (p - n) / (p + n) if p + n else -1.0

        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (worth(r), -len(r)))
        hit = _covered(rule, table.iloc[left])
        p = int(bad[left][hit].sum())
        if p < support or p < precision * hit.sum():
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """Ordered conditional expression: number of the first rule that holds, from 1; null if none."""
    out = None
    for number, rule in enumerate(rules, 1):
        condition = F.lit(True)
        for part in rule:
            condition = condition & part.expression()
        out = F.when(condition, number) if out is None else out.when(condition, number)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_sample(labels: DataFrame, label: str, bound: int, where: Column | None = None) -> DataFrame:
    """(doc_id, label) of ``bound`` doc_ids at most, by hash; the largest label of a repeated one."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if where is None else rows.filter(where)
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("label"))
    return materialize(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "labelled-sample")


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000, **options) -> list[Rule]:
    """Rules from the labelled documents; ``quality`` 0 is bad.  The sample of ``bound`` rows of three
    numbers is all that is broadcast or comes to the driver."""
    sample = labelled_sample(labels, "quality", bound)
    rows = with_stats(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    columns = ratios()
    table = rows.groupBy("doc_id").agg(
        F.max("label").alias("label"), *[F.max(v).alias(k) for k, v in columns.items()]
    ).orderBy("doc_id").toPandas()
    if not len(table):
        return []
    return learn_rules(table[list(columns)], table["label"].to_numpy() == 0, **options)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Add the statistics, ``base_failed``, ``rule`` (the number of the rule that rejects) and ``kept``."""
    out = with_stats(docs.drop("base_failed", "rule", "kept"), text)
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", rule_number(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit(docs, labels)
    return judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
