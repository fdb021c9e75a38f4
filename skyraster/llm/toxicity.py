"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their beginnings; they are hashed into buckets.  From
labelled rows the buckets that differ most between the two labels are chosen, and a factorization
machine (Rendle, "Factorization Machines", ICDM 2010) is fitted to their presence by AdaGrad: a weight
for each bucket and, for pairs, the product of two short vectors, so that a combination of terms can
count for more than their sum.

The labelled rows are a sample of ``bound`` at most, by hash, with the rest of the texts left alone;
scores depend on the text only.  A null or empty text has no terms and gets the score of the bias.
Without labels of both kinds every score is 0.  Repeated rows are scored each; a repeated label counts once.  Terms
of a whole text are hashed, however long it is, so the longest text bounds the memory of its task.  Columns other
than doc_id and text are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import labelled_sample

TERM = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20
STARTS = (4, 5, 6)


def _term_buckets(word: str) -> list[int]:
    terms = [f"w:{word}"] + [f"{n}:{word[:n]}" for n in STARTS if len(word) >= n]
    return [xxhash.xxh32_intdigest(t) % BUCKETS for t in terms]


def buckets_of(text: str | None) -> np.ndarray:
    found = {b for word in set(TERM.findall((text or "").lower())) for b in _term_buckets(word)}
    return np.array(sorted(found), dtype=np.int32)


@dataclass
class Machine:
    """score = sigmoid(bias + sum w + sum of v . v' over pairs) of the chosen buckets in a text."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, active: np.ndarray) -> float:
        v = self.factors[active]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()) if len(active) > 1 else 0.0
        return self.bias + float(self.weights[active].sum()) + pairs


def _informative(docs: list[np.ndarray], label: np.ndarray, terms: int, least_docs: int, least_z: float) -> np.ndarray:
    """Buckets whose share of texts differs most between the labels, by z-score."""
    pos = np.bincount(np.concatenate([d for d, y in zip(docs, label, strict=True) if y]), minlength=BUCKETS)
    neg = np.bincount(np.concatenate([d for d, y in zip(docs, label, strict=True) if not y]), minlength=BUCKETS)
    n1, n0 = int(label.sum()), int((~label).sum())
    share = (pos + neg + 1) / (n1 + n0 + 2)
    z = (pos / n1 - neg / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    z[pos + neg < least_docs] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:terms]
    return np.sort(best[np.abs(z[best]) >= least_z])


def fit_machine(
    docs: list[np.ndarray],
    label: np.ndarray,
    terms: int = 2048,
    rank: int = 4,
    epochs: int = 30,
    rate: float = 0.2,
    decay: float = 1e-4,
    batch: int = 128,
    least_docs: int = 3,
    least_z: float = 4.0,
    seed: int = 5,
) -> Machine | None:
    if not label.any() or label.all():
        return None
    chosen = _informative(docs, label, terms, least_docs, least_z)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    active = [p[p >= 0] for p in (place[d] for d in docs)]
    rng = np.random.default_rng(seed)
    bias = float(np.log((label.sum() + 1) / ((~label).sum() + 1)))
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), rank))
    gw, gv, gb = np.full(len(chosen), 1e-2), np.full((len(chosen), rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = np.array([len(active[i]) for i in pick])
            doc = np.repeat(np.arange(len(pick)), sizes)
            idx = np.concatenate([active[i] for i in pick]) if sizes.sum() else np.zeros(0, dtype=np.int32)
            total = np.zeros((len(pick), rank))
            np.add.at(total, doc, v[idx])
            square = np.bincount(doc, (v[idx] ** 2).sum(axis=1), minlength=len(pick))
            raw = bias + np.bincount(doc, w[idx], minlength=len(pick)) + 0.5 * ((total**2).sum(axis=1) - square)
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[pick]
            gain_w = np.bincount(idx, slope[doc], minlength=len(w)) / batch + decay * w
            gain_v = np.zeros_like(v)
            np.add.at(gain_v, idx, slope[doc][:, None] * (total[doc] - v[idx]))
            gain_v = gain_v / batch + decay * v
            gain_b = slope.sum() / batch
            gw += gain_w**2
            gv += gain_v**2
            gb += gain_b**2
            w -= rate * gain_w / np.sqrt(gw)
            v -= 0.25 * rate * gain_v / np.sqrt(gv)
            bias -= rate * gain_b / np.sqrt(gb)
    return Machine(chosen, bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, bound: int = 12_000, **options) -> Machine | None:
    """Machine for ``toxic`` from the labelled documents that ``where`` (over doc_id) admits."""
    sample = labelled_sample(labels, "toxic", bound, where)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    @F.pandas_udf("array<int>")
    def buckets(texts: pd.Series) -> pd.Series:
        return texts.map(buckets_of)

    # One text of a repeated doc_id: the sample stays within its bound.
    rows = rows.select("doc_id", "label", buckets("text").alias("buckets")).groupBy("doc_id").agg(
        F.max("label").alias("label"), F.max("buckets").alias("buckets")
    )
    table = rows.orderBy("doc_id").select("label", "buckets").toArrow()
    flat = table.column("buckets").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = [x.values.to_numpy(zero_copy_only=False) for x in flat]
    return fit_machine(lists, table.column("label").to_numpy() > 0, **options) if lists else None


def score_column(machine: Machine | None, text: str = "text") -> Column:
    """Score of the text from 0 to 1."""
    if machine is None:
        return F.lit(0.0)
    place = {int(b): n for n, b in enumerate(machine.buckets)}
    known: dict[str, tuple] = {}

    def terms(word: str) -> tuple:
        found = known.get(word)
        if found is None:
            found = tuple(place[b] for b in _term_buckets(word) if b in place)
            if len(known) < 300_000:
                known[word] = found
        return found

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = set(TERM.findall((text or "").lower()))
            active = np.array(sorted({n for word in words for n in terms(word)}), dtype=np.int64)
            out.append(1 / (1 + np.exp(-np.clip(machine.raw(active), -30, 30))))
        return pd.Series(out, dtype="float64")

    return score(F.col(text).cast("string"))


def held_out() -> Column:
    """One row in five by the checksum of its doc_id; a null doc_id is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    machine = fit(docs, labels, ~held_out())
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
