"""Secret scan: three base patterns, and windows of high Shannon entropy.

Everything is a Spark expression on the text column.  Base kinds take leftmost, non-overlapping
matches; matches that are too short are dropped afterwards.  The entropy kinds look at every run of
one character class that is at least a window long: a window slides over the run, the counts of its
characters change by the one that enters and the one that leaves, and so does the sum of
``n log2 n`` that gives the entropy.  Windows at or above the threshold are merged into spans.  Windows
that overlap a match of the allow-list (leftmost, non-overlapping matches) are suppressed; a pattern from
^ to $ matches whole runs only.

Positions are code points, the end is exclusive.  A null text counts as empty; an empty text, a
table without rows, repeated rows and other columns of any name change nothing else: each row gets
its own result.  A text is searched whole, so the longest one bounds the memory of its task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Base:
    """Pattern whose ``group`` needs at least ``least`` code points."""

    name: str
    pattern: str
    group: int
    least: int


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``letters`` (a regex class); windows of ``window`` characters with ``bits`` or more."""

    name: str
    letters: str
    alphabet: str
    window: int
    bits: float


#: A maximal run of 32 or more equals a match of ``[0-9a-f]+`` that is long enough; likewise for keys,
#: whose match always reaches the end of its run.
BASES = (
    Base("assign", ASSIGN, 2, 8),
    Base("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Base("hex", r"[0-9a-f]{32,}", 0, 32),
)
HEX = "0123456789abcdef"
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
CLASSES = (
    EntropyClass("entropy_hex", "[0-9A-Fa-f]", HEX, 20, 3.0),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_=-]", ALNUM + "+/_=-", 24, 4.0),
)
#: Plain words and numbers, identifiers that are no secrets, and placeholders.
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|redacted|dummy",
    r"(?:0{8,}|1{8,}|9{8,}|a{8,}|f{8,}|x{8,}|X{8,}|={8,}|-{8,}|_{8,})",
)


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, value>> of the matches whose group is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # The pieces between matches are one more than the matches; the last has no match after it.
    step = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), whole, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match"))),
        part,
        lambda x, p: F.struct(
            (F.length(x["gap"]) + F.length(x["match"])).alias("step"),
            F.length(x["match"]).alias("size"),
            F.length(p).alias("part"),
            x["match"].alias("value"),
        ),
    )

    def located(steps: Column) -> Column:
        before = running_sums(F.transform(steps, lambda x: x["step"]))
        return F.zip_with(
            steps,
            before,
            lambda x, at: F.struct(
                (at + x["step"] - x["size"]).alias("start"),
                (at + x["step"]).alias("end"),
                x["part"].alias("part"),
                x["value"].alias("value"),
            ),
        )

    found = let(F.filter(step, lambda x: x["size"].isNotNull()), located)
    found = F.filter(found, lambda x: x["part"] >= least)
    found = F.transform(found, lambda x: F.struct(x["start"], x["end"], x["value"]))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def _entropy_spans(value: Column, kind: EntropyClass) -> Column:
    """array<struct<start, end>> inside ``value``: merged windows of high entropy."""
    width = kind.window
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 1)])
    alphabet = F.lit(kind.alphabet)
    folded = F.lower(value) if kind.alphabet == HEX else value
    codes = F.transform(F.split(folded, ""), lambda c: F.instr(alphabet, c))
    span = "struct<start:int,end:int>"

    def slide(code: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(kind.alphabet) + 1).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.lit(0).alias("first"),
            F.lit(0).alias("last"),
            F.array().cast(f"array<{span}>").alias("spans"),
        )

        def step(state: Column, i: Column) -> Column:
            enter = F.get(code, i)
            leave = F.when(i >= width, F.get(code, F.greatest(i - width, F.lit(0)))).otherwise(-1)
            left = F.when(i >= width, F.get(state["counts"], leave)).otherwise(0)
            rest = state["sum"] - F.get(weight, left) + F.get(weight, F.greatest(left - 1, F.lit(0)))
            here = F.get(state["counts"], enter) - F.when(leave == enter, 1).otherwise(0)
            total = rest - F.get(weight, here) + F.get(weight, here + 1)
            counts = F.transform(
                state["counts"],
                lambda n, k: n + F.when(k == enter, 1).otherwise(0) - F.when(k == leave, 1).otherwise(0),
            )
            hit = (i >= width - 1) & (F.lit(math.log2(width)) - total / width >= kind.bits - 1e-9)
            apart = hit & (i - width + 1 > state["last"])
            closed = F.array(F.struct(state["first"].alias("start"), state["last"].alias("end")))
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                F.when(apart | (hit & (state["last"] == 0)), i - width + 1).otherwise(state["first"]).alias("first"),
                F.when(hit, i + 1).otherwise(state["last"]).alias("last"),
                F.when(apart & (state["last"] > 0), F.concat(state["spans"], closed))
                .otherwise(state["spans"])
                .alias("spans"),
            )

        def finish(state: Column) -> Column:
            last = F.array(F.struct(state["first"].alias("start"), state["last"].alias("end")))
            return F.when(state["last"] > 0, F.concat(state["spans"], last)).otherwise(state["spans"])

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step, finish)

    return let(codes, slide)


def _between(run: Column, pattern: str, least: int) -> Column:
    """The pieces of a run outside the matches of ``pattern`` that have at least ``least`` code points."""

    def pieces(hits: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(hits, lambda h: h["end"]))
        ends = F.concat(F.transform(hits, lambda h: h["start"]), F.array(F.length(run["value"])))
        found = F.zip_with(
            starts,
            ends,
            lambda a, b: F.struct(
                (run["start"] + a).alias("start"), (run["start"] + b).alias("end"), F.substring(run["value"], a + 1, b - a).alias("value")
            ),
        )
        return F.filter(found, lambda p: p["end"] - p["start"] >= least)

    return F.when(run["value"].rlike(pattern), let(_matches(run["value"], pattern, 0, 1), pieces)).otherwise(F.array(run))


def _entropy_kind(text: Column, kind: EntropyClass, allowed: tuple[str, ...]) -> Column:
    runs = _matches(text, f"{kind.letters}{{{kind.window},}}", 0, kind.window)
    if allowed:
        benign = "|".join(f"(?:{pattern})" for pattern in allowed)
        runs = F.flatten(F.transform(runs, lambda x: _between(x, benign, kind.window)))
    return F.flatten(
        F.transform(
            runs,
            lambda x: F.transform(
                _entropy_spans(x["value"], kind),
                lambda s: F.struct((x["start"] + s["start"]).alias("start"), (x["start"] + s["end"]).alias("end")),
            ),
        )
    )


def _labelled(found: Column, rank: int, kind: str) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    bases: tuple[Base, ...] = BASES,
    classes: tuple[EntropyClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
    into: str = "secrets",
) -> DataFrame:
    """Add ``into``: array<struct<start, rank, end, kind>>, sorted by start and then by kind as listed.

    Base spans are never suppressed.  A column of the same name is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = [(b.name, _matches(body, b.pattern, b.group, b.least)) for b in bases]
    kinds += [(c.name, _entropy_kind(body, c, allowed)) for c in classes]
    spans = [_labelled(found, rank, name) for rank, (name, found) in enumerate(kinds)]
    return docs.withColumn(into, F.array_sort(F.concat(*spans)))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every union of overlapping spans replaced by ``mask``; null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, x: Column) -> Column:
        fresh = F.array(F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit(mask))
        # Spans that touch the union so far only extend it.
        parts = F.when((x["start"] > state["at"]) | (F.size(state["parts"]) == 0), F.concat(state["parts"], fresh))
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"), parts.otherwise(state["parts"]).alias("parts")
        )

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)


def _count_of(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")


def secret_digest(docs: DataFrame, bases: tuple[Base, ...] = BASES) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    found = find_secrets(docs.select("doc_id", "text"), bases=bases).select("doc_id", "secrets")
    counts = [_count_of(b.name).alias(f"n_{b.name}") for b in bases]
    base = F.filter("secrets", lambda x: x["rank"] < len(bases))
    return found.select(
        "doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans")
    )
