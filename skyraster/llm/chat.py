"""Chat formatting of reply trees.

Messages form trees by (tree, node, parent).  Self-joins that double their reach at every round give
each message its depth and its root-to-message score; leaves are ranked by that score inside their
tree; the ancestors of each chosen leaf are marked by the same doubled pointers, so a path of n
messages costs n rows and log n rounds.  A path becomes one formatted conversation:

    <|im_start|>role\\ntext<|im_end|>\\n

Inside texts and roles a backslash is put into every ``<|`` (one more if there are some already), so a
control string never occurs there and taking one away gives the text back; roles have their line ends
and percent signs written %0A and %25.  ``segments`` has the code points from and to which each turn's
text lies in the formatted string, and whether the loss counts it.

A parent that is not there makes its child a root.  Messages of a reply cycle lie on no path and are
left out, as are messages with a null node.  A null text or role counts as empty; a null tree is a
tree of its own.  Equal scores go to the smaller leaf.  Empty tables give no rows.
A (tree, node) is expected once; rows that repeat one are joined each and repeat on the paths through it.  Other
columns are not read.  A conversation is one
row, so the longest, with its longest text, bounds the memory of its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, materialize_counted
from .common import let, running_sums

START, END = "<|im_start|>", "<|im_end|>"


def _on(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> Column:
    condition = None
    for a, b in pairs:
        same = left[a].eqNullSafe(right[b])
        condition = same if condition is None else condition & same
    return condition


def _climb(ids: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, score) of all messages below a root, and the pointers (tree, node, up) of
    each doubling round."""
    known = ids.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    present = ids.join(known, ids["tree"].eqNullSafe(known["_t"]) & (ids["parent"] == known["_n"]), "left")
    state = present.select("tree", "node", F.col("_n").alias("up"), F.lit(1).cast("long").alias("depth"), "score")
    count = {"open": F.count("up")}
    state, seen = materialize_counted(state, "reply-pointers", count)
    pointers, reach = [], 1
    while seen["open"]:
        pointers.append(state.filter(F.col("up").isNotNull()).select("tree", "node", "up"))
        if reach > seen["rows"]:  # longer than any path: what is still open is a cycle
            break
        above = state.select(
            F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("score").alias("_s")
        )
        waiting, done = state.filter(F.col("up").isNotNull()), state.filter(F.col("up").isNull())
        joined = waiting.join(above, waiting["tree"].eqNullSafe(above["_t"]) & (waiting["up"] == above["_n"]))
        moved = joined.select(
            "tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("score") + F.col("_s")).alias("score")
        )
        state, seen = materialize_counted(done.unionByName(moved), "reply-pointers", count)
        reach *= 2
    return state.filter(F.col("up").isNull()).select("tree", "node", "depth", "score"), pointers


def best_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, node, depth): the messages on the ``per_tree`` best root-to-leaf paths of each tree."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    ids = messages.filter(F.col("node").isNotNull()).select("tree", "node", "parent", score.alias("score"))
    ids = materialize(ids, "reply-ids")
    placed, pointers = _climb(ids)
    parents = ids.filter(F.col("parent").isNotNull()).select(F.col("tree").alias("_t"), F.col("parent").alias("_p"))
    leaves = placed.join(parents, placed["tree"].eqNullSafe(parents["_t"]) & (placed["node"] == parents["_p"]), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    ranked = leaves.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_tree)
    path = ranked.select("tree", F.col("node").alias("leaf"), "node")
    for jump in pointers:
        up = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        more = path.join(up, path["tree"].eqNullSafe(up["_t"]) & (path["node"] == up["_n"]))
        path = path.unionByName(more.select("tree", "leaf", F.col("up").alias("node")))
        path = materialize(path, "reply-paths")
    depth = placed.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "depth")
    joined = path.join(depth, path["tree"].eqNullSafe(depth["_t"]) & (path["node"] == depth["_n"]))
    return joined.select("tree", "leaf", "node", "depth")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_paths(messages: DataFrame, paths: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, n_turns, formatted, segments): one row for each path."""
    body = messages.select(
        F.col("tree").alias("_t"),
        F.col("node").alias("_n"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    joined = paths.join(body, paths["tree"].eqNullSafe(body["_t"]) & (paths["node"] == body["_n"]))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    turn = F.struct(
        "depth",
        head.alias("head"),
        escape(F.col("text")).alias("text"),
        F.col("role").isin(*loss_roles).alias("loss"),
    )
    tail = END + "\n"

    def segments(turns: Column) -> Column:
        sizes = F.transform(turns, lambda x: F.length(x["head"]) + F.length(x["text"]) + len(tail))
        return F.zip_with(
            turns,
            running_sums(sizes),
            lambda x, at: F.struct(
                (at + F.length(x["head"])).alias("start"),
                (at + F.length(x["head"]) + F.length(x["text"])).alias("end"),
                x["loss"].alias("loss"),
            ),
        )

    grouped = joined.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    return grouped.select(
        "tree",
        "leaf",
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda x: F.concat(x["head"], x["text"], F.lit(tail))), "").alias("formatted"),
        let(F.col("_turns"), segments).alias("segments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns``: array<struct<role, text, loss>>, parsed from the formatted string alone but for
    ``loss``, which is whether a loss segment lies exactly on the turn's text."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)

    def parse(parts: Column) -> Column:
        own = F.slice(parts, 1, F.size(parts) - 1)
        place = running_sums(F.transform(own, lambda p: F.length(p) + len(END) + 1))
        return F.zip_with(
            own,
            place,
            lambda p, at: F.struct(
                F.substring(p, len(START) + 1, F.instr(p, "\n") - len(START) - 1).alias("role"),
                F.substring(p, F.instr(p, "\n") + 1, F.length(p)).alias("text"),
                (at + F.instr(p, "\n")).alias("start"),
                (at + F.length(p)).alias("end"),
            ),
        )

    turns = F.zip_with(
        let(pieces, parse),
        F.col("segments"),
        lambda t, s: F.struct(
            _unescape_role(t["role"]).alias("role"),
            unescape(t["text"]).alias("text"),
            (s["loss"] & (s["start"] == t["start"]) & (s["end"] == t["end"])).alias("loss"),
        ),
    )
    return formatted.withColumn("turns", turns)


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: every turn answers the one before; equal turns go by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col("conv_id").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.coalesce(F.length("text"), F.lit(0)).alias("score"),
    )


def chat_digest(conversations: DataFrame) -> DataFrame:
    said = f"{END}{START}assistant ok"
    extra = conversations.sparkSession.sql(
        f"SELECT -1L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)"
    )
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).unionByName(extra)
    messages = materialize(linear_messages(rows), "messages")
    read = read_back(format_paths(messages, best_paths(messages)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
