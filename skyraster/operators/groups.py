"""Groups of observations linked by pairs, and what is read off a group.

A group starts at a root, an observation without predecessor, and holds everything that can be
reached from it along pairs; it is numbered by its root.  An observation may be in several groups
and groups never merge, so the result does not depend on the order of work.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Rect, box_inside, point_in_rect
from ..functions.ordinals import running_offset
from ..session import materialize, materialize_counted
from .pairs import MotionPairs, motion_pairs
from .sweep import Fold, Tiling, fold_blocks, tiling

#: Pairs followed per job while groups grow.
HOPS_PER_ROUND = 4
#: Times that are swept together where pairs carry times.
STEPS_PER_SLICE = 4
#: Slices that pairs may reach without their ends being written on the way.
NEAR_SLICES = 2
#: Slices of one sweep; pairs that span more times are followed in rounds, which are as many as the longest chain needs.
MOST_SLICES = 32
#: So many motion pairs are listed before they are followed; that takes fewer jobs.
LISTED_PAIRS = 2_000_000
#: Times of a sweep that finds its pairs on the way, one job each.
MOST_TIMES = MOST_SLICES * STEPS_PER_SLICE
#: Groups that start in a square so many times as wide as a pair reaches are dealt to blocks together.
PLACE_REACHES = 12
#: Groups whose memberships share one number, a bit each.
BLOCK_GROUPS = 64
#: Steps by which groups are followed to find those that lie together.
WALK_STEPS = 8
#: Times that labels are passed on between groups whose walks end together.
MEETINGS = 3
#: A block of at most so many members, and of so many points of their outlines, is listed as one array.
LIST_ROWS = 10_000
LIST_POINTS = 65_536
#: More packed rows than that are folded by the bits of a block, in batches.
LISTED_ROWS = 1_000_000
#: Observation ids of one time are split into slices of this many ids for ordering.
SLICE_IDS = 65_536


@dataclass(frozen=True)
class PackedMembers:
    """Memberships of groups that lie together as bits of one number.

    ``rows`` (block, obsid, bits): the observation is in the groups of the block whose bits are set; a bit is set in
    one row only.  ``names`` (block, names): the ids of at most ``BLOCK_GROUPS`` groups, by bit.  Groups that meet
    share most of their members, so rows grow with the observations, not with the memberships, and operators join and
    shuffle rows; memberships are listed only where they are wanted, by the task that holds the row.
    """

    rows: DataFrame
    names: DataFrame

    def expand(self, rows: DataFrame | None = None) -> DataFrame:
        """One row per membership: obsgroupid and the columns of ``rows`` (default: obsid)."""
        rows = self.rows if rows is None else rows
        carried = [c for c in rows.columns if c not in ("block", "bits")]
        held = F.expr("filter(names, (g, i) -> bit_get(bits, i) = 1)")
        return rows.join(self.names, "block").select(F.explode(held).alias("obsgroupid"), *carried)

    @cached_property
    def _sizes(self) -> tuple[DataFrame, int]:
        sizes = self.rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
        sizes, seen = materialize_counted(sizes, "block-sizes", {"most": F.max("size")})
        return sizes, seen["most"] or 0

    def split(self, most: int, weights: DataFrame | None = None) -> tuple[PackedMembers, PackedMembers | None]:
        """Blocks of at most ``most`` rows, and the others if there are any.  ``weights`` (obsid, weight) counts the rows
        of an observation by its weight."""
        if weights is None:
            sizes, largest = self._sizes
        else:
            rows = self.rows.join(weights, "obsid", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
            sizes, seen = materialize_counted(
                rows.groupBy("block").agg(F.sum("weight").alias("size")), "block-sizes", {"most": F.max("size")}
            )
            largest = seen["most"] or 0
        if largest <= most:
            return self, None

        def part(chosen: Column) -> PackedMembers:
            ids = sizes.filter(chosen).select("block")
            return PackedMembers(self.rows.join(ids, "block", "left_semi"), self.names.join(ids, "block", "left_semi"))

        return part(F.col("size") <= most), part(F.col("size") > most)


#: Memberships as rows (obsgroupid, obsid), or packed.
Members = DataFrame | PackedMembers


def accumulate(
    pairs: DataFrame | MotionPairs,
    members: DataFrame | None = None,
    singletons_of: DataFrame | None = None,
    hops: int = HOPS_PER_ROUND,
    only_new: bool = False,
) -> DataFrame:
    """Membership table (obsgroupid, obsid) of all groups that ``pairs`` form.

    Pairs that carry times (new_time, existing_time) are followed in one sweep over time, see :func:`pack`, if
    their times are few; others in rounds of ``hops`` steps.

    ``members`` holds existing groups: an observation that already has groups passes those on
    instead of starting one, and the result contains old and new rows (``only_new``: new rows
    only).  ``singletons_of`` also gives a group of its own to each of its observations that has no predecessor.

    Only memberships found in the last round are extended.  Each round is written to the shared
    folder; known rows are never rewritten.
    """
    if isinstance(pairs, MotionPairs):
        if members is None:
            added = _moving(pairs, None, singletons_of)
            if added is not None:
                return added.expand().select("obsgroupid", "obsid")
        pairs = pairs.rows()
    if {"new_time", "existing_time"} <= set(pairs.columns):
        return _swept(pairs, members, singletons_of, only_new, hops=hops)
    edges = materialize(
        pairs.select(F.col("new_obsid").cast("long"), F.col("existing_obsid").cast("long")), "edges"
    )
    return _in_rounds(edges, members, singletons_of, hops, only_new)


def _in_rounds(
    edges: DataFrame, members: DataFrame | None, singletons_of: DataFrame | None, hops: int, only_new: bool
) -> DataFrame:
    heads = edges.select(F.col("existing_obsid").alias("obsid")).distinct()
    if singletons_of is not None:
        heads = singletons_of.select(F.col("obsid").cast("long")).unionByName(heads).distinct()
    roots = heads.join(edges.select(F.col("new_obsid").alias("obsid")), "obsid", "left_anti")
    if members is not None:
        members = members.select(F.col("obsgroupid").cast("long"), F.col("obsid").cast("long"))
        roots = roots.join(members.select("obsid"), "obsid", "left_anti")
        seeds = members.join(edges.select(F.col("existing_obsid").alias("obsid")), "obsid", "left_semi")
    fresh = roots.select(F.col("obsid").alias("obsgroupid"), "obsid")
    fresh = materialize(fresh, "group-round")
    known, added = (fresh if members is None else members.unionByName(fresh)), fresh
    frontier = fresh if members is None else materialize(seeds.unionByName(fresh), "group-seeds")

    while True:
        reached, step = None, frontier
        for hop in range(1, hops + 1):
            step = (
                step.join(edges, step["obsid"] == edges["existing_obsid"])
                .select("obsgroupid", F.col("new_obsid").alias("obsid"))
                .distinct()
            )
            tagged = step.withColumn("hop", F.lit(hop))
            reached = tagged if reached is None else reached.unionByName(tagged)
        found = (
            reached.groupBy("obsgroupid", "obsid")
            .agg(F.min("hop").alias("hop"))
            .join(known, ["obsgroupid", "obsid"], "left_anti")
        )
        # Rows first met on an earlier hop were extended by the next hop of this very round.
        found, seen = materialize_counted(
            found, "group-round", {"open": F.sum(F.when(F.col("hop") == hops, 1).otherwise(0))}
        )
        if seen["rows"]:
            known = known.unionByName(found.select("obsgroupid", "obsid"))
            added = added.unionByName(found.select("obsgroupid", "obsid"))
        if not seen["open"]:
            return added if only_new else known
        frontier = found.filter(F.col("hop") == hops).select("obsgroupid", "obsid")


def _timed_edges(pairs: DataFrame, steps: int) -> tuple[DataFrame, dict]:
    """Pairs with the slices of their ends, written in the order of the earlier one."""

    def slice_of(time: str) -> Column:
        return F.floor(F.col(time) / F.lit(steps)).cast("int")

    edges = pairs.select(
        F.col("new_obsid").cast("long"),
        F.col("existing_obsid").cast("long"),
        slice_of("existing_time").alias("source"),
        slice_of("new_time").alias("target"),
        (F.col("existing_time") >= F.col("new_time")).cast("int").alias("back"),
    ).repartitionByRange("source", "existing_obsid")
    seen_of = {
        "first": F.min("source"), "last": F.max("target"), "back": F.max("back"), "reach": F.max(F.col("target") - F.col("source")),
    }
    edges, seen = materialize_counted(edges, "edges", seen_of)
    if seen["back"]:
        raise ValueError("a pair must lead from an earlier time to a later one")
    return edges, seen


def _swept(
    pairs: DataFrame,
    members: DataFrame | None,
    singletons_of: DataFrame | None,
    only_new: bool,
    steps: int = STEPS_PER_SLICE,
    hops: int = HOPS_PER_ROUND,
) -> DataFrame:
    """:func:`pack` as one row per membership.  Pairs that span more than ``MOST_SLICES`` slices are followed in rounds."""
    edges, seen = _timed_edges(pairs, steps)
    if seen["rows"] and seen["last"] - seen["first"] >= MOST_SLICES:
        return _in_rounds(edges.select("new_obsid", "existing_obsid"), members, singletons_of, hops, only_new)
    known = None
    if members is not None:
        members = members.select(F.col("obsgroupid").cast("long"), F.col("obsid").cast("long"))
        known = PackedMembers(
            members.select(F.col("obsgroupid").alias("block"), "obsid", F.lit(1).cast("long").alias("bits")).distinct(),
            members.select(F.col("obsgroupid").alias("block"), F.array("obsgroupid").alias("names")).distinct(),
        )
    added = _pack(edges, seen, known, singletons_of, steps).expand().select("obsgroupid", "obsid")
    return added if members is None or only_new else members.unionByName(added)


def pack(
    pairs: DataFrame | MotionPairs,
    members: PackedMembers | None = None,
    singletons_of: DataFrame | None = None,
    only_new: bool = False,
    steps: int = STEPS_PER_SLICE,
) -> PackedMembers:
    """Groups of pairs that carry times, packed, by one sweep over slices of ``steps`` times.

    A pair leads to a later time, so all memberships of a slice are known once the slices before it are done.  They
    are its roots and what earlier slices have sent, followed along the pairs inside of the slice (fewer than
    ``steps`` hops); what is found is sent once along the pairs that leave the slice, in folders by the slice they lead
    to; where pairs reach ``NEAR_SLICES`` slices at most, the slice they lead to does that join instead.  So a membership
    takes part in a fixed number of joins however long its group is, is compared with others of its own slice only, and
    a slice is never read again.  What is sent are the bits of a block, not single memberships.

    :class:`MotionPairs` are not listed, see :func:`_moving`.
    """
    added = _moving(pairs, members, singletons_of) if isinstance(pairs, MotionPairs) else None
    if added is None:
        edges, seen = _timed_edges(pairs.rows() if isinstance(pairs, MotionPairs) else pairs, steps)
        added = _pack(edges, seen, members, singletons_of, steps)
    if members is None or only_new:
        return added
    return PackedMembers(members.rows.unionByName(added.rows), added.names)


def _blocks(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks (block, names) of roots that lie together.

    Every root walks on, once to the successor with the largest id, once to the one with the smallest; roots whose
    walks end together, directly or over others, are dealt to blocks next to each other.  A bad deal costs rows, no result.
    """
    onward = edges.groupBy("existing_obsid").agg(F.max("new_obsid").alias("_up"), F.min("new_obsid").alias("_down"))
    walk = roots.select(F.col("obsid").alias("obsgroupid"), F.col("obsid").alias("_high"), F.col("obsid").alias("_low"))
    for _ in range(WALK_STEPS):
        for end, towards in (("_high", "_up"), ("_low", "_down")):
            step = onward.select(F.col("existing_obsid").alias(end), F.col(towards).alias("_next"))
            walk = walk.join(step, end, "left").withColumn(end, F.coalesce("_next", end)).drop("_next")
    walk = materialize(walk.withColumn("_label", F.col("_high")), "group-walks")
    for _ in range(MEETINGS):
        for end in ("_low", "_high"):
            least = walk.groupBy(end).agg(F.min("_label").alias("_least"))
            walk = walk.join(least, end).withColumn("_label", F.col("_least")).drop("_least")
    walk = walk.withColumn("_bucket", F.floor(F.col("obsgroupid") / SLICE_IDS))
    ranked = running_offset(walk, ["_label"], ["_high", "_bucket"], ["obsgroupid"])
    names = ranked.groupBy("_label", F.floor(F.col("ord") / BLOCK_GROUPS).alias("_part")).agg(
        F.sort_array(F.collect_list("obsgroupid")).alias("names")
    )
    return names.select(F.col("names")[0].alias("block"), "names")


def _merged(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("block", "obsid", *more).agg(F.bit_or("bits").alias("bits"))


def _pack(
    edges: DataFrame, seen: dict, members: PackedMembers | None, singletons_of: DataFrame | None, steps: int
) -> PackedMembers:
    """New memberships; ``names`` holds those of ``members`` too."""
    heads = edges.groupBy(F.col("existing_obsid").alias("obsid")).agg(F.min("source").alias("source"))
    if singletons_of is not None:
        alone = singletons_of.select(F.col("obsid").cast("long"), F.lit(None).cast("int").alias("source"))
        heads = heads.unionByName(alone).groupBy("obsid").agg(F.min("source").alias("source"))
    roots = heads.join(edges.select(F.col("new_obsid").alias("obsid")), "obsid", "left_anti")
    sent: list[tuple[int | None, DataFrame]] = []
    if members is not None:
        roots = roots.join(members.rows.select("obsid"), "obsid", "left_anti")
        old = members.rows.join(edges, members.rows["obsid"] == edges["existing_obsid"])
        old = _merged(old.select("block", F.col("new_obsid").alias("obsid"), "bits", "target"), "target")
        sent.append((None, materialize(old, "group-sent", partition_by=["target"])))
    roots = materialize(roots.select("obsid", "source"), "group-roots")
    names = materialize(_blocks(roots, edges), "group-names")
    placed = names.select("block", F.posexplode("names").alias("_bit", "obsid"))
    placed = placed.join(roots, "obsid").select("block", "obsid", F.expr("shiftleft(1L, _bit)").alias("bits"), "source")
    row = ["block", "obsid", "bits"]
    found = [placed.filter(F.col("source").isNull()).select(*row)]
    for now in range(seen["first"], seen["last"] + 1) if seen["rows"] else ():
        start = placed.filter(F.col("source") == now).select(*row)
        for origin, rows in sent:
            if origin is None or now - origin <= seen["reach"]:
                start = start.unionByName(rows.filter(F.col("target") == now).select(*row))
        own = edges.filter(F.col("source") == now)
        inner = own.filter(F.col("target") == now).select("existing_obsid", "new_obsid")
        step = reached = _merged(start)
        for _ in range(steps - 1):
            step = step.join(inner, step["obsid"] == inner["existing_obsid"])
            step = _merged(step.select("block", F.col("new_obsid").alias("obsid"), "bits"))
            reached = reached.unionByName(step)
        reached, size = materialize_counted(_merged(reached), "group-slice")
        if not size["rows"]:
            continue
        found.append(reached)
        if now < seen["last"] and seen["reach"]:
            leaving = own.filter(F.col("target") > now)
            onward = reached.join(leaving, reached["obsid"] == leaving["existing_obsid"])
            onward = onward.select("block", F.col("new_obsid").alias("obsid"), "bits", "target")
            if seen["reach"] > NEAR_SLICES:
                onward = materialize(_merged(onward, "target"), "group-sent", partition_by=["target"])
            sent.append((now, onward))
    added = reduce(DataFrame.unionByName, found)
    return _new_members(added, names, members)


def _new_members(added: DataFrame, names: DataFrame, members: PackedMembers | None) -> PackedMembers:
    """``added`` without what ``members`` holds."""
    if members is None:
        return PackedMembers(added, names)
    known = _merged(members.rows).withColumnRenamed("bits", "_known")
    bits = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long"))))
    added = added.join(known, ["block", "obsid"], "left").select("block", "obsid", bits.alias("bits"))
    added = materialize(added.filter(F.col("bits") != 0), "group-added")
    return PackedMembers(added, members.names.unionByName(names))


def _moving(pairs: MotionPairs, members: PackedMembers | None, singletons_of: DataFrame | None) -> PackedMembers | None:
    """New memberships of pairs that are found on the way, by one sweep over times; None where an observation has several
    places or no id, times are many or pairs are few.

    The pairs are made twice and never sent: once to see who has predecessors and successors, and once where memberships
    are passed on.  Both is done in tiles of the sky (:mod:`.sweep`), which take many times in one job.  Where a tile would
    be too crowded for a task, pairs are joined, and the rows of the last ``t`` times meet the observations of the next in a
    cell; there they are folded to a row for each block and observation.  So what is shuffled and written grows with the
    observations and the blocks they are in.  Groups that start near each other are dealt to blocks together.
    """
    place = ["obsid", "time", "centerx", "centery"]
    spot = F.struct("time", "centerx", "centery")
    places = pairs.obs.select(F.col("obsid").cast("long"), *place[1:]).na.drop(subset=place[1:])
    several = F.col("obsid").isNull() | (F.min(spot) != F.max(spot))
    places = places.groupBy("obsid").agg(F.min(spot).alias("_spot"), several.cast("int").alias("_several"))
    places = places.select("obsid", "_spot.*", "_several").repartitionByRange("time", "obsid")
    places, seen = materialize_counted(places, "group-places", {"several": F.max("_several")})
    places = places.drop("_several")
    if seen["several"]:
        return None
    times = sorted(r["time"] for r in places.select("time").distinct().limit(MOST_TIMES + 1).collect())
    if len(times) > MOST_TIMES:
        return None

    # 1: has a predecessor, 2: has a successor or starts a group anyway.
    tiles = tiling(pairs, places, times)
    if tiles is not None:
        roots = tiles.ends(places)
    else:
        linked = replace(pairs, obs=places).rows()
        ends = F.array(*[F.struct(F.col(c).alias("obsid"), F.lit(n).alias("end")) for c, n in (("new_obsid", 1), ("existing_obsid", 2))])
        roots = linked.select(F.inline(ends)).groupBy("obsid").agg(F.bit_or("end").alias("end"), F.count(F.lit(1)).alias("met"))
    roots, seen = materialize_counted(roots, "group-ends", {"met": F.sum("met")})
    # The join sees a pair from both of its ends, a tile from the later one.
    if (seen["met"] or 0) <= (LISTED_PAIRS if tiles is not None else 2 * LISTED_PAIRS):
        return None
    roots = roots.drop("met")
    if singletons_of is not None:
        alone = singletons_of.select(F.col("obsid").cast("long"), F.lit(2).alias("end"))
        roots = roots.unionByName(alone).groupBy("obsid").agg(F.bit_or("end").alias("end"))
    roots = roots.filter(F.col("end") == 2).select("obsid")
    if members is not None:
        roots = roots.join(members.rows.select("obsid"), "obsid", "left_anti")
    roots = materialize(roots.join(places, "obsid", "left"), "group-roots")

    side = F.lit(PLACE_REACHES * max(1, int(pairs.d2 * pairs.t)))
    near = {"_cx": F.col("centerx"), "_cy": F.col("centery")}
    dealt = roots.withColumns({c: F.coalesce(F.floor(v / side), F.lit(0)) for c, v in near.items()})
    dealt = dealt.withColumns({"_when": F.coalesce("time", F.lit(0)), "_bucket": F.coalesce(F.floor(F.col("obsid") / SLICE_IDS), F.lit(0))})
    ranked = running_offset(dealt, ["_cx", "_cy"], ["_when", "_bucket"], ["obsid"])
    names = ranked.groupBy("_cx", "_cy", F.floor(F.col("ord") / BLOCK_GROUPS).alias("_part")).agg(
        F.sort_array(F.collect_list("obsid")).alias("names")
    )
    names = materialize(names.select(F.col("names")[0].alias("block"), "names"), "group-names")
    placed = names.select("block", F.posexplode("names").alias("_bit", "obsid")).join(roots, "obsid")
    row = ["block", *place, "bits"]
    placed = placed.withColumn("bits", F.expr("shiftleft(1L, _bit)")).select(*row).repartitionByRange("time", "obsid")
    placed = materialize(placed, "group-placed")
    known = None
    if members is not None:
        known = members.rows.join(places, "obsid").select(*row).repartitionByRange("time", "obsid")
        known = materialize(known, "group-known")

    found = [placed.filter(F.col("time").isNull())]
    if tiles is not None:
        found += _in_tiles(tiles, places, times, placed, known)
        return _new_members(reduce(DataFrame.unionByName, found).select("block", "obsid", "bits"), names, members)
    recent: list[tuple[int, DataFrame]] = []
    for now in times:
        start = placed.filter(F.col("time") == now)
        recent = [(time, rows) for time, rows in recent if time >= now - pairs.t]
        past = [rows for _, rows in recent]
        if pairs.takes(now) and known is not None:
            past.append(known.filter(F.col("time").between(now - pairs.t, now - 1)))
        if pairs.takes(now) and past:
            met = motion_pairs(
                places.filter(F.col("time") == now), reduce(DataFrame.unionByName, past), pairs.d2, pairs.t, hot_rows=None,
                new_columns=["centerx", "centery"], existing_columns=["block", "bits"],
            )
            start = start.unionByName(met.select("block", F.col("new_obsid").alias("obsid"), F.col("new_time").alias("time"), "centerx", "centery", "bits"))
        reached, size = materialize_counted(_merged(start, "time", "centerx", "centery").select(*row), "group-time")
        if size["rows"]:
            found.append(reached)
            recent.append((now, reached))
    return _new_members(reduce(DataFrame.unionByName, found).select("block", "obsid", "bits"), names, members)


def _in_tiles(tiles: Tiling, places: DataFrame, times: list[int], placed: DataFrame, known: DataFrame | None) -> list[DataFrame]:
    """Memberships by slices of time; a slice takes what the ``t`` times before it hold."""
    held = placed.filter(F.col("time").isNotNull())
    if known is not None:
        held = held.unionByName(known)
    found: list[DataFrame] = []
    for number in sorted({(time - tiles.first) // tiles.span for time in times}):
        rows = tiles.members(number, places, reduce(DataFrame.unionByName, found[-1:], held))
        found.append(materialize(rows, "group-time"))
    return found


def groups_of(members: Members, ids: DataFrame) -> DataFrame:
    """Groups of the given observations, one row per (obsid, obsgroupid)."""
    if isinstance(members, PackedMembers):
        return members.expand(members.rows.join(ids.select("obsid"), "obsid", "left_semi")).select("obsid", "obsgroupid")
    return members.join(ids.select("obsid").distinct(), "obsid", "left_semi").select("obsid", "obsgroupid").distinct()


def members_of(members: Members, groups: DataFrame) -> DataFrame:
    """Membership rows of the given groups."""
    if isinstance(members, PackedMembers):
        named = members.names.select("block", F.posexplode("names").alias("_bit", "obsgroupid"))
        wanted = named.join(groups.select("obsgroupid"), "obsgroupid", "left_semi")
        masks = wanted.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))
        rows = members.rows.join(masks, "block").withColumn("bits", F.col("bits").bitwiseAND(F.col("_mask")))
        return members.expand(rows.filter(F.col("bits") != 0).drop("_mask")).select("obsgroupid", "obsid")
    return members.join(groups.select("obsgroupid"), "obsgroupid", "left_semi").select("obsgroupid", "obsid")


def _lists(members: PackedMembers, values: list[str]) -> DataFrame:
    """Per group the array of structs (``values``, in their order) of its members; a block in one task."""
    listed = members.rows.repartition("block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct(*values, "bits"))).alias("_all")
    )
    named = listed.join(members.names, "block").select("_all", F.posexplode("names").alias("_bit", "obsgroupid"))
    return named.select("obsgroupid", F.expr("filter(_all, p -> bit_get(p.bits, _bit) = 1)").alias("points")).filter(
        F.size("points") > 0
    )


def _centers(obs: DataFrame) -> DataFrame:
    return obs.select("obsid", "time", F.col("centerx").alias("x"), F.col("centery").alias("y"))


def center_lists(members: PackedMembers, obs: DataFrame) -> DataFrame:
    """Trajectory of every group as one array of (time, obsid, x, y); for blocks of bounded size."""
    located = PackedMembers(members.rows.join(_centers(obs), "obsid"), members.names)
    return _lists(located, ["time", "obsid", "x", "y"])


def center_traj(members: Members, obs: DataFrame) -> DataFrame:
    """Trajectory points of every group in (time, obsid) order: obsgroupid, ord, time, obsid, x, y."""
    if isinstance(members, PackedMembers):
        listed, large = members.split(LIST_ROWS)
        points = center_lists(listed, obs).select("obsgroupid", F.posexplode("points").alias("ord", "p"))
        points = points.select("obsgroupid", "ord", "p.time", "p.obsid", "p.x", "p.y").filter(F.col("time").isNotNull())
        return points if large is None else points.unionByName(center_traj(large.expand(), obs))
    points = members.join(
        obs.select("obsid", "time", F.col("centerx").alias("x"), F.col("centery").alias("y")), "obsid"
    ).withColumn("_bucket", F.floor(F.col("obsid") / SLICE_IDS))
    return running_offset(points, ["obsgroupid"], ["time", "_bucket"], ["obsid"]).select(
        "obsgroupid", F.col("ord").cast("int").alias("ord"), "time", "obsid", "x", "y"
    )


def group_members(members: Members, chunk: int = 10_000) -> DataFrame:
    """Members listed per group in id order, as arrays of at most ``chunk`` ids.

    Groups up to ``chunk`` members are one row; a longer group continues in rows part = 1, 2, ...
    """
    if isinstance(members, PackedMembers):
        listed, large = members.split(chunk)
        rows = _lists(listed, ["obsid"]).select(
            "obsgroupid", F.lit(0).alias("part"), F.transform("points", lambda p: p["obsid"]).alias("obsids")
        )
        return rows if large is None else rows.unionByName(group_members(large.expand(), chunk))
    numbered = running_offset(
        members.withColumn("_bucket", F.floor(F.col("obsid") / SLICE_IDS)), ["obsgroupid"], ["_bucket"], ["obsid"]
    )
    return (
        numbered.groupBy("obsgroupid", F.floor(F.col("ord") / chunk).cast("int").alias("part"))
        .agg(F.sort_array(F.collect_list("obsid")).alias("obsids"))
    )


def _folded(members: Members, obs: DataFrame, keys: list[str], rows: dict[str, Column], again: dict[str, Column], sums: dict[str, Fold]) -> DataFrame:
    """Members with the columns of ``obs`` folded per group and ``keys``.

    Packed members that are in the same groups of a block are folded to one row (``rows``) first, and those rows for each
    group (``again``), so that memberships are not listed.  More than ``LISTED_ROWS`` of them are folded bit by bit of
    their blocks instead (``sums``, see :func:`fold_blocks`); rows with a null are left to the listing.
    """
    if not isinstance(members, PackedMembers):
        return members.join(obs, "obsid").groupBy("obsgroupid", *keys).agg(*[c.alias(n) for n, c in rows.items()])
    joined = members.rows.join(obs, "obsid")

    def listed(part: DataFrame) -> DataFrame:
        alike = part.groupBy("block", "bits", *keys).agg(*[c.alias(n) for n, c in rows.items()])
        return members.expand(alike).groupBy("obsgroupid", *keys).agg(*[c.alias(n) for n, c in again.items()])

    if members.rows.count() <= LISTED_ROWS:
        return listed(joined)
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in obs.columns])
    folded = fold_blocks(joined.filter(whole), sums).join(members.names, "block").withColumn("obsgroupid", F.col("names")[F.col("_bit")])
    folded = folded.groupBy("obsgroupid", *keys).agg(*[c.alias(n) for n, c in again.items()])
    return folded.unionByName(listed(joined.filter(~whole)))


def group_summary(members: Members, obs: DataFrame) -> DataFrame:
    """First observation, size, integer centroid and bounding box of the centres of each group.

    Aggregated by time first, with numbers only, so that members are folded in memory without a sort.
    """
    n = F.sum("_n")
    rows = {
        "_first": F.min("obsid"),
        "_n": F.count(F.lit(1)),
        "_sumx": F.sum(F.col("centerx").cast("long")),
        "_sumy": F.sum(F.col("centery").cast("long")),
        "minx": F.min("centerx"),
        "miny": F.min("centery"),
        "maxx": F.max("centerx"),
        "maxy": F.max("centery"),
    }
    fold = {"_first": F.min, "minx": F.min, "miny": F.min, "maxx": F.max, "maxy": F.max}
    again = {name: fold.get(name, F.sum)(name) for name in rows}
    sums = {
        "time": ("least", ("time", "obsid"), "time"),
        "_first": ("least", ("time", "obsid"), "obsid"),
        "_n": ("count", (), None),
        "_sumx": ("sum", ("centerx",), None),
        "_sumy": ("sum", ("centery",), None),
        **_box_folds({"minx": "centerx", "miny": "centery", "maxx": "centerx", "maxy": "centery"}),
    }
    return (
        _folded(members, obs.select("obsid", "time", "centerx", "centery"), ["time"], rows, again, sums)
        .groupBy("obsgroupid")
        .agg(
            F.min(F.struct("time", "_first"))["_first"].alias("first_obsid"),
            n.alias("n_obs"),
            F.floor(F.sum("_sumx") / n).cast("int").alias("centroidx"),
            F.floor(F.sum("_sumy") / n).cast("int").alias("centroidy"),
            F.min("minx").alias("minx"),
            F.min("miny").alias("miny"),
            F.max("maxx").alias("maxx"),
            F.max("maxy").alias("maxy"),
        )
    )


def group_bbox(members: Members, obs: DataFrame) -> DataFrame:
    """Box around the outline boxes of all members of each group."""
    box = {"minx": "boxxstart", "miny": "boxystart", "maxx": "boxxend", "maxy": "boxyend"}
    fold = {name: F.min if name.startswith("min") else F.max for name in box}
    rows = {name: fold[name](column) for name, column in box.items()}
    again = {name: fold[name](name) for name in box}
    found = _folded(members, obs.select("obsid", *box.values()), [], rows, again, _box_folds(box))
    # Members with a null and those without are folded apart.
    return found.groupBy("obsgroupid").agg(*[c.alias(n) for n, c in again.items()])


def _box_folds(box: dict[str, str]) -> dict[str, Fold]:
    return {name: (name[:3], (column,), None) for name, column in box.items()}


def _step_members(members: DataFrame, obs: DataFrame, columns: list[str]) -> DataFrame:
    """Members of every step between consecutive times of a group; part 0 = earlier, 1 = later."""
    timed = members.join(obs.select("obsid", "time", *columns), "obsid")
    line = Window.partitionBy("obsgroupid").orderBy("time")
    times = (
        timed.select("obsgroupid", "time")
        .distinct()
        .withColumn("_prev", F.lag("time").over(line))
        .withColumn("_next", F.lead("time").over(line))
    )

    def step(start, end, part: int):
        return F.struct(start.alias("fromtime"), end.alias("totime"), F.lit(part).alias("part"))

    roles = F.filter(
        F.array(step(F.col("time"), F.col("_next"), 0), step(F.col("_prev"), F.col("time"), 1)),
        lambda s: s["fromtime"].isNotNull() & s["totime"].isNotNull(),
    )
    return (
        timed.join(times, ["obsgroupid", "time"])
        .withColumn("_step", F.explode(roles))
        .select("obsgroupid", "_step.fromtime", "_step.totime", "_step.part", "obsid", *columns)
    )


def step_boxes(members: DataFrame, obs: DataFrame) -> DataFrame:
    """Bounding box of the swept polygon of every step (obsgroupid, fromtime, totime)."""
    box = ["boxxstart", "boxystart", "boxxend", "boxyend"]
    return (
        _step_members(members, obs, box)
        .groupBy("obsgroupid", "fromtime", "totime")
        .agg(
            F.min("boxxstart").alias("minx"),
            F.min("boxystart").alias("miny"),
            F.max("boxxend").alias("maxx"),
            F.max("boxyend").alias("maxy"),
        )
    )


def _rings(members: PackedMembers, shapes: DataFrame) -> DataFrame:
    """Swept polygon of every step as one array: obsgroupid, fromtime, totime, points (x, y); for blocks of bounded size.

    ``shapes`` (obsid, time, shape) has a point as one number, as a shape is sent once for each block of its observation.
    """
    layers = (
        members.rows.join(shapes, "obsid")
        .repartition("block")
        .groupBy("block", "time")
        .agg(F.sort_array(F.collect_list(F.struct("obsid", "bits", "shape"))).alias("_layer"))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("time", "_layer"))).alias("_layers"))
    )
    named = layers.join(members.names, "block").select("_layers", F.posexplode("names").alias("_bit", "obsgroupid"))
    mine = F.expr(
        "filter(transform(_layers, l -> struct(l.time as time, filter(l._layer, p -> bit_get(p.bits, _bit) = 1) as held)),"
        " l -> size(l.held) > 0)"
    )
    shaped = F.expr("transform(_mine, l -> struct(l.time as time, flatten(transform(l.held, p -> p.shape)) as points))")
    steps = F.expr(
        "transform(sequence(0, size(_mine) - 2), k -> struct(_mine[k].time as fromtime, _mine[k + 1].time as totime,"
        " concat(_mine[k].points, _mine[k + 1].points) as points))"
    )
    return (
        named.select("obsgroupid", mine.alias("_mine"))
        .filter(F.size("_mine") > 1)
        .select("obsgroupid", shaped.alias("_mine"))
        .select("obsgroupid", F.explode(steps).alias("_step"))
        .filter(F.size("_step.points") > 0)
        .select("obsgroupid", "_step.fromtime", "_step.totime", F.concat("_step.points", F.slice("_step.points", 1, 1)).alias("points"))
        .withColumn("points", F.transform("points", _point))
    )


def _number(x: Column, y: Column) -> Column:
    """A point as one number, and back by :func:`_point`."""
    return F.shiftleft(x.cast("long"), 32).bitwiseOR(y.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))


def _point(number: Column) -> Column:
    y = F.shiftright(F.shiftleft(number, 32), 32)
    return F.struct(F.shiftright(number, 32).cast("int").alias("x"), y.cast("int").alias("y"))


def step_rings(
    members: PackedMembers, obs: DataFrame, vertices: DataFrame
) -> tuple[DataFrame, PackedMembers | None]:
    """Swept polygons as arrays (see :func:`_rings`) where a block has at most ``LIST_POINTS`` points, and the other members.

    An observation that comes twice, or whose vertices are not numbered from 0 without a gap or lack a coordinate, leaves
    its blocks to the others.
    """
    many = obs.groupBy("obsid").agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1).select("obsid", F.lit(True).alias("_many"))
    sizes = vertices.groupBy("obsid").agg(F.count(F.lit(1)).alias("_n"))
    sizes, seen = materialize_counted(sizes, "shape-sizes", {"most": F.max("_n")})
    if (seen["most"] or 0) > LIST_POINTS:
        vertices = vertices.join(sizes.filter(F.col("_n") <= LIST_POINTS).select("obsid"), "obsid", "left_semi")
    shapes = vertices.groupBy("obsid").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("_points"))
    plain = F.expr("transform(_points, p -> cast(p.ord as bigint)) = sequence(0L, size(_points) - 1L)")
    plain = plain & ~F.exists("_points", lambda p: p["x"].isNull() | p["y"].isNull())
    shapes = shapes.select("obsid", F.transform("_points", lambda p: _number(p["x"], p["y"])).alias("shape"), plain.alias("_plain"))
    shapes = materialize(shapes, "shapes")
    whole = sizes.join(shapes.filter("_plain").select("obsid", "_plain"), "obsid", "left").join(many, "obsid", "full")
    odd = F.col("_many").isNotNull() | F.col("_plain").isNull()
    weights = whole.select("obsid", F.when(odd, LIST_POINTS + 1).otherwise(F.col("_n")).alias("weight"))
    listed, large = members.split(LIST_POINTS, weights)
    timed = obs.select("obsid", "time").filter(F.col("time").isNotNull()).join(shapes.select("obsid", "shape"), "obsid", "left")
    timed = timed.withColumn("shape", F.coalesce("shape", F.array().cast("array<bigint>")))
    return _rings(listed, timed), large


def polygon_traj(members: Members, obs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Swept polygon of every step: the earlier members' vertices, then the later members', closed
    with the first vertex.  One row per vertex: obsgroupid, fromtime, totime, ord, x, y.
    """
    if isinstance(members, PackedMembers):
        rings, large = step_rings(members, obs, vertices)
        rows = rings.select("obsgroupid", "fromtime", "totime", F.posexplode("points").alias("ord", "p"))
        rows = rows.select("obsgroupid", "fromtime", "totime", "ord", "p.x", "p.y")
        return rows if large is None else rows.unionByName(polygon_traj(large.expand(), obs, vertices))
    sizes = vertices.groupBy("obsid").agg(F.count(F.lit(1)).alias("_n"))
    keys = ["obsgroupid", "fromtime", "totime"]
    placed = running_offset(
        _step_members(members, obs, [])
        .join(sizes, "obsid")
        .withColumn("_bucket", F.floor(F.col("obsid") / SLICE_IDS)),
        keys,
        ["part", "_bucket"],
        ["obsid"],
        weight=F.col("_n"),
        name="_offset",
        total="_total",
    )
    position = F.col("_offset") + F.col("ord")
    slots = F.when(position == 0, F.array(position, F.col("_total"))).otherwise(F.array(position))
    return (
        placed.select(*keys, "obsid", "_offset", "_total")
        .join(vertices.select("obsid", "ord", "x", "y"), "obsid")
        .select(*keys, F.explode(slots).alias("ord"), "x", "y")
        .withColumn("ord", F.col("ord").cast("int"))
    )


def q7(members: Members, obs: DataFrame, rect: Rect, boxes: DataFrame | None = None) -> DataFrame:
    """Groups whose whole trajectory lies in the slab, and observations whose centre does.

    ``boxes`` is a stored :func:`group_summary`; without it the boxes are computed here.
    """
    boxes = group_summary(members, obs) if boxes is None else boxes
    inside = boxes.filter(box_inside(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), rect))
    points = obs.filter(point_in_rect(F.col("centerx"), F.col("centery"), rect))
    return inside.select(F.lit("group").alias("kind"), F.col("obsgroupid").alias("id")).unionByName(
        points.select(F.lit("observation").alias("kind"), F.col("obsid").alias("id"))
    )


def q7_count(members: Members, obs: DataFrame, rect: Rect, boxes: DataFrame | None = None) -> DataFrame:
    return q7(members, obs, rect, boxes).agg(F.count(F.lit(1)).alias("n"))
