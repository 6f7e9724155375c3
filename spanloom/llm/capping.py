"""Capping records per dominant contributor (problem 7): distributed suitor b-matching.

Every record proposes to all contributors it lists. A contributor's suitors are its best proposals up
to its capacity; weaker ones are displaced, and a record displaced anywhere withdraws everywhere. That
can leave places free, so the displaced propose again, and who proposes again can displace suitors of
the round before, until capacities hold and no place can be claimed. The result is that of taking
records best first and keeping each whose contributors all have room.

Two facts keep the rounds small. A record that is a suitor of all its contributors while everybody
proposes cannot be displaced later, so it is settled and only lowers its contributors' room. A record
whose contributor has no room left beside settled suitors is refused for good. So each round works on
the records between both: those that were displaced, but by suitors that withdrew. The best of them is
settled in every round, and with one contributor per record the first round settles all.

A contributor's weakest suitor is found without sorting a dominant contributor in one task: where the
room is small every task keeps ``room`` proposals per contributor before the shuffle; where it is large,
proposals are range-partitioned by contributor and quality and ranked by adding up partition counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

#: Rooms up to this are ranked by limits per task (in classes of powers of four), larger ones by ranges. Same rows either way.
WINDOW_ROOM = 4096


def _ranked_by_ranges(proposals: DataFrame, scratch: Scratch) -> DataFrame:
    """``proposals`` (``id, contributor, quality, room``) with their ``rank`` per contributor, whatever a contributor's size."""
    tasks = max(int(proposals.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("contributor"), F.col("quality").desc_nulls_last(), F.col("id")]
    # the row number of a sorted partition is part of the id, so it is written together with the sort
    rows = scratch.table(proposals.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("at", 33)
    runs = rows.groupBy("contributor", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("contributor").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("contributor").alias("r_contributor"), F.col("part").alias("r_part"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    j = rows.join(runs, (F.col("contributor") == F.col("r_contributor")) & (part == F.col("r_part")))
    return j.select("id", "contributor", "quality", "room", (F.col("before") + F.col("at") - F.col("first") + 1).alias("rank"))


def _suitors(proposals: DataFrame, rooms: list[int], scratch: Scratch) -> DataFrame:
    """``id, contributor``: the best ``room`` proposals of every contributor. ``rooms``: the largest room of each class."""
    w = Window.partitionBy("contributor").orderBy(F.col("quality").desc_nulls_last(), F.col("id").asc())
    out, low = None, 0
    for top in rooms:
        of = proposals.where((F.col("room") > low) & (F.col("room") <= top))
        if top <= WINDOW_ROOM:
            # a constant limit in the rank condition lets every task drop the rest before the shuffle
            part = of.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        else:
            part = _ranked_by_ranges(of, scratch)
        part = part.where(F.col("rank") <= F.col("room")).select("id", "contributor")
        out, low = part if out is None else out.unionByName(part), top
    return out


def cap_contributors(records: DataFrame, contributors: DataFrame, capacity: int | Column, *, max_share: float | None = None) -> DataFrame:
    """``id, kept``: which records stay when no contributor may keep more than its capacity.

    records: ``id`` (unique, not null) and ``quality``; greater is better, null is worst, ties go to
    the smaller id. contributors: ``id, contributor``, any number per record, repeated pairs count
    once and null contributors not at all; a record without contributors is always kept.
    ``capacity`` is a number or a column over ``contributor`` (null or negative counts as 0);
    ``max_share`` also limits it to that share of all records, rounded down. Empty tables give empty
    results.
    """
    scratch = Scratch(records.sparkSession, "capping")
    base = scratch.table(records.select("id", "quality"), "records")
    limit = capacity if isinstance(capacity, Column) else F.lit(int(capacity))
    limit = F.greatest(F.coalesce(limit.cast("long"), F.lit(0)), F.lit(0))
    if max_share is not None:
        limit = F.least(limit, F.lit(int(max_share * base.count())))
    listed = contributors.where(F.col("contributor").isNotNull()).select("id", "contributor").distinct()
    pairs = scratch.table(listed.join(base, "id", "inner").select("id", "contributor", "quality"), "pairs")
    # most contributors never reach their capacity: only the others have places to contend for
    load = pairs.groupBy("contributor").agg(F.count(F.lit(1)).alias("load")).withColumn("room", limit)
    room = scratch.table(load.where("load > room").select("contributor", "room"), "room")
    # a dominant contributor's pairs meet its one row of ``room`` in a broadcast or a join that AQE splits
    undecided, n = scratch.counted(pairs.join(room, "contributor").select("id", "contributor", "quality", "room"), "undecided")
    scratch.drop(pairs)
    refused = []
    size_class = lambda c: F.when(c <= 0, 0).otherwise(F.least(F.pow(F.lit(4), F.ceil(F.log2(c.cast("double")) / 2)).cast("long"), F.lit(2**62)))
    while n:
        rooms = sorted({min(max(int(r["c"]), 1), 2**62) for r in room.select(size_class(F.col("room")).alias("c")).distinct().collect() if r["c"]})
        rooms = [r for r in rooms if r <= WINDOW_ROOM] + ([2**62] if any(r > WINDOW_ROOM for r in rooms) else [])
        # a record is a candidate for settling if it is a suitor wherever it proposes
        if rooms:
            held = _suitors(undecided.where("room > 0"), rooms, scratch).groupBy("id").agg(F.count(F.lit(1)).alias("held"))
            proposed = undecided.groupBy("id").agg(F.count(F.lit(1)).alias("proposed"))
            settled = scratch.table(proposed.join(held, "id").where("held = proposed").select("id"), "settled")
        else:
            settled = scratch.table(undecided.select("id").limit(0), "settled")
        taken = undecided.join(settled, "id", "left_semi").groupBy("contributor").agg(F.count(F.lit(1)).alias("taken"))
        left = scratch.table(room.join(taken, "contributor", "left").select("contributor", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room")), "room")
        again = undecided.join(settled, "id", "left_anti").drop("room").join(left, "contributor")
        again = scratch.table(again.select("id", "contributor", "quality", "room"), "again")
        out = scratch.table(again.where("room <= 0").select("id").distinct(), "refused")
        refused.append(out)
        # the displaced propose again; what the refused leave is open to all
        rest, n = scratch.counted(again.join(out, "id", "left_anti"), "undecided")
        open_room = scratch.table(left.join(rest.select("contributor").distinct(), "contributor", "left_semi"), "room")
        for t in (undecided, again, settled, room, left):
            scratch.drop(t)
        undecided, room = rest, open_room
    lost = base.select(F.col("id").alias("lost_id")).limit(0)
    for r in refused:
        lost = lost.unionByName(r.withColumnRenamed("id", "lost_id"))
    return base.join(lost, F.col("id") == F.col("lost_id"), "left").select("id", F.col("lost_id").isNull().alias("kept"))
