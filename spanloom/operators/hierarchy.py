"""Parent-child links to full hierarchies (problem 3): roots, depths, paths and descendants.

Every node has one pointer to its parent. About one node in ``GAP`` is a splitter, chosen by a hash
of its id, so the choice is the same in every run and needs no state. All nodes walk to their next
splitter or to the end of their chain, by composing walks of doubled length (a walk stops at a
splitter, so the number of rounds follows the logarithm of the gap between splitters, not of the
depth). The splitters then form a pointer graph smaller by the factor ``GAP``, which is solved in
the same way, and every node takes its splitter's answer. A round that resolves nothing leaves only
nodes in or above rings: if an unresolved chain ended at all, its nearest nodes would have been
resolved in that round. Rings without a splitter are found so in the first phase, rings of splitters
in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .captures import current_rows, parent_ref
from .skew import HEAVY_SHARE, heavy_keys, pick_heavy, sketch, skew_join

#: Mean distance between splitters.
GAP = 8

CYCLE = "cycle"


def _is_splitter(c: Column, gap: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit("splitter")), F.lit(gap)) == 0


def _double(state: DataFrame, scratch: Scratch, name: str, paths: bool) -> DataFrame:
    """Compose walks until no round resolves any more.

    state: ``id, tgt, d, done, root[, seg]``. A row that is not done continues with the walk of its
    target. Rows that remain undone are in or above rings; they come back with root ``cycle``.
    """
    closed, open_rows, before = [state.where(F.col("done"))], state.where(~F.col("done")), None
    while True:
        n = open_rows.agg(F.count(F.lit(1)).alias("n"), sketch("tgt").alias("top")).first()
        if n["n"] == 0:
            break
        if before == n["n"]:
            ring = {"done": F.lit(True), "root": F.lit(CYCLE), "d": F.lit(-1)}
            closed.append(open_rows.withColumns({k: v.cast(state.schema[k].dataType) for k, v in ring.items()}))
            break
        before = n["n"]
        # finished walks stay where they were written; a round writes those that went on only
        known = _all([*closed, open_rows])
        nxt = known.select(*[F.col(c).alias(f"n_{c}") for c in state.columns])
        go = skew_join(open_rows, nxt, "tgt", "n_id", pick_heavy(n["n"], n["top"], HEAVY_SHARE), "inner")
        out = [F.col("id"), F.col("n_tgt").alias("tgt"), F.when(F.col("n_d") < 0, -1).otherwise(F.col("d") + F.col("n_d")).cast("int").alias("d"), F.col("n_done").alias("done"), F.col("n_root").alias("root")]
        if paths:
            out.append(F.concat("seg", "n_seg").alias("seg"))
        new = scratch.table(go.select(*out), name)
        closed.append(new.where(F.col("done")))
        open_rows = new.where(~F.col("done"))
    return _all(closed)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def solve_forest(nodes: DataFrame, scratch: Scratch, *, gap: int = GAP, paths: bool = False) -> DataFrame:
    """Root and depth of every node of a pointer graph.

    nodes: ``id`` (unique, not null), ``parent`` (the id of the parent node or null) and ``end``
    (what a chain is said to end at, if no node has ``parent`` or that is null) and ``end_d`` (0 or
    1: the steps from the node to ``end``). Result: ``id, root, depth`` and with ``paths`` also
    ``path``: the ids from the node's parent up to its topmost node. Nodes in or above a ring have
    root ``cycle``, depth -1 and no path. An empty table gives an empty result.
    """
    heavy = heavy_keys(nodes, "parent")
    known = nodes.select(F.col("id").alias("p_id"))
    linked = skew_join(nodes, known, "parent", "p_id", heavy, "left")
    inner = F.col("p_id").isNotNull()
    cols = [
        F.col("id"),
        F.when(inner, F.col("parent")).otherwise(F.col("id")).alias("tgt"),
        F.when(inner, 1).otherwise(F.col("end_d")).cast("int").alias("d"),
        (~inner | _is_splitter(F.col("parent"), gap)).alias("done"),
        F.when(~inner, F.col("end")).alias("root"),
    ]
    if paths:
        cols.append(F.when(inner, F.array("parent")).otherwise(F.array().cast("array<string>")).alias("seg"))
    walks = _double(scratch.table(linked.select(*cols), "walks"), scratch, "walks", paths)

    reduced = walks.where(_is_splitter(F.col("id"), gap)).withColumn("done", F.col("root").isNotNull())
    solved = _double(scratch.table(reduced, "reduced"), scratch, "reduced", paths)

    ended = walks.where(F.col("root").isNotNull())
    onward = walks.where(F.col("root").isNull())
    top = solved.select(F.col("id").alias("s_id"), F.col("d").alias("s_d"), F.col("root").alias("s_root"), *([F.col("seg").alias("s_seg")] if paths else []))
    rest = skew_join(onward, top, "tgt", "s_id", heavy_keys(onward, "tgt"), "inner")
    ring = F.col("s_root") == CYCLE
    out = [F.col("id"), F.col("s_root").alias("root"), F.when(ring, -1).otherwise(F.col("d") + F.col("s_d")).cast("int").alias("depth")]
    fin = [F.col("id"), F.col("root"), F.col("d").alias("depth")]
    if paths:
        out.append(F.concat("seg", "s_seg").alias("path"))
        fin.append(F.col("seg").alias("path"))
    both = ended.select(*fin).unionByName(rest.select(*out))
    if paths:
        both = both.withColumn("path", F.when(F.col("root") != CYCLE, F.col("path")))
    return both


def comment_nodes(comments: DataFrame) -> DataFrame:
    """Pointer graph of current comments.

    A comment without ``parent_id`` ends at ``t1_`` plus its own id, one whose reference has no
    comment row ends at that reference. Columns: ``id, parent, end, end_d, is_reply``.
    """
    cur = current_rows(comments, {"ref": parent_ref("parent_id")})
    reply = F.coalesce(F.col("ref").startswith("t1_"), F.lit(False))
    return cur.select(
        "id",
        F.when(reply, F.substring("ref", 4, 1_000_000)).alias("parent"),
        F.coalesce(F.col("ref"), F.concat(F.lit("t1_"), "id")).alias("end"),
        F.when(F.col("ref").isNull(), 0).otherwise(1).alias("end_d"),
        reply.alias("is_reply"),
    )


def comment_forest(comments: DataFrame, *, gap: int = GAP, paths: bool = False) -> DataFrame:
    """``id, is_reply, root, depth[, path]`` of every current comment.

    ``path`` lists the comment ids above the comment, nearest first, and its root last. Captures
    repeat ids; the newest row of each counts. Rows with a null id are left out.
    """
    scratch = Scratch(comments.sparkSession, "forest")
    nodes = scratch.table(comment_nodes(comments), "nodes")
    solved = solve_forest(nodes.drop("is_reply"), scratch, gap=gap, paths=paths)
    flags = nodes.select(F.col("id").alias("f_id"), "is_reply", "end", "end_d")
    out = solved.join(flags, F.col("id") == F.col("f_id"), "inner")
    if paths:
        # the root is a reference above the topmost comment, unless that comment is the root itself
        above = F.when(F.col("root") == F.concat(F.lit("t1_"), F.coalesce(F.try_element_at(F.col("path"), F.lit(-1)), F.col("id"))), F.array().cast("array<string>")).otherwise(F.array("root"))
        return out.select("id", "is_reply", "root", "depth", F.concat("path", above).alias("path"))
    return out.select("id", "is_reply", "root", "depth")


def descendants(forest: DataFrame) -> DataFrame:
    """``id, descendant, distance``: every comment below every comment, from the paths."""
    up = forest.where(F.col("path").isNotNull()).select(F.col("id").alias("descendant"), "root", F.posexplode("path").alias("pos", "id"))
    return up.where(F.col("id") != F.col("root")).select("id", "descendant", (F.col("pos") + 1).cast("int").alias("distance"))
