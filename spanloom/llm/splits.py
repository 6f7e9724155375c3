"""Splits that keep related records together (problem 6).

Records and their entities (authors, threads, sources) form a bipartite graph. Minimum labels are
propagated over it, side to side, until no label changes; after each round labels are also replaced
by their label's label, so long chains shrink geometrically. Every connected group then goes to one
split as a whole. Groups are placed largest first where they disturb the label distribution least:
a first block of ``GROUPS_PER_TASK`` in one task, group by group, as it decides where the large ones
go; then blocks of that size in parallel, each filling what the first left of every split and label
in proportion. Every label has its own targets, which travel with the groups' counts; no label list
and no group comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, skew_join
from ..plans.scratch import Scratch

#: Groups that one task places, one after the other.
GROUPS_PER_TASK = 200_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, comp`` for all nodes of ``edges`` (columns ``a, b``, not null): the smallest connected ``a``.

    Every ``b`` node gets the label of its neighbours. Nodes of both sides must not share values.
    """
    edges = scratch.table(edges.select("a", "b").distinct(), "edges")
    # a b-node with one neighbour connects nothing
    joints = edges.groupBy("b").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("b")
    core = scratch.table(edges.join(joints, "b", "left_semi"), "core")
    hot_a, hot_b = heavy_keys(core, "a"), heavy_keys(core, "b")
    label = scratch.table(core.select("a").distinct().select("a", F.col("a").alias("lab")), "label")
    right = lambda df, *cols: df.select(*[F.col(c).alias(f"r_{c}") for c in cols])
    while True:
        lab_edges = skew_join(core, right(label, "a", "lab"), "a", "r_a", hot_a, "inner").select("a", "b", F.col("r_lab").alias("lab"))
        by_b = scratch.table(lab_edges.groupBy("b").agg(F.min("lab").alias("lab")), "by_b")
        back = skew_join(core, right(by_b, "b", "lab"), "b", "r_b", hot_b, "inner")
        new = back.groupBy("a").agg(F.min("r_lab").alias("low"))
        step = scratch.table(label.join(new, "a").select("a", F.col("lab").alias("old"), F.least("lab", "low").alias("lab")), "step")
        jump = skew_join(step, right(step, "a", "lab"), "lab", "r_a", heavy_keys(step, "lab"), "left").select("a", "old", F.least("lab", F.coalesce("r_lab", F.col("lab"))).alias("lab"))
        moved = scratch.table(jump, "label")
        changed = moved.where("lab <> old").count()
        for t in (label, by_b, step):
            scratch.drop(t)
        label = moved
        if changed == 0:
            break
    a_nodes = skew_join(edges.select("a").distinct().withColumnRenamed("a", "node"), right(label, "a", "lab"), "node", "r_a", [], "left").select("node", F.coalesce("r_lab", F.col("node")).alias("comp"))
    a_nodes = scratch.table(a_nodes, "a_nodes")
    b_nodes = skew_join(edges, right(a_nodes, "node", "comp"), "a", "r_node", heavy_keys(edges, "a"), "inner").groupBy(F.col("b").alias("node")).agg(F.min("r_comp").alias("comp"))
    return a_nodes.unionByName(b_nodes)


class _Filler:
    """Splits filled group by group; counts and targets are kept for the labels seen so far."""

    def __init__(self, names: list[str], totals: list[float] | None):
        # row 0 is for all labels together
        self.at: dict[str | None, int] = {None: 0}
        self.have, self.want = np.zeros((64, len(names))), np.zeros((64, len(names)))
        self.names, self.open_end = names, totals is None
        if totals is not None:
            self.want[0] = totals

    def place(self, labels: list, n: np.ndarray, goals: np.ndarray) -> str:
        """The split whose counts, by label and in all, come closest to their targets if the group is added to it.

        ``goals`` are the labels' targets per split: records of the whole table or, without ``totals``, the
        shares in which this group raises them.
        """
        rows = np.fromiter((self.at.setdefault(x, len(self.at)) for x in labels), np.int64, len(labels))
        while len(self.at) > len(self.have):
            self.have, self.want = (np.concatenate([x, np.zeros_like(x)]) for x in (self.have, self.want))
        if self.open_end:
            self.want[rows] += goals * n[:, None]
            self.want[0] += (goals * n[:, None]).sum(axis=0)
        else:
            self.want[rows] = goals
        rows, n = np.append(rows, 0), np.append(n, n.sum())
        # change of the squared deviation: (gap - n)^2 - gap^2; the whole counts as one label of many
        gap = self.want[rows] - self.have[rows]
        change = n[:, None] * (n[:, None] - 2 * gap)
        s = int(np.argmin(change[:-1].sum(axis=0) + change[-1] * (4 / (len(self.at) + 3))))
        self.have[rows, s] += n
        return self.names[s]


def _filled(groups: DataFrame, names: list[str], totals: list[float] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = _Filler(names, totals)
        for batch in batches:
            parts = batch.column("parts")
            flat, off = parts.flatten(), np.diff(parts.offsets.to_numpy())
            labels, n = flat.field("label").to_pylist(), flat.field("n").to_numpy().astype(float)
            goals = flat.field("goals").flatten().to_numpy().reshape(-1, len(names))
            end = np.cumsum(off)
            out = [filler.place(labels[b - k : b], n[b - k : b], goals[b - k : b]) for b, k in zip(end.tolist(), off.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("comp"), pa.array(out, pa.string())], ["comp", "split"])

    return groups.select("comp", "parts").mapInArrow(run, "comp string, split string")


def assign_groups(counts: DataFrame, shares: Mapping[str, float], scratch: Scratch) -> DataFrame:
    """``comp, split``: each group in one split, label distributions near the given shares.

    counts: ``comp, label, n`` with one row per group and label; a null label is a label. A group's
    labels make one row. Deterministic; empty in, empty out.
    """
    names = list(shares)
    total_share = sum(shares.values())
    quota = [shares[x] / total_share for x in names]
    rows = counts.select("comp", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label"), "n")
    hot = heavy_keys(rows, "label")
    size = scratch.table(rows.groupBy("label").agg(F.sum("n").alias("total")), "labels")
    total = size.agg(F.sum("total").alias("n")).first()["n"] or 0
    groups = scratch.table(rows.groupBy("comp").agg(F.sum("n").alias("size")), "sizes")

    def with_goals(of: DataFrame, goals: DataFrame) -> DataFrame:
        """Groups ``comp, size`` with their labels' counts and goals."""
        right = goals.select(F.col("label").alias("g_label"), "goals")
        mine = rows.join(of.select(F.col("comp").alias("o_comp"), "size"), F.col("comp") == F.col("o_comp"))
        both = skew_join(mine, right, "label", "g_label", hot, "inner")
        return both.groupBy("comp", "size").agg(F.array_sort(F.collect_list(F.struct("label", "n", "goals"))).alias("parts"))

    order = [F.desc("size"), F.col("comp")]
    block = scratch.table(groups.orderBy(*order).limit(GROUPS_PER_TASK), "block")
    goals = size.select("label", F.array(*[F.col("total") * F.lit(q) for q in quota]).alias("goals"))
    first = scratch.table(_filled(with_goals(block, goals).coalesce(1).sortWithinPartitions(*order), names, [q * total for q in quota]), "first")
    rest, n = scratch.counted(groups.join(block.select("comp"), "comp", "left_anti"), "rest")
    if not n:
        return first
    # what the first block left of every split, as shares of what is left of the label
    have = rows.join(first, "comp").groupBy("label").pivot("split", names).agg(F.sum("n"))
    gap = lambda i: F.greatest(F.col("total") * F.lit(quota[i]) - F.coalesce(F.col(f"h_{i}"), F.lit(0)), F.lit(0.0))
    left = size.join(have.select(F.col("label").alias("h_label"), *[F.col(f"`{x}`").alias(f"h_{i}") for i, x in enumerate(names)]), F.col("label") == F.col("h_label"), "left")
    all_left = sum((gap(i) for i in range(1, len(names))), gap(0))
    ratios = left.select("label", F.array(*[F.when(all_left > 0, gap(i) / all_left).otherwise(F.lit(quota[i])) for i in range(len(names))]).alias("goals"))
    tasks = -(-n // GROUPS_PER_TASK)
    # larger groups first, so that the small ones even out what they leave
    spread = with_goals(rest, scratch.table(ratios, "ratios")).repartition(tasks, F.xxhash64("comp")).sortWithinPartitions(F.desc("size"), F.xxhash64("comp"))
    return scratch.table(_filled(spread, names, None).unionByName(first), "splits")


def group_splits(records: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """``id, comp, split`` for every record.

    records: ``id`` (unique, not null), ``e1`` and ``e2`` (entity keys, nullable) and ``label``.
    Records that share a key of ``e1`` or of ``e2``, directly or through others, have one ``comp``,
    named after its smallest ``e1`` key, or ``e2`` key if it has none, or its record's id.
    """
    scratch = Scratch(records.sparkSession, "splits")
    rec = scratch.table(
        records.select("id", F.concat(F.lit("0"), "e1").alias("a"), F.concat(F.lit("1"), "e2").alias("b"), F.col("label").cast("string").alias("label")),
        "records",
    )
    nodes = scratch.table(components(rec.where("a is not null and b is not null"), scratch), "nodes")
    key = F.coalesce(F.col("a"), F.col("b"))
    keyed = rec.select("id", "label", key.alias("k"))
    with_key = skew_join(keyed, nodes.select(F.col("node").alias("n_node"), F.col("comp").alias("n_comp")), "k", "n_node", heavy_keys(keyed, "k"), "left")
    member = scratch.table(with_key.select("id", "label", F.coalesce("n_comp", "k", F.concat(F.lit("2"), F.col("id").cast("string"))).alias("comp")), "member")
    counts = scratch.table(member.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n")), "counts")
    splits = assign_groups(counts, shares, scratch).select(F.col("comp").alias("s_comp"), "split")
    out = skew_join(member, splits, "comp", "s_comp", heavy_keys(member, "comp"), "inner")
    return out.select("id", F.substring("comp", 2, 1_000_000).alias("comp"), "label", "split")
