"""References to records that do not exist (problem 1): direct and inherited orphans.

The foreign-key graph is given as references (which record refers by which field to which record of
which table) and entities (the records that exist). Level 0 joins references to entities and states
what is wrong with each broken one. The fixpoint then walks down the graph: every round semi-joins the
remaining references with the newest orphans, so children of orphaned records become inherited
orphans, until a round finds none; each inherits the cause of the record it hangs from.

The rounds run over edges alone: references between existing records, as (node, target) and nothing
else. Edges are written once, bucketed by target, so a round shuffles the frontier only, never the
edges; those of dominant targets lie apart, in tasks of equal size, and meet a broadcast of the few
frontier rows that name such a target. Edges of records that were reached are dropped when they make
up half of the table. Nothing is collected but counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .captures import current_rows, link_key, month_of, parent_ref
from .skew import heavy_keys, skew_join

#: Bodies and self texts of dead records: fixed values.
DEAD_COMMENT = ("", "[deleted]", "[removed]")
DEAD_POST = ("[deleted]", "[removed]")

BREAKS = ("missing", "deleted")
COLS = ["node", "id", "rec_table", "ref_field", "target", "month"]
#: Edges per bucket from which a bucketed table is written.
BUCKET_ROWS = 100_000
#: Rows of a counted table up to which it is broadcast.
FEW = 10_000


@dataclass
class OrphanReport:
    """``direct``: one row per broken reference. ``inherited``: one row per reference to an orphaned record.

    Both have ``node, id, rec_table, ref_field, target, month, state, origin, level, cause``, where
    ``cause`` is the state of the broken reference that it all hangs from.
    """

    direct: DataFrame
    inherited: DataFrame

    def all(self) -> DataFrame:
        return self.direct.unionByName(self.inherited)

    def by_period(self) -> DataFrame:
        """Counts per referring table, field, month and cause, direct and inherited apart.

        References of records without a creation time are reported under a null month.
        """
        return self.all().groupBy("rec_table", "ref_field", "month", "cause").agg(
            F.count_if(F.col("origin") == "direct").alias("n_direct"),
            F.count_if(F.col("origin") == "inherited").alias("n_inherited"),
            F.max("level").alias("max_level"),
        )


def sized(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows as the side of a join: broadcast if it is few, else never (a file's size says little about its rows)."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")


class _Edges:
    """The edges that are left: a table bucketed by target, and the edges of dominant targets."""

    def __init__(self, edges: DataFrame, n: int, many: bool, scratch: Scratch):
        self.scratch, self.spark, self.many = scratch, edges.sparkSession, many
        # as many as a shuffle has partitions, so that a join needs no other partitioning
        self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        # too few edges for that many files are a plain table, with the same rows
        self.bucketed = n >= self.buckets * BUCKET_ROWS
        self.names: list[str] = []
        self.hot = heavy_keys(edges, "target")
        is_hot = F.col("target").isin(self.hot) if self.hot else F.lit(False)
        self.hot_edges = scratch.table(edges.where(is_hot), "hot-edges") if self.hot else None
        self.left = self._write(edges.where(~is_hot))

    def _write(self, edges: DataFrame) -> DataFrame:
        if not self.bucketed:
            return self.scratch.table(edges, "edges")
        name = f"spanloom_edges_{uuid.uuid4().hex}"
        path = f"{self.scratch.base}/{name}"
        # one file per bucket, not one per task and bucket
        edges.repartition(self.buckets, "target").write.bucketBy(self.buckets, "target").option("path", path).format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def below(self, frontier: DataFrame, n: int) -> DataFrame:
        """``o_node, cause``: records with an edge to one of the ``n`` records of the frontier, once each."""
        out = self.left.join(sized(frontier, n), F.col("target") == F.col("o_node")).select(F.col("node").alias("next"), "cause")
        if self.hot_edges is not None:
            # at most one frontier row per dominant target
            few = F.broadcast(frontier.where(F.col("o_node").isin(self.hot)))
            out = out.unionByName(self.hot_edges.join(few, F.col("target") == F.col("o_node")).select(F.col("node").alias("next"), "cause"))
        if not self.many:
            return out.withColumnRenamed("next", "o_node")
        return out.groupBy(F.col("next").alias("o_node")).agg(F.max("cause").alias("cause"))

    def drop(self, reached: DataFrame) -> None:
        """Leave out the edges of reached records."""
        gone = reached.select(F.col("o_node").alias("r_node"))
        old = self.left
        self.left = self._write(old.join(gone, F.col("node") == F.col("r_node"), "left_anti"))
        if self.hot_edges is not None:
            kept = self.scratch.table(self.hot_edges.join(gone, F.col("node") == F.col("r_node"), "left_anti"), "hot-edges")
            self.scratch.drop(self.hot_edges)
            self.hot_edges = kept
        if self.bucketed:
            self._forget(self.names.pop(0))
        else:
            self.scratch.drop(old)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.remove(name)

    def close(self) -> None:
        while self.names:
            self._forget(self.names.pop())


def orphan_cascade(entities: DataFrame, refs: DataFrame, scratch: Scratch) -> OrphanReport:
    """Find broken references and everything that hangs below them, over any number of tables and fields.

    entities: ``e_node`` (unique over all tables, so with its table's prefix), ``e_dead``, ``e_first``,
    ``e_refers`` (whether records of its table refer to others) - existing records. refs: ``node, id, rec_table, ref_field, target, month, first_seen`` - references
    of existing records, ``node`` and ``target`` named like ``e_node``, null targets left out. A record
    may refer by several fields; it is reached once, at its lowest level, so rings end.

    State of a reference: ``missing`` if no entity has the target; else ``deleted`` if that is
    dead; else ``late`` if the target was first captured after the referring record. Only missing
    and deleted targets orphan a record; a late one exists, so nothing is inherited from it. Of two
    causes at one level ``missing`` counts. Empty inputs give empty reports. Null capture times are
    never late.
    """
    spark = scratch.spark
    refs = scratch.table(refs.where(F.col("target").isNotNull()), "refs")
    state = (
        F.when(F.col("e_node").isNull(), "missing")
        .when(F.coalesce(F.col("e_dead"), F.lit(False)), "deleted")
        .when(F.col("e_first") > F.col("first_seen"), "late")
    )
    judged = skew_join(refs, entities, "target", "e_node", heavy_keys(refs, "target"), "left")
    judged = scratch.table(judged.select(*COLS, state.alias("state"), F.coalesce("e_refers", F.lit(False)).alias("inner")), "judged")
    direct = judged.where(F.col("state").isNotNull())
    broken, n = scratch.counted(direct.where(F.col("state").isin(*BREAKS)).groupBy(F.col("node").alias("o_node")).agg(F.max("state").alias("cause")), "broken")
    # broken records are orphans already; a target that refers no further can't be one below another
    walked = judged.where("inner and (state is null or state = 'late')").join(sized(broken, n), F.col("node") == F.col("o_node"), "left_anti")
    walked = scratch.table(walked.select(*COLS), "walked")
    n_edges, n_nodes = walked.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    # whether a record has several references that can be walked, so that rounds may meet it again
    many = n_edges > n_nodes
    edges = _Edges(walked.select("node", "target"), n_edges, many, scratch)
    levels = f"{scratch.base}/levels"
    read = lambda path: spark.read.schema("o_node string, cause string, level int").option("basePath", levels).parquet(path)
    level, frontier, reached, dropped = 0, broken, 0, 0
    while True:
        level += 1
        nxt = edges.below(frontier, n)
        if many and level > 1:
            # records with several references may be met again
            seen_before = read(levels).select(F.col("o_node").alias("v_node"))
            nxt = nxt.join(seen_before, F.col("o_node") == F.col("v_node"), "left_anti")
        count = Observation()
        nxt.observe(count, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{levels}/level={level}")
        n = count.get["n"]
        if not n:
            break
        reached += n
        frontier = read(f"{levels}/level={level}")
        if reached - dropped > (n_edges - dropped) / 2:
            edges.drop(read(levels))
            dropped = reached
    edges.close()
    found = read(levels)
    inherited = walked.join(found, F.col("node") == F.col("o_node"))
    if many:
        # of several references of a reached record those to orphans
        orphans = broken.select("o_node").union(found.select("o_node")).select(F.col("o_node").alias("t_node"))
        inherited = inherited.join(orphans, F.col("target") == F.col("t_node"), "left_semi")
    inherited = inherited.select(*COLS, F.lit("inherited").alias("state"), F.lit("inherited").alias("origin"), "level", "cause")
    return OrphanReport(direct.select(*COLS, "state", F.lit("direct").alias("origin"), F.lit(0).alias("level"), F.col("state").alias("cause")), inherited)


def forum_orphans(comments: DataFrame, posts: DataFrame) -> OrphanReport:
    """The cascade over comments and posts: ``link_id`` names posts, ``parent_id`` posts or comments.

    References are those of each comment's current row; null or blank ones are no references. A
    ``parent_id`` without a known kind prefix names no table's record and is ``missing``. Columns
    other than the schema's are ignored, rows with a null id too.
    """
    scratch = Scratch(comments.sparkSession, "orphans")
    body, text = F.col("body"), F.trim(F.col("selftext"))
    cur = scratch.table(
        current_rows(
            comments,
            {
                "link": link_key("link_id"),
                "parent": parent_ref("parent_id"),
                "dead": body.isNull() | body.isin(*DEAD_COMMENT),
                "created": F.col("created_utc"),
            },
        ),
        "comments",
    )
    seen = current_rows(posts, {"dead": F.coalesce(text.isin(*DEAD_POST), F.lit(False))})
    entity = lambda df, kind, refers: df.select(F.concat(F.lit(kind), "id").alias("e_node"), F.col("dead").alias("e_dead"), F.col("first_seen").alias("e_first"), F.lit(refers).alias("e_refers"))
    entities = scratch.table(entity(seen, "t3_", False).unionByName(entity(cur, "t1_", True)), "entities")

    def refs(field: str, target: Column) -> DataFrame:
        return cur.select(F.concat(F.lit("t1_"), "id").alias("node"), "id", F.lit("comments").alias("rec_table"), F.lit(field).alias("ref_field"), target.alias("target"), month_of("created").alias("month"), "first_seen")

    both = refs("link_id", F.concat(F.lit("t3_"), "link")).unionByName(refs("parent_id", F.col("parent")))
    return orphan_cascade(entities, both, scratch)
