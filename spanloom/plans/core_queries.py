"""Queries of the general operators: orphan references, dominant keys, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.captures import current_rows, link_key
from ..operators.hierarchy import comment_forest, descendants
from ..operators.orphans import forum_orphans
from ..operators.skew import heavy_keys, keyed_aggregate, keyed_top, skew_join
from .registry import Registry
from .tables import table

CORE = Registry()

#: Share of all capture rows from which a thread counts as dominant.
DOMINANT_SHARE = 0.02

CURRENT_SQL = """
cur AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, min(retrieved_on) OVER (PARTITION BY id) AS first_seen,
           row_number() OVER (PARTITION BY id ORDER BY retrieved_on DESC) AS rn
    FROM comments WHERE id IS NOT NULL) WHERE rn = 1),
pcur AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, min(retrieved_on) OVER (PARTITION BY id) AS first_seen,
           row_number() OVER (PARTITION BY id ORDER BY retrieved_on DESC) AS rn
    FROM posts WHERE id IS NOT NULL) WHERE rn = 1),
ckeys AS (
  SELECT *, nullif(regexp_replace(trim(link_id), '^t3_', ''), '') AS link,
         nullif(trim(parent_id), '') AS parent,
         nullif(nullif(lower(trim(author)), ''), '[deleted]') AS akey
  FROM cur)
"""

ORPHAN_SQL = f"""
WITH RECURSIVE {CURRENT_SQL},
ent AS (
  SELECT 't3_' || id AS node, coalesce(trim(selftext) IN ('[deleted]', '[removed]'), FALSE) AS dead, first_seen FROM pcur
  UNION ALL
  SELECT 't1_' || id, body IS NULL OR body IN ('', '[deleted]', '[removed]'), first_seen FROM cur),
refs AS (
  SELECT id, 'link_id' AS ref_field, 't3_' || link AS target, created_utc, first_seen FROM ckeys WHERE link IS NOT NULL
  UNION ALL
  SELECT id, 'parent_id', parent, created_utc, first_seen FROM ckeys WHERE parent IS NOT NULL),
judged AS (
  SELECT r.*, CASE WHEN e.node IS NULL THEN 'missing' WHEN e.dead THEN 'deleted'
                   WHEN e.first_seen > r.first_seen THEN 'late' END AS state
  FROM refs r LEFT JOIN ent e ON r.target = e.node),
direct AS (SELECT * FROM judged WHERE state IS NOT NULL),
broken AS (SELECT id, max(state) AS cause FROM direct WHERE state <> 'late' GROUP BY id),
below AS (
  SELECT id, 0 AS level, cause FROM broken
  UNION ALL
  SELECT r.id, b.level + 1, b.cause FROM refs r JOIN below b ON r.ref_field = 'parent_id' AND r.target = 't1_' || b.id
  WHERE r.id NOT IN (SELECT id FROM broken)),
report AS (
  SELECT id, ref_field, target, created_utc, state, 'direct' AS origin, 0 AS level, state AS cause FROM direct
  UNION ALL
  SELECT r.id, r.ref_field, r.target, r.created_utc, 'inherited', 'inherited', b.level, b.cause
  FROM below b JOIN refs r ON r.id = b.id AND r.ref_field = 'parent_id' WHERE b.level > 0)
"""


@CORE.add("p1_found", ORPHAN_SQL + "SELECT id, ref_field, state FROM report WHERE origin = 'direct'")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = forum_orphans(table(spark, d, "comments"), table(spark, d, "posts")).all()
    return found.where(F.col("origin") == "direct").select("id", "ref_field", "state")


@CORE.add("p1_cascade", ORPHAN_SQL + "SELECT id, ref_field, target, state, origin, level, cause FROM report")
def p1_cascade(spark: SparkSession, d: str) -> DataFrame:
    return forum_orphans(table(spark, d, "comments"), table(spark, d, "posts")).all().select("id", "ref_field", "target", "state", "origin", "level", "cause")


@CORE.add(
    "p1_report",
    ORPHAN_SQL
    + """SELECT 'comments' AS rec_table, ref_field,
    strftime(make_timestamp(created_utc * 1000000), '%Y-%m') AS month, cause,
    count(*) FILTER (origin = 'direct') AS n_direct, count(*) FILTER (origin = 'inherited') AS n_inherited, max(level) AS max_level
    FROM report GROUP BY ALL""",
)
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return forum_orphans(table(spark, d, "comments"), table(spark, d, "posts")).by_period()


THREAD_ROWS_SQL = "WITH c AS (SELECT *, nullif(regexp_replace(trim(link_id), '^t3_', ''), '') AS link FROM comments) "


def _thread_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "comments")
    return c.select(link_key("link_id").alias("link_id"), "id", "score", "created_utc", "retrieved_on")


def _thread_stats(rows: DataFrame, heavy: list | None = None) -> DataFrame:
    """Per-thread counts and sums over all captures; rows without a link key belong to no thread."""
    return keyed_aggregate(
        rows,
        "link_id",
        {"n_rows": F.count(F.lit(1)), "score_sum": F.sum("score"), "first_utc": F.min("created_utc"), "last_utc": F.max("created_utc")},
        {"n_rows": F.sum("n_rows"), "score_sum": F.sum("score_sum"), "first_utc": F.min("first_utc"), "last_utc": F.max("last_utc")},
        salt_on=["id", "retrieved_on"],
        heavy=heavy,
    )


@CORE.add("p2_found", f"{THREAD_ROWS_SQL}SELECT link AS link_id FROM c WHERE link IS NOT NULL GROUP BY 1 HAVING count(*) >= {DOMINANT_SHARE} * (SELECT count(*) FROM comments)")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Threads that hold at least 2 % of all capture rows: all threads counted exactly, heavy ones in their own way."""
    rows = _thread_rows(spark, d)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    per = _thread_stats(rows, heavy_keys(rows, "link_id", DOMINANT_SHARE))
    return per.crossJoin(F.broadcast(total)).where(F.col("n_rows") >= DOMINANT_SHARE * F.col("total")).select("link_id")


@CORE.add("p2_thread_stats", f"{THREAD_ROWS_SQL}SELECT link AS link_id, count(*) AS n_rows, sum(score)::BIGINT AS score_sum, min(created_utc) AS first_utc, max(created_utc) AS last_utc FROM c WHERE link IS NOT NULL GROUP BY 1")
def p2_thread_stats(spark: SparkSession, d: str) -> DataFrame:
    return _thread_stats(_thread_rows(spark, d)).drop("is_heavy")


@CORE.add(
    "p2_latest",
    f"""WITH {CURRENT_SQL} SELECT link AS link_id, id, created_utc, rank FROM (
    SELECT link, id, created_utc, row_number() OVER (PARTITION BY link ORDER BY created_utc DESC NULLS LAST, id) AS rank
    FROM ckeys WHERE link IS NOT NULL) WHERE rank <= 3""",
)
def p2_latest(spark: SparkSession, d: str) -> DataFrame:
    """The three latest comments of every thread, current rows; unknown times last, ties by id."""
    cur = current_rows(table(spark, d, "comments"), {"link_id": link_key("link_id"), "created_utc": F.col("created_utc")})
    return keyed_top(cur, "link_id", [F.col("created_utc").desc_nulls_last(), F.col("id")], 3, salt_on=["id"]).select("link_id", "id", "created_utc", "rank")


@CORE.add(
    "p2_with_post",
    f"WITH {CURRENT_SQL} SELECT c.id, c.link AS link_id, p.num_comments AS post_comments, p.score AS post_score FROM ckeys c LEFT JOIN pcur p ON c.link = p.id",
)
def p2_with_post(spark: SparkSession, d: str) -> DataFrame:
    """Every current comment with its post's current figures; heavy threads meet a broadcast."""
    cur = current_rows(table(spark, d, "comments"), {"link_id": link_key("link_id")}).drop("first_seen")
    posts = current_rows(table(spark, d, "posts"), {"post_comments": F.col("num_comments"), "post_score": F.col("score")}).select(F.col("id").alias("post_id"), "post_comments", "post_score")
    return skew_join(cur, posts, "link_id", "post_id", heavy_keys(cur, "link_id"), "left").select("id", "link_id", "post_comments", "post_score")


FOREST_SQL = f"""
WITH RECURSIVE {CURRENT_SQL},
node AS (
  SELECT id, parent, starts_with(parent, 't1_') IS TRUE AS is_reply, CASE WHEN starts_with(parent, 't1_') THEN substr(parent, 4) END AS pid FROM ckeys),
link AS (SELECT n.*, (p.id IS NOT NULL) AS inner_node FROM node n LEFT JOIN node p ON n.pid = p.id),
down AS (
  SELECT id, coalesce(parent, 't1_' || id) AS root, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth,
         CASE WHEN parent IS NULL THEN '' ELSE parent END AS path
  FROM link WHERE NOT inner_node
  UNION ALL
  SELECT l.id, d.root, d.depth + 1, CASE WHEN d.path = '' THEN d.id ELSE d.id || '>' || d.path END FROM link l JOIN down d ON l.inner_node AND l.pid = d.id),
forest AS (
  SELECT n.id, n.is_reply, coalesce(d.root, 'cycle') AS root, coalesce(d.depth, -1)::INT AS depth, d.path FROM node n LEFT JOIN down d ON n.id = d.id)
"""


@CORE.add("p3_found", FOREST_SQL + "SELECT id, root, depth FROM forest WHERE is_reply")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return comment_forest(table(spark, d, "comments")).where("is_reply").select("id", "root", "depth")


@CORE.add("p3_paths", FOREST_SQL + "SELECT id, root, depth, path FROM forest")
def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every comment's path to its root, nearest first; null in and above rings."""
    return comment_forest(table(spark, d, "comments"), paths=True).select("id", "root", "depth", F.array_join("path", ">").alias("path"))


@CORE.add(
    "p3_descendants",
    FOREST_SQL
    + """, anc AS (SELECT l.pid AS id, l.id AS descendant, 1 AS distance FROM link l JOIN down d ON d.id = l.id WHERE l.inner_node
    UNION ALL SELECT l.pid, a.descendant, a.distance + 1 FROM anc a JOIN link l ON l.id = a.id WHERE l.inner_node)
    SELECT id, descendant, distance::INT AS distance FROM anc""",
)
def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(comment_forest(table(spark, d, "comments"), paths=True))
