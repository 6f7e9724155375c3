"""The domain's relations over the input tables, for Spark, and the same relations in SQL.

Each relation is a function here and a named query in ``VIEWS``; ``sql(body, ...)`` puts the named
queries that a statement needs before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.captures import current_rows
from ..schema import CAUSES, DROP_CAUSE, EMOTIONS, VALENCE
from .tables import table

CUR = ["created_utc", "link_id", "parent_id", "author", "score", "body"]


def comments(spark: SparkSession, d: str) -> DataFrame:
    """Current comments with missing texts as '' and a position that doesn't depend on storage."""
    cur = current_rows(table(spark, d, "comments"), {c: F.col(c) for c in CUR})
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return cur.select("id", "created_utc", F.trim(blank("link_id")).alias("link_id"), F.trim(blank("parent_id")).alias("parent_id"), blank("author").alias("author"), "score", blank("body").alias("body"), T.text_pos("id").alias("pos"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    fields = ["created_utc", "title", "selftext", "is_self", "num_comments", "score"]
    cur = current_rows(table(spark, d, "posts"), {c: F.col(c) for c in fields})
    return cur.select("id", "created_utc", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("selftext", F.lit("")).alias("selftext"), F.when(F.coalesce("is_self", F.lit(0)) != 0, 1).otherwise(0).alias("is_self"), "num_comments", "score")


def labels(spark: SparkSession, d: str) -> DataFrame:
    """The newest label per comment and annotator; no pairs for null."""
    raw = table(spark, d, "labels")
    rows = raw.select("comment_id", F.nullif(F.upper(F.trim("annotator")), F.lit("")).alias("annotator"), "neutral", F.coalesce("pairs", F.array().cast(raw.schema["pairs"].dataType)).alias("pairs"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
    rows = rows.where("comment_id is not null and annotator is not null")
    return rows.groupBy("comment_id", "annotator").agg(F.max(F.struct("updated_at", "neutral", "pairs")).alias("m")).select("comment_id", "annotator", "m.neutral", "m.pairs", "m.updated_at")


def coded(spark: SparkSession, d: str, a: str = "A", b: str = "B") -> DataFrame:
    """Comments that two annotators labelled: ``comment_id, na, pa, nb, pb``."""
    lab = labels(spark, d)
    side = lambda who, n, p: lab.where(F.col("annotator") == who).select("comment_id", (F.size("pairs") == 0).alias(n), F.col("pairs").alias(p))
    return side(a, "na", "pa").join(side(b, "nb", "pb"), "comment_id")


def items(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """Comments with the texts of their post and their parent comment; ``only`` those with an ``id`` of the given ones."""
    c, p = comments(spark, d), posts(spark, d)
    parent = c.select(F.col("id").alias("par_id"), F.nullif(F.left("body", F.lit(10000)), F.lit("")).alias("parent_body"))
    post = p.select(F.col("id").alias("post_id"), F.nullif("title", F.lit("")).alias("post_title"), F.nullif(F.left("selftext", F.lit(40000)), F.lit("")).alias("post_selftext"), (F.col("is_self") == 1).alias("post_is_self"))
    c = c if only is None else c.join(only.select("id"), "id", "left_semi")
    c = c.withColumn("post_key", T.strip_kind("link_id")).withColumn("par_key", F.when(F.col("parent_id").startswith("t1_"), T.strip_kind("parent_id")))
    return c.join(post, F.col("post_key") == F.col("post_id"), "left").join(parent, F.col("par_key") == F.col("par_id"), "left").drop("post_key", "par_key", "par_id", "post_id")


def flat_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pair rows ``cid, ts, day, emotion, cause, intensity, sarcasm, valence``: order lines as labelled pairs."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    j = li.select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_returnflag", "l_shipdate").join(part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = j.select(
        F.col("l_orderkey").alias("cid"),
        F.col("l_shipdate").alias("ts"),
        F.to_date("l_shipdate").alias("day"),
        pick(EMOTIONS, (F.col("l_linenumber") - 1) % len(EMOTIONS)).alias("emotion"),
        pick(CAUSES, F.col("p_size") % len(CAUSES)).alias("cause"),
        (F.col("l_discount") * 10).alias("intensity"),
        (F.col("l_returnflag") == "R").alias("sarcasm"),
    )
    return rows.withColumn("valence", T.valence(F.col("emotion"), F.col("intensity")))


def market_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pair rows without interpersonal causes; a null cause stays."""
    return flat_pairs(spark, d).where(F.coalesce("cause", F.lit("")) != DROP_CAUSE)


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Daily closes ``day, ticker, close``: mean order value per priority."""
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("ticker")).agg(F.avg("o_totalprice").alias("close"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SIGN = " ".join(f"WHEN '{e}' THEN {v}" for e, v in VALENCE.items())

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "c": ((), """SELECT id, created_utc, trim(coalesce(link_id, '')) AS link_id, trim(coalesce(parent_id, '')) AS parent_id, coalesce(author, '') AS author, score, coalesce(body, '') AS body,
        ('0x' || substr(md5(id), 1, 7))::BIGINT AS pos
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY retrieved_on DESC) AS rn FROM comments WHERE id IS NOT NULL) WHERE rn = 1"""),
    "p": ((), """SELECT id, created_utc, coalesce(title, '') AS title, coalesce(selftext, '') AS selftext, CASE WHEN coalesce(is_self, 0) <> 0 THEN 1 ELSE 0 END AS is_self, num_comments, score
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY retrieved_on DESC) AS rn FROM posts WHERE id IS NOT NULL) WHERE rn = 1"""),
    "lab": ((), """SELECT comment_id, annotator, neutral, coalesce(pairs, []) AS pairs, updated_at FROM (
        SELECT comment_id, nullif(upper(trim(annotator)), '') AS annotator, neutral, pairs, updated_at,
               row_number() OVER (PARTITION BY comment_id, upper(trim(annotator)) ORDER BY updated_at DESC NULLS LAST) AS rn
        FROM labels WHERE comment_id IS NOT NULL) WHERE rn = 1 AND annotator IS NOT NULL"""),
    "ab": (("lab",), "SELECT a.comment_id, len(a.pairs) = 0 AS na, a.pairs AS pa, len(b.pairs) = 0 AS nb, b.pairs AS pb FROM lab a JOIN lab b ON a.comment_id = b.comment_id AND a.annotator = 'A' AND b.annotator = 'B'"),
    "item": (("c", "p"), """SELECT c.*, nullif(p.title, '') AS post_title, nullif(substr(p.selftext, 1, 40000), '') AS post_selftext, p.is_self = 1 AS post_is_self, nullif(substr(q.body, 1, 10000), '') AS parent_body
        FROM c LEFT JOIN p ON regexp_replace(c.link_id, '^[^_]*_', '') = p.id
        LEFT JOIN c q ON starts_with(c.parent_id, 't1_') AND regexp_replace(c.parent_id, '^[^_]*_', '') = q.id"""),
    "pr0": ((), f"""SELECT *, CASE emotion {_SIGN} ELSE 0 END * intensity AS valence FROM (
        SELECT l_orderkey AS cid, l_shipdate AS ts, l_shipdate::DATE AS day, {_sql_list(EMOTIONS)}[(l_linenumber - 1) % {len(EMOTIONS)} + 1] AS emotion,
               {_sql_list(CAUSES)}[p_size % {len(CAUSES)} + 1] AS cause, l_discount * 10 AS intensity, l_returnflag = 'R' AS sarcasm
        FROM lineitem JOIN part ON l_partkey = p_partkey)"""),
    "pr": (("pr0",), "SELECT * FROM pr0 WHERE coalesce(cause, '') <> 'interpersonal'"),
    "px": ((), "SELECT o_orderdate::DATE AS day, o_orderpriority AS ticker, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2"),
}


def sql(body: str, *views: str) -> str:
    """``body`` after the named relations it needs and those that they need."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for dep in VIEWS[name][0]:
                add(dep)
            done.append(name)

    for v in views:
        add(v)
    head = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in done)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {head},\n{body[5:]}" if head else f"WITH RECURSIVE {body[5:]}"
    return f"WITH RECURSIVE {head}\n{body}" if head else body


# SQL forms of the text functions. The references that occur in the tables; the ampersand comes last.
_ENTITIES = (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&GT;", ">"), ("&LT;", "<"), ("&QUOT;", '"'), ("&AMP;", "&"), ("&amp;", "&"))


def norm_sql(x: str) -> str:
    out = f"coalesce({x}, '')"
    for a, b in _ENTITIES:
        out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    frm, to = T.FOLD_FROM.replace("'", "''"), T.FOLD_TO.replace("'", "''")
    out = f"replace(translate(replace({out}, '\\', ''), '{frm}', '{to}'), '…', '...')"
    return f"replace(lower(trim(regexp_replace({out}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


def span_in_sql(s: str, t: str) -> str:
    return f"CASE WHEN coalesce({s}, '') = '' OR coalesce({t}, '') = '' THEN FALSE ELSE contains({norm_sql(t)}, {norm_sql(s)}) END"


EDGE_SQL = T.EDGE.replace("'", "''")


def tokens_sql(x: str, edge: bool = True) -> str:
    words = f"string_split({norm_sql(x)}, ' ')"
    if edge:
        words = f"list_transform({words}, lambda w: trim(w, '{EDGE_SQL}'))"
    return f"list_distinct(list_filter({words}, lambda w: w <> ''))"


def iou_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def containment_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"


def week_sql(day: str) -> str:
    return f"(date_trunc('week', {day} + INTERVAL 2 DAY)::DATE + 4)"
