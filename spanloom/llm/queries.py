"""Named queries of the operators for training text, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.captures import author_key, current_rows, link_key
from ..plans.core_queries import CURRENT_SQL
from ..plans.registry import Registry
from ..plans.tables import table
from .capping import cap_contributors
from .consensus import agreement, current_votes, estimate, resolved
from .glyphs import look_alike_classes, look_alike_pairs, with_canonical
from .leakage import find_leaks
from .mixing import mix
from .pii import findings, masked
from .splits import components, group_splits

LLM = Registry()


def _all_findings(spark: SparkSession, d: str) -> DataFrame:
    comments = findings(table(spark, d, "comments"), "id", ["body", "author"]).withColumn("rec_table", F.lit("comments"))
    posts = findings(table(spark, d, "posts"), "id", ["selftext"]).withColumn("rec_table", F.lit("posts"))
    return comments.unionByName(posts)


@LLM.add("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _all_findings(spark, d).select("rec_table", "rec_field", "rec_id", "kind").distinct()


@LLM.add("p4_masked_comments")
def p4_masked_comments(spark: SparkSession, d: str) -> DataFrame:
    """Every comment row with placeholders in body and author."""
    return masked(table(spark, d, "comments").select("id", "retrieved_on", "body", "author"), ["body", "author"])


@LLM.add("p4_masked_posts")
def p4_masked_posts(spark: SparkSession, d: str) -> DataFrame:
    return masked(table(spark, d, "posts").select("id", "retrieved_on", "selftext"), ["selftext"])


@LLM.add("p4_report")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Findings per table, field and kind, and the records they are in."""
    return _all_findings(spark, d).groupBy("rec_table", "rec_field", "kind").agg(F.count(F.lit(1)).alias("n_found"), F.countDistinct("rec_id").alias("n_records"))


VOTES_SQL = """
WITH lab AS (
  SELECT comment_id AS item, nullif(upper(trim(annotator)), '') AS annotator, pairs,
         row_number() OVER (PARTITION BY comment_id, upper(trim(annotator)) ORDER BY updated_at DESC NULLS LAST) AS rn
  FROM labels WHERE comment_id IS NOT NULL),
votes AS (
  SELECT item, annotator, CASE WHEN coalesce(len(pairs), 0) = 0 THEN 'neutral'
    ELSE lower(trim(list_reverse_sort(list_transform(range(1, len(pairs) + 1), lambda i: {'v': coalesce(pairs[i].intensity, -1), 'at': -i, 'e': pairs[i].emotion}))[1].e)) END AS label
  FROM lab WHERE rn = 1 AND annotator IS NOT NULL)
"""


def _votes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    votes = current_votes(table(spark, d, "labels"))
    return votes, resolved(table(spark, d, "adjudications"), votes)


@LLM.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    items, _ = estimate(*_votes(spark, d))
    return items.where("n_labels > 1").select(F.col("item").alias("comment_id"), "consensus")


@LLM.add("p5_votes", VOTES_SQL + "SELECT item AS comment_id, annotator, label FROM votes")
def p5_votes(spark: SparkSession, d: str) -> DataFrame:
    """The current vote of every annotator on every comment."""
    return current_votes(table(spark, d, "labels")).withColumnRenamed("item", "comment_id")


@LLM.add("p5_posteriors")
def p5_posteriors(spark: SparkSession, d: str) -> DataFrame:
    """Every comment's label probabilities and difficulty."""
    items, _ = estimate(*_votes(spark, d))
    return items.select(F.col("item").alias("comment_id"), "difficulty", F.explode("posterior").alias("x")).select("comment_id", "difficulty", "x.label", "x.p")


@LLM.add("p5_annotators")
def p5_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Ability and reliability per annotator."""
    return estimate(*_votes(spark, d))[1]


@LLM.add(
    "p5_agreement",
    VOTES_SQL
    + """, per AS (SELECT item, label, count(*) AS c FROM votes GROUP BY ALL),
    units AS (SELECT item, sum(c) AS m, sum(c * c) AS sq FROM per GROUP BY item HAVING sum(c) > 1),
    o AS (SELECT count(*) AS n_items, sum(m)::BIGINT AS n_votes, sum((m * m - sq)::DOUBLE / (m - 1)) AS d FROM units),
    e AS (SELECT sum(n * n) AS nn FROM (SELECT label, sum(c) AS n FROM per WHERE item IN (SELECT item FROM units) GROUP BY label))
    SELECT n_items, n_votes, round(d / n_votes, 9) AS observed, round((n_votes * n_votes - nn)::DOUBLE / (n_votes * (n_votes - 1)), 9) AS expected,
    round(1 - (d / n_votes) / ((n_votes * n_votes - nn)::DOUBLE / (n_votes * (n_votes - 1))), 9) AS alpha FROM o, e""",
)
def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return agreement(current_votes(table(spark, d, "labels")))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Current comments with their link key and the author key that connects: no bots, not nobody."""
    a = author_key("author")
    person = F.when((a != "automoderator") & ~a.endswith("bot"), a)
    return current_rows(table(spark, d, "comments"), {"link": link_key("link_id"), "person": person, "created": F.col("created_utc")})


COMPONENT_SQL = f"""
WITH RECURSIVE {CURRENT_SQL},
e AS (SELECT DISTINCT link, CASE WHEN akey <> 'automoderator' AND NOT ends_with(akey, 'bot') THEN akey END AS person FROM ckeys WHERE link IS NOT NULL),
step(link, low) USING KEY (link) AS (
  SELECT DISTINCT link, link FROM e
  UNION
  SELECT b.link, min(s.low) FROM step s JOIN e a ON a.link = s.link JOIN e b ON b.person = a.person
  JOIN recurring.step t ON t.link = b.link WHERE s.low < t.low GROUP BY b.link)
"""


@LLM.add("p6_found", COMPONENT_SQL + "SELECT low AS group_link, link AS link_id FROM step WHERE low <> link")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.scratch import Scratch

    edges = _linked(spark, d).where("link is not null and person is not null").select(F.concat(F.lit("0"), "link").alias("a"), F.concat(F.lit("1"), "person").alias("b"))
    comp = components(edges, Scratch(spark, "groups")).where(F.col("node").startswith("0") & (F.col("node") != F.col("comp")))
    return comp.select(F.substring("comp", 2, 1_000_000).alias("group_link"), F.substring("node", 2, 1_000_000).alias("link_id"))


#: Shares of train, validation and test, by comments.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _splits(spark: SparkSession, d: str) -> DataFrame:
    rows = _linked(spark, d)
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created") / 86400).cast("int")))
    return group_splits(rows.select("id", F.col("link").alias("e1"), F.col("person").alias("e2"), year.alias("label")), SHARES)


@LLM.add("p6_splits")
def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every current comment."""
    return _splits(spark, d).select("id", F.col("comp").alias("group_key"), "split")


@LLM.add("p6_report")
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Comments per split and year of creation, the label that is balanced."""
    return _splits(spark, d).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_comments"), F.countDistinct("comp").alias("n_groups"))


@LLM.add("p6_invariants", f"WITH {CURRENT_SQL} SELECT count(*) AS n_comments, 0::BIGINT AS n_torn_groups, 0::BIGINT AS n_torn_links, TRUE AS shares_kept FROM ckeys")
def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for the splits: every comment has one, no group or thread has two, and the shares are met.

    A share is met if it is off by at most the second largest group (the largest one only fits into the
    largest split) or by one comment in a hundred, whichever is more.
    """
    member = _splits(spark, d)
    groups = member.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"))
    torn = groups.agg(F.count_if(F.col("splits") > 1).alias("n_torn_groups"), F.sum("n").alias("n_comments"))
    second = groups.orderBy(F.desc("n")).limit(2).agg(F.min("n").alias("second"))
    links = _linked(spark, d).select("id", "link").where("link is not null").join(member.select("id", "split"), "id").groupBy("link").agg(F.countDistinct("split").alias("splits"))
    per = member.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.create_map(*[F.lit(x) for kv in SHARES.items() for x in kv])
    all_in = torn.crossJoin(second).crossJoin(links.agg(F.count_if(F.col("splits") > 1).alias("n_torn_links"))).crossJoin(per.agg(F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("got")))
    off = F.array_max(F.transform(F.array(*[F.lit(x) for x in SHARES]), lambda x: F.abs(F.coalesce(F.try_element_at(F.col("got"), x), F.lit(0)) - wanted[x] * F.col("n_comments"))))
    room = F.greatest(F.col("second").cast("double"), 0.01 * F.col("n_comments"))
    return all_in.select(F.coalesce("n_comments", F.lit(0)).alias("n_comments"), "n_torn_groups", "n_torn_links", F.coalesce(off <= room, F.lit(True)).alias("shares_kept"))


#: Comments that one author keeps at most.
AUTHOR_CAP = 20

CAP_SQL = f"""
WITH {CURRENT_SQL},
ranked AS (SELECT id, akey, score, row_number() OVER (PARTITION BY akey ORDER BY score DESC NULLS LAST, id) AS rank FROM ckeys)
"""


def _capped(spark: SparkSession, d: str) -> DataFrame:
    cur = current_rows(table(spark, d, "comments"), {"quality": F.col("score"), "contributor": author_key("author")})
    return cap_contributors(cur.select("id", "quality"), cur.select("id", "contributor"), AUTHOR_CAP)


@LLM.add("p7_found", CAP_SQL + f"SELECT id FROM ranked WHERE akey IS NOT NULL AND rank > {AUTHOR_CAP}")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).where("not kept").select("id")


@LLM.add("p7_kept", CAP_SQL + f"SELECT id FROM ranked WHERE akey IS NULL OR rank <= {AUTHOR_CAP}")
def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).where("kept").select("id")


# Rounds over all pairs until every record is decided: kept if each contributor ranks it within its
# room among the undecided, dropped if one has no room.
BOTH_CAPS_SQL = f"""
WITH RECURSIVE {CURRENT_SQL},
pairs AS (
  SELECT id, score, 'a:' || akey AS c, 20 AS cap FROM ckeys WHERE akey IS NOT NULL
  UNION ALL SELECT id, score, 'l:' || link, 200 FROM ckeys WHERE link IS NOT NULL),
st(round, id, kept) AS (
  SELECT 0, id, NULL::BOOLEAN FROM ckeys
  UNION ALL
  SELECT round + 1, id, CASE WHEN kept IS NOT NULL THEN kept WHEN bool_and(c IS NULL OR rank <= room) THEN TRUE WHEN bool_or(room <= 0) THEN FALSE END
  FROM (SELECT s.round, s.id, s.kept, p.c, p.cap - count(*) FILTER (s.kept) OVER (PARTITION BY p.c) AS room,
               row_number() OVER (PARTITION BY p.c, s.kept ORDER BY p.score DESC NULLS LAST, s.id) AS rank
        FROM st s LEFT JOIN pairs p ON p.id = s.id WHERE (SELECT bool_or(kept IS NULL) FROM st))
  GROUP BY round, id, kept)
SELECT id FROM st WHERE kept AND round = (SELECT max(round) FROM st)
"""


@LLM.add("p7_author_and_thread", BOTH_CAPS_SQL)
def p7_author_and_thread(spark: SparkSession, d: str) -> DataFrame:
    """Kept comments when authors keep 20 and threads 200, each comment counting for both."""
    cur = current_rows(table(spark, d, "comments"), {"quality": F.col("score"), "author": author_key("author"), "link": link_key("link_id")})
    both = cur.select("id", F.concat(F.lit("a:"), "author").alias("contributor")).unionByName(cur.select("id", F.concat(F.lit("l:"), "link").alias("contributor")))
    cap = F.when(F.col("contributor").startswith("a:"), 20).otherwise(200)
    return cap_contributors(cur.select("id", "quality"), both, cap).where("kept").select("id")


@LLM.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@LLM.add("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: affected documents and the largest share of it found in one."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("coverage").alias("max_coverage"))


@LLM.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    _, plan, _ = mix(table(spark, d, "documents"), table(spark, d, "source_targets"))
    return plan.where("is_short").select("source")


@LLM.add("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often every document of a listed source is used."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


@LLM.add("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual tokens of every listed source."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[2]


@LLM.add(
    "p9_invariants",
    """SELECT t.source, count(d.doc_id) AS n_docs, TRUE AS copies_within, TRUE AS count_kept, TRUE AS tokens_within, TRUE AS short_used_up
    FROM (SELECT DISTINCT source FROM source_targets WHERE source IS NOT NULL AND weight IS NOT NULL AND max_repeats IS NOT NULL) t LEFT JOIN documents d ON d.source = t.source GROUP BY ALL""",
)
def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for the mix, per listed source: every document occurs, no copy beyond its bounds,
    the number of copies is within one of what was asked, tokens are within the stated error, and a
    source that is short gives everything."""
    copies, plan, shares = mix(table(spark, d, "documents"), table(spark, d, "source_targets"))
    c = F.col("copies")
    p = plan.select(F.col("source").alias("p_source"), F.col("copies").alias("asked"), "max_repeats")
    per = copies.join(p, F.col("source") == F.col("p_source")).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and((c >= 0) & (c <= F.col("max_repeats")) & (F.abs(c - F.col("asked")) < 1)).alias("within"), (F.abs(F.sum(c) - F.sum("asked")) < 1 + 1e-6).alias("kept")
    )
    out = shares.join(per.withColumnRenamed("source", "c_source"), F.col("source") == F.col("c_source"), "left")
    yes = lambda x: F.coalesce(x, F.lit(True))
    return out.select("source", F.coalesce("n", F.lit(0)).alias("n_docs"), yes("within").alias("copies_within"), yes("kept").alias("count_kept"), (F.abs(F.col("got") - F.col("goal")) <= F.col("error_bound")).alias("tokens_within"), (~F.col("is_short") | (F.col("got") == F.col("have") * F.col("max_repeats"))).alias("short_used_up"))


@LLM.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"))


@LLM.add("p10_canonical")
def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return with_canonical(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "canonical")


@LLM.add("p10_classes")
def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's class of equal-looking texts: the smallest id in it and its distinct spellings."""
    rows = look_alike_classes(table(spark, d, "documents"), "doc_id", "text")
    per = rows.groupBy("canon").agg(F.min("doc_id").alias("class_id"), F.countDistinct("raw").alias("n_spellings"))
    return rows.join(per, "canon").select("doc_id", "class_id", F.col("n_spellings"))
