"""Queries of the text functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..schema import EMOTIONS, PAIR_FIELDS
from . import bindings as B
from .bindings import containment_sql, iou_sql, norm_sql, span_in_sql, sql, tokens_sql, week_sql
from .registry import Registry
from .tables import table

TEXT = Registry()


def q(name: str, body: str, *views: str):
    return TEXT.add(name, sql(body, *views))


def _ab_spans(spark, d):
    """Pairs of emotion spans of two annotators, by position."""
    ab = B.coded(spark, d)
    return ab.select("comment_id", F.posexplode(F.arrays_zip("pa", "pb"))).select("comment_id", F.col("pos").alias("i"), F.col("col.pa.emotion_span").alias("a"), F.col("col.pb.emotion_span").alias("b"))


SPANS = "WITH s AS (SELECT comment_id, i - 1 AS i, pa[i].emotion_span AS a, pb[i].emotion_span AS b FROM (SELECT *, unnest(range(1, greatest(len(pa), len(pb)) + 1)) AS i FROM ab))"

q("fn01_normalize", f"SELECT id, {norm_sql('body')} AS norm FROM c", "c")(lambda s, d: B.comments(s, d).select("id", T.normalize("body").alias("norm")))

q("fn02_span_in", f"SELECT l.comment_id, l.annotator, l.i, {span_in_sql('l.span', 'c.body')} AS found FROM (SELECT comment_id, annotator, i, pairs[i].emotion_span AS span FROM (SELECT *, unnest(range(1, len(pairs) + 1)) AS i FROM lab)) l JOIN c ON c.id = l.comment_id", "lab", "c")(
    lambda s, d: B.labels(s, d).select("comment_id", "annotator", F.posexplode("pairs")).join(B.comments(s, d).select("id", "body"), F.col("comment_id") == F.col("id")).select("comment_id", "annotator", (F.col("pos") + 1).alias("i"), T.span_in("col.emotion_span", "body").alias("found"))
)

_POST_SQL = "nullif(concat_ws(' ' || chr(10) || ' ', post_title, post_selftext), '')"
_CAUSE_SQL = "(SELECT comment_id, annotator, i, pairs[i].cause_span AS span, pairs[i].cause_source AS said FROM (SELECT *, unnest(range(1, len(pairs) + 1)) AS i FROM lab)) l JOIN item ON item.id = l.comment_id"
_SOURCE_SQL = f"CASE WHEN {span_in_sql('l.span', 'body')} THEN 'comment' WHEN {span_in_sql('l.span', 'parent_body')} THEN 'parent' WHEN {span_in_sql('l.span', _POST_SQL)} THEN 'post' END"


@q("fn03_span_source", f"SELECT comment_id, annotator, i, {_SOURCE_SQL} AS source FROM {_CAUSE_SQL}", "lab", "item")
def fn03(s, d):
    spans = B.labels(s, d).select("comment_id", "annotator", F.posexplode("pairs"))
    it = B.items(s, d).select("id", "body", "parent_body", T.post_text("post_title", "post_selftext").alias("post"))
    return spans.join(it, F.col("comment_id") == F.col("id")).select("comment_id", "annotator", (F.col("pos") + 1).alias("i"), T.span_source(F.col("col.cause_span"), F.col("body"), F.col("parent_body"), F.col("post")).alias("source"))


q("fn04_tokens", f"SELECT id, array_to_string(list_sort({tokens_sql('body')}), ' ') AS toks FROM c", "c")(lambda s, d: B.comments(s, d).select("id", F.array_join(F.array_sort(T.tokens("body")), " ").alias("toks")))
q("misc08_tokens_raw_edges", f"SELECT id, array_to_string(list_sort({tokens_sql('body', False)}), ' ') AS toks FROM c", "c")(lambda s, d: B.comments(s, d).select("id", F.array_join(F.array_sort(T.tokens("body", None)), " ").alias("toks")))
q("fn05_span_iou", f"{SPANS}, t AS (SELECT *, {tokens_sql('a')} AS ta, {tokens_sql('b')} AS tb FROM s) SELECT comment_id, i, round({iou_sql('ta', 'tb')}, 6) AS iou FROM t", "ab")(lambda s, d: _ab_spans(s, d).select("comment_id", "i", F.round(T.span_iou("a", "b"), 6).alias("iou")))
q("fn06_span_containment", f"{SPANS}, t AS (SELECT *, {tokens_sql('a')} AS ta, {tokens_sql('b')} AS tb FROM s) SELECT comment_id, i, round({containment_sql('ta', 'tb')}, 6) AS containment FROM t", "ab")(lambda s, d: _ab_spans(s, d).select("comment_id", "i", F.round(T.span_containment("a", "b"), 6).alias("containment")))


def _any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_EMO_SQL = (
    " + ".join(f"contains(lower(body), '{w}')::INT" for w in T.EMOTIVE)
    + " + least(2, length(body) - length(replace(body, '!', '')))"
    + f" + {_any_sql('body', T.EMOJI)}::INT"
    + " + (len(list_filter(regexp_split_to_array(body, '\\s+'), lambda t: length(t) > 3 AND t = upper(t) AND t <> lower(t))) > 0)::INT"
)
_TOPIC_SQL = "CASE " + " ".join(f"WHEN {_any_sql('lower(body)', ws)} THEN '{t}'" for t, ws in T.TOPICS.items()) + " END"
q("fn07_emotive_score", f"SELECT id, {_EMO_SQL} AS score FROM c", "c")(lambda s, d: B.comments(s, d).select("id", T.emotive_score("body").alias("score")))
q("fn08_topic", f"SELECT id, {_TOPIC_SQL} AS topic FROM c", "c")(lambda s, d: B.comments(s, d).select("id", T.topic("body").alias("topic")))

#: Firms of the generated texts as a second universe beside the built-in one.
UNIVERSE = T.TICKERS | {"QSP": ("quay street",), "HRWK": ("harwick",), "PNGR": ("pinnacle grid",), "CRVB": ("corvale",), "TSLM": ("tessel",), "DNMF": ("dunmore",), "OAKR": ("oakline",), "BFEN": ("bluefen",), "NML": ("northmere",), "AMBS": ("amberly",)}
_NAMES = {n: t for t, ns in UNIVERSE.items() for n in ns}
_ALT = "|".join(sorted(_NAMES, key=lambda n: (-len(n), n)))
_MAP = "MAP {" + ", ".join(f"'{n}': '{t}'" for n, t in _NAMES.items()) + "}"
_UNI = "[" + ", ".join(f"'{t}'" for t in UNIVERSE) + "]"
TICK_SQL = f"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(lower(body), '\\b({_ALT})\\b', 1), lambda n: {_MAP}[n]), list_filter(regexp_extract_all(body, '\\$([A-Z]{{1,5}})\\b', 1), lambda t: list_contains({_UNI}, t)))))"
q("fn09_tickers", f"SELECT id, array_to_string({TICK_SQL}, ',') AS tickers FROM c", "c")(lambda s, d: B.comments(s, d).select("id", F.array_join(T.tickers("body", UNIVERSE), ",").alias("tickers")))
q("fn10_strip_kind", "SELECT id, regexp_replace(link_id, '^[^_]*_', '') AS link, regexp_replace(parent_id, '^[^_]*_', '') AS parent FROM c", "c")(lambda s, d: B.comments(s, d).select("id", T.strip_kind("link_id").alias("link"), T.strip_kind("parent_id").alias("parent")))
RENDER_SQL = "concat_ws(chr(10) || chr(10), 'POST TITLE: ' || coalesce(post_title, '(unavailable)'), 'POST BODY: ' || post_selftext, 'PARENT COMMENT: ' || parent_body, 'COMMENT (annotate this): ' || body)"
_render = lambda: T.render_item(F.col("post_title"), F.col("post_selftext"), F.col("parent_body"), F.col("body"))
q("fn11_render_item", f"SELECT id, md5({RENDER_SQL}) AS digest, length({RENDER_SQL}) AS n FROM item", "item")(lambda s, d: B.items(s, d).select("id", F.md5(_render()).alias("digest"), F.length(_render()).alias("n")))
q("udf02_user_turn", f"SELECT id, 'user' AS role, {RENDER_SQL} AS content FROM item", "item")(lambda s, d: B.items(s, d).select("id", F.lit("user").alias("role"), _render().alias("content")))

@q("fn13_parse_object", "SELECT event_id, json_extract_string(regexp_extract('x ' || props || ' y', '(?s)\\{.*\\}'), '$.k') AS k FROM events")
def fn13(s, d):
    e = table(s, d, "events")
    raw = F.regexp_extract(F.concat(F.lit("x "), "props", F.lit(" y")), r"(?s)(\{.*\})", 1)
    return e.select("event_id", F.get_json_object(raw, "$.k").alias("k"))


q("fn14_slug", "SELECT id, translate(author || '/' || link_id || ':x', '/:', '__') AS slug FROM c", "c")(lambda s, d: B.comments(s, d).select("id", T.slug(F.concat("author", F.lit("/"), "link_id", F.lit(":x"))).alias("slug")))
q("fn15_half", "SELECT id, ('0x' || substr(md5(id), 32, 1))::INT % 2 AS half FROM c", "c")(lambda s, d: B.comments(s, d).select("id", T.half("id").alias("half")))
q("fn16_opener", "SELECT id, ('0x' || substr(md5(id), 30, 1))::INT % 2 AS opener FROM c", "c")(lambda s, d: B.comments(s, d).select("id", T.opener("id").alias("opener")))
q("fn17_sha", "SELECT id, sha256(nullif(body, '')) AS sha FROM c", "c")(lambda s, d: B.comments(s, d).select("id", T.sha(F.nullif("body", F.lit(""))).alias("sha")))
q("fn18_valence", "SELECT emotion, count(*) AS n, round(sum(valence), 4) AS total FROM pr0 GROUP BY 1", "pr0")(lambda s, d: B.flat_pairs(s, d).groupBy("emotion").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("valence"), 4).alias("total")))
q("fn19_week_end", f"SELECT DISTINCT day, {week_sql('day')} AS week_end FROM pr0", "pr0")(lambda s, d: B.flat_pairs(s, d).select("day", T.week_end("day").alias("week_end")).distinct())
q("fn20_week_start", f"SELECT DISTINCT day, {week_sql('day')} - 6 AS week_start FROM pr0", "pr0")(lambda s, d: B.flat_pairs(s, d).select("day", T.week_start("day").alias("week_start")).distinct())
q("fn21_epoch", "SELECT id, make_timestamp(created_utc * 1000000) AS at FROM c", "c")(lambda s, d: B.comments(s, d).select("id", (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("created_utc"))).alias("at")))
_TURN = "'text' || chr(10) || ' verdict: ' || CASE WHEN score % 3 = 0 THEN 'a' WHEN score % 3 = 1 THEN 'NEUTRAL' ELSE 'nothing' END || chr(10) || 'VERDICT: ' || CASE WHEN score % 2 = 0 THEN 'custom' ELSE 'none' END"


@q("fn22_verdict", f"SELECT id, coalesce(upper(list_last(regexp_extract_all({_TURN}, '(?im)^\\s*VERDICT:\\s*(A|B|NEUTRAL|CUSTOM|UNSURE)\\b', 1))), 'UNSURE') AS verdict FROM c WHERE score IS NOT NULL", "c")
def fn22(s, d):
    c = B.comments(s, d).where("score is not null")
    first = F.when(F.col("score") % 3 == 0, "a").when(F.col("score") % 3 == 1, "NEUTRAL").otherwise("nothing")
    last = F.when(F.col("score") % 2 == 0, "custom").otherwise("none")
    return c.select("id", T.verdict(F.concat(F.lit("text\n verdict: "), first, F.lit("\nVERDICT: "), last)).alias("verdict"))


_LOC_SQL = "SELECT comment_id, annotator, i, nullif(instr(body, espan), 0) - 1 AS s1, nullif(instr(body, espan), 0) - 1 + length(espan) AS e1, nullif(instr(body, nullif(cspan, '')), 0) - 1 AS s2, nullif(instr(body, nullif(cspan, '')), 0) - 1 + length(cspan) AS e2 FROM (SELECT comment_id, annotator, i, nullif(pairs[i].emotion_span, '') AS espan, pairs[i].cause_span AS cspan FROM (SELECT *, unnest(range(1, len(pairs) + 1)) AS i FROM lab)) l JOIN c ON c.id = l.comment_id"


def _located(s, d):
    spans = B.labels(s, d).select("comment_id", "annotator", F.posexplode("pairs")).join(B.comments(s, d).select("id", "body"), F.col("comment_id") == F.col("id"))
    e, c = F.col("col.emotion_span"), F.col("col.cause_span")
    at = spans.select("comment_id", "annotator", (F.col("pos") + 1).alias("i"), T.locate("body", e).alias("s1"), F.length(e).alias("n1"), T.locate("body", c).alias("s2"), F.length(c).alias("n2"))
    return at.select("comment_id", "annotator", "i", "s1", (F.col("s1") + F.col("n1")).alias("e1"), "s2", (F.col("s2") + F.col("n2")).alias("e2"))


q("fn24_locate", _LOC_SQL, "lab", "c")(_located)
q("fn23_gap", f"SELECT comment_id, annotator, i, greatest(0, s2 - e1, s1 - e2) AS gap FROM ({_LOC_SQL}) WHERE s1 IS NOT NULL AND s2 IS NOT NULL", "lab", "c")(
    lambda s, d: _located(s, d).where("s1 is not null and s2 is not null").select("comment_id", "annotator", "i", T.gap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).alias("gap"))
)
q("agg55_alignment_coverage", f"SELECT annotator, round(avg((s1 IS NOT NULL)::INT), 6) AS emotion_cov, round(avg((s2 IS NOT NULL)::INT), 6) AS cause_cov FROM ({_LOC_SQL}) GROUP BY 1", "lab", "c")(
    lambda s, d: _located(s, d).groupBy("annotator").agg(F.round(F.avg(F.col("s1").isNotNull().cast("int")), 6).alias("emotion_cov"), F.round(F.avg(F.col("s2").isNotNull().cast("int")), 6).alias("cause_cov"))
)
q("fn27_sources_of", f"SELECT id, md5({_POST_SQL}) AS post_digest FROM item", "item")(lambda s, d: B.items(s, d).select("id", F.md5(T.post_text("post_title", "post_selftext")).alias("post_digest")))
q("cod5_post_source", "SELECT id, md5(trim(coalesce(post_title, '') || ' ' || coalesce(post_selftext, ''))) AS digest FROM item", "item")(lambda s, d: B.items(s, d).select("id", F.md5(F.trim(F.concat(F.coalesce("post_title", F.lit("")), F.lit(" "), F.coalesce("post_selftext", F.lit(""))))).alias("digest")))
q("udf05_first_candidate", "SELECT comment_id, annotator, list_min(list_transform(pairs, lambda p: p.emotion)) AS pick FROM lab WHERE len(pairs) > 0", "lab")(lambda s, d: B.labels(s, d).where(F.size("pairs") > 0).select("comment_id", "annotator", F.array_min(F.col("pairs.emotion")).alias("pick")))
q("udf04_judge_fields", "SELECT comment_id, annotator, to_json({'emotion': list_min(list_transform(pairs, lambda p: p.emotion)), 'cause_category': list_min(list_transform(pairs, lambda p: p.cause_category))})::VARCHAR AS verdict FROM lab WHERE len(pairs) > 1", "lab")(
    lambda s, d: B.labels(s, d).where(F.size("pairs") > 1).select("comment_id", "annotator", F.to_json(F.struct(F.array_min(F.col("pairs.emotion")).alias("emotion"), F.array_min(F.col("pairs.cause_category")).alias("cause_category"))).alias("verdict"))
)
q("udf06_scenario", "SELECT id, ('0x' || substr(md5(id), 32, 1))::INT % 4 AS scenario FROM c", "c")(lambda s, d: B.comments(s, d).select("id", (F.conv(F.substring(F.md5("id"), 32, 1), 16, 10).cast("int") % 4).alias("scenario")))
_BIO = ["O"] + [f"{x}-{e}" for e in EMOTIONS for x in "BI"]
q("misc25_bio_ids", "SELECT i - 1 AS tag_id, tags[i] AS tag FROM (SELECT [" + ", ".join(f"'{t}'" for t in _BIO) + "] AS tags, unnest(range(1, " + str(len(_BIO) + 1) + ")) AS i)")(
    lambda s, d: s.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in _BIO])).alias("tag_id", "tag"))
)

# filters
HYG_SQL = "length(body) BETWEEN 60 AND 1500 AND body NOT IN ('[removed]', '[deleted]') AND author NOT IN ('AutoModerator', '[deleted]') AND NOT ends_with(lower(author), 'bot') AND NOT body ILIKE 'Rule %' AND NOT body ILIKE '%[contact the mods](%'"
HYG_PY = "length(body) BETWEEN 60 AND 1500 AND body NOT IN ('[removed]', '[deleted]') AND author NOT IN ('AutoModerator', '[deleted]') AND NOT ends_with(lower(author), 'bot') AND NOT starts_with(body, 'Rule ') AND NOT contains(body, '[contact the mods](')"
q("flt01_hygiene_sql", f"SELECT id FROM c WHERE {HYG_SQL}", "c")(lambda s, d: B.comments(s, d).where(R.hygiene(like_sql=True)).select("id"))
q("flt02_hygiene_py", f"SELECT id FROM c WHERE {HYG_PY}", "c")(lambda s, d: B.comments(s, d).where(R.hygiene(like_sql=False)).select("id"))
q("flt03_dead", "SELECT count(*) AS n, count(*) FILTER (body IN ('', '[deleted]', '[removed]')) AS n_dead FROM c", "c")(lambda s, d: B.comments(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(R.is_dead()).alias("n_dead")))
q("flt04_caps", "SELECT id, length(substr(post_title, 1, 300)) AS t, length(substr(post_selftext, 1, 4000)) AS x, length(substr(parent_body, 1, 3000)) AS p, length(substr(body, 1, 12000)) AS b FROM item", "item")(
    lambda s, d: R.cap_texts(B.items(s, d), {"post_title": 300, "post_selftext": 4000, "parent_body": 3000, "body": 12000}).select("id", F.length("post_title").alias("t"), F.length("post_selftext").alias("x"), F.length("parent_body").alias("p"), F.length("body").alias("b"))
)
q("flt05_context_caps", """SELECT c.id, length(nullif(substr(p.selftext, 1, 40000), '')) AS n_selftext, length(nullif(substr(b.body, 1, 10000), '')) AS n_parent
    FROM c LEFT JOIN p ON p.id = regexp_replace(c.link_id, '^[^_]*_', '') LEFT JOIN c b ON starts_with(c.parent_id, 't1_') AND b.id = regexp_replace(c.parent_id, '^[^_]*_', '')""", "c", "p")(  # fmt: skip
    lambda s, d: B.items(s, d).select("id", F.length("post_selftext").alias("n_selftext"), F.length("parent_body").alias("n_parent"))
)
_EIGHT = "{" + ", ".join(f"'{f}': p.{f}" for f in PAIR_FIELDS) + "}"
q("flt07_clean_pairs", f"SELECT comment_id, annotator, to_json(list_transform(pairs, lambda p: {_EIGHT}))::VARCHAR AS js FROM lab", "lab")(
    lambda s, d: B.labels(s, d).select("comment_id", "annotator", F.to_json(R.clean_pairs("pairs"), {"ignoreNullFields": "false"}).alias("js"))
)
q("flt08_drop_cause", "SELECT cause, count(*) AS n FROM pr0 WHERE coalesce(cause, '') <> 'interpersonal' GROUP BY 1", "pr0")(lambda s, d: B.market_pairs(s, d).groupBy("cause").agg(F.count(F.lit(1)).alias("n")))
q("flt10_sarcasm_treatments", "SELECT treatment, emotion, count(*) AS n, round(sum(CASE WHEN treatment = 'flip' AND sarcasm THEN -valence ELSE valence END), 4) AS total FROM pr, (VALUES ('baseline'), ('drop'), ('flip')) t(treatment) WHERE NOT (treatment = 'drop' AND sarcasm) GROUP BY 1, 2", "pr")(
    lambda s, d: R.sarcasm_treatments(B.market_pairs(s, d)).groupBy("treatment", "emotion").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("valence"), 4).alias("total"))
)
q("src04_post_rows", "SELECT * FROM p", "p")(B.posts)
q("src05_comment_rows", "SELECT id, created_utc, link_id, parent_id, author, score, body FROM c", "c")(lambda s, d: B.comments(s, d).drop("pos"))
q("api03_comment", "SELECT id, body, post_title, parent_body FROM item WHERE id = (SELECT min(id) FROM c)", "item")(lambda s, d: B.items(s, d).join(B.comments(s, d).agg(F.min("id").alias("id")), "id").select("id", "body", "post_title", "parent_body"))
q("misc24_render_pairs", "SELECT comment_id, annotator, i, '**' || annotator || '**: **' || pairs[i].emotion || '** ' || pairs[i].emotion_span || ' <- [' || pairs[i].cause_category || '/' || coalesce(pairs[i].cause_source, '-') || ']' AS line FROM (SELECT *, unnest(range(1, len(pairs) + 1)) AS i FROM lab)", "lab")(
    lambda s, d: B.labels(s, d).select("comment_id", "annotator", F.posexplode("pairs")).select("comment_id", "annotator", (F.col("pos") + 1).alias("i"), F.concat(F.lit("**"), "annotator", F.lit("**: **"), "col.emotion", F.lit("** "), "col.emotion_span", F.lit(" <- ["), "col.cause_category", F.lit("/"), F.coalesce("col.cause_source", F.lit("-")), F.lit("]")).alias("line"))
)
