"""Queries of sampling, joins with context, validation, offsets, tags and training examples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions import text as T
from ..operators import relational as R
from ..operators import sampling as S
from ..operators import tagging as G
from ..operators import validate as V
from ..schema import ASSETS, CAUSES, EMOTIONS, SOURCES
from ..sources import jsonl as J
from . import bindings as B
from .bindings import norm_sql, span_in_sql, sql
from .q_text import _CAUSE_SQL, _EMO_SQL, _LOC_SQL, _POST_SQL, _SOURCE_SQL, _TOPIC_SQL, HYG_PY, HYG_SQL, RENDER_SQL, _located, _render
from .registry import Registry
from .scratch import Scratch

SAMPLING = Registry()
SEED = 7


def q(name: str, body: str, *views: str):
    return SAMPLING.add(name, sql(body, *views))


H_SQL = f"abs((pos * {S.MULTIPLIER} + {SEED}) % {S.MODULUS})"
Y_SQL = f"(created_utc // {S.YEAR_SECONDS} + 1970)::INT"
q("top01_hash_order", f"SELECT id, {H_SQL} AS h FROM c", "c")(lambda s, d: B.comments(s, d).select("id", S.hash_order("pos", SEED).alias("h")))
_LT = f"SELECT c.* FROM c JOIN p ON p.id = substr(c.link_id, 4) WHERE starts_with(c.parent_id, 't3_') AND p.is_self = 0"
_RA = "SELECT c.* FROM c JOIN c pc ON pc.id = substr(c.parent_id, 4) WHERE starts_with(c.parent_id, 't1_') AND contains(' ' || lower(c.body) || ' ', ' you ')"
q("joi01_link_top", f"SELECT id FROM ({_LT})", "c", "p")(lambda s, d: R.on_link_posts(B.comments(s, d), B.posts(s, d)).select("id"))
q("joi02_reply_arg", f"SELECT id FROM ({_RA})", "c")(lambda s, d: R.addressing_replies(B.comments(s, d)).select("id"))
q("joi03_context", f"SELECT id, md5(post_title) AS t, md5(post_selftext) AS x, post_is_self, md5(parent_body) AS p FROM item", "item")(lambda s, d: B.items(s, d).select("id", F.md5("post_title").alias("t"), F.md5("post_selftext").alias("x"), "post_is_self", F.md5("parent_body").alias("p")))

_PILOT = f"""WITH f1 AS (SELECT id, 'link_top' AS stratum FROM (SELECT id, {H_SQL} AS h FROM ({_LT}) WHERE {HYG_SQL} ORDER BY h, id LIMIT 200) ORDER BY h, id LIMIT 100),
    g2 AS (SELECT id, {H_SQL} AS h FROM ({_RA}) WHERE {HYG_SQL} ORDER BY h, id LIMIT 200), f2 AS (SELECT id, 'reply_arg' AS stratum FROM g2 WHERE id NOT IN (SELECT id FROM f1) ORDER BY h, id LIMIT 100),
    g3 AS (SELECT id, {H_SQL} AS h FROM c WHERE {HYG_SQL} ORDER BY h, id LIMIT 100), f3 AS (SELECT id, 'random' AS stratum FROM g3 WHERE id NOT IN (SELECT id FROM f1 UNION ALL SELECT id FROM f2) ORDER BY h, id LIMIT 50),
    pilot AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3)"""


def pilot(s, d):
    c, p = B.comments(s, d), B.posts(s, d)
    ok = R.hygiene(like_sql=True)
    return S.priority_strata([("link_top", R.on_link_posts(c, p).where(ok), 100), ("reply_arg", R.addressing_replies(c).where(ok), 100), ("random", c.where(ok), 50)], S.hash_order("pos", SEED))


q("top02_priority_strata", f"{_PILOT} SELECT * FROM pilot", "c", "p")(pilot)
q("misc04_pilot_sample", f"{_PILOT} SELECT i.id, stratum, md5(post_title) AS t, md5(parent_body) AS p FROM pilot JOIN item i USING (id)", "item")(lambda s, d: pilot(s, d).join(B.items(s, d), "id").select("id", "stratum", F.md5("post_title").alias("t"), F.md5("parent_body").alias("p")))
q("top07_limit_ids", f"SELECT id FROM (SELECT id, {H_SQL} AS h FROM c) ORDER BY h, id LIMIT 25", "c")(lambda s, d: B.comments(s, d).select("id", S.hash_order("pos", SEED).alias("h")).orderBy("h", "id").limit(25).select("id"))
_VOL = f"WITH vol AS (SELECT {Y_SQL} AS year, count(*) AS v FROM c WHERE {HYG_SQL} AND created_utc IS NOT NULL GROUP BY 1)"


def volumes(s, d):
    return B.comments(s, d).where(R.hygiene(like_sql=True) & F.col("created_utc").isNotNull()).groupBy(S.approx_year().alias("year")).agg(F.count(F.lit(1)).alias("v"))


q("agg07_year_volume", f"{_VOL} SELECT * FROM vol", "c")(volumes)
_QUO = _VOL + ", q1 AS (SELECT year, v, greatest({f}, round_even(CAST({n} AS DOUBLE) * v / (SELECT sum(v) FROM vol), 0)::INT) AS q FROM vol), quo AS (SELECT year, v, greatest({f}, round_even(q * ({n}::DOUBLE / (SELECT sum(q) FROM q1)), 0)::INT) AS quota FROM q1)"
q("agg08_year_quotas", _QUO.format(n=600, f=20) + " SELECT year, v, quota FROM quo", "c")(lambda s, d: S.year_quotas(volumes(s, d), 600, 20))
q("agg09_topic_year_caps", f"{_VOL} SELECT year, greatest(60, floor(2.0::DOUBLE * 40 * v / (SELECT sum(v) FROM vol))::INT) AS cap FROM vol", "c")(lambda s, d: volumes(s, d).select("year", F.greatest(F.lit(60), F.floor(2.0 * 40 * F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(1)))).cast("int")).alias("cap")))


@q("win10_random_slice", f"""{_QUO.format(n=600, f=20)}, rk AS (SELECT id, year(make_timestamp(created_utc * 1000000))::INT AS y, row_number() OVER (PARTITION BY year(make_timestamp(created_utc * 1000000)) ORDER BY {H_SQL}, id) AS r FROM c WHERE {HYG_PY} AND created_utc IS NOT NULL)
    SELECT id, y AS year FROM rk JOIN quo ON quo.year = rk.y WHERE r <= quota""", "c")  # fmt: skip
def win10(s, d):
    """The random slice of the full sample: the first rows of every year in hash order."""
    quo = S.year_quotas(volumes(s, d), 600, 20).select(F.col("year").alias("qy"), "quota")
    c = B.comments(s, d).where(R.hygiene(like_sql=False) & F.col("created_utc").isNotNull()).select("id", S.calendar_year().alias("year"), S.hash_order("pos", SEED).alias("h"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("year").orderBy("h", "id"))).join(F.broadcast(quo), F.col("year") == F.col("qy"))
    return r.where(F.col("r") <= F.col("quota")).select("id", "year")


def full_sample(s, d, n=1000):
    """The three-slice sample by first fit, with year quotas, topic quotas and topic-year caps."""
    n_rand, n_topic = round(n * 0.15), round(n * 0.425)
    n_emo = n - n_rand - n_topic
    vol = volumes(s, d)
    rand = S.year_quotas(vol, n_rand, 10).select(F.lit("random").alias("stratum"), F.lit("").alias("bucket"), "year", F.col("quota").alias("cap"), F.lit(n_rand).alias("bucket_cap"))
    emo = S.year_quotas(vol, n_emo, 25).select(F.lit("emotive").alias("stratum"), F.lit("").alias("bucket"), "year", F.col("quota").alias("cap"), F.lit(n_emo).alias("bucket_cap"))
    per = n_topic // len(T.TOPICS)
    share = F.sum("v").over(Window.partitionBy(F.lit(1)))
    topic = vol.select("year", F.greatest(F.lit(3), F.floor(2.0 * per * F.col("v") / share).cast("int")).alias("cap")).withColumn("bucket", F.explode(F.array(*[F.lit(t) for t in T.TOPICS])))
    topic = topic.select(F.lit("topic").alias("stratum"), "bucket", "year", "cap", F.lit(per).alias("bucket_cap"))
    c = B.comments(s, d).where(R.hygiene(like_sql=False) & F.col("created_utc").isNotNull())
    return S.first_fit(S.scan_options(c, SEED), rand.unionByName(topic).unionByName(emo), {"random": n_rand, "topic": n_topic, "emotive": n_emo})


SAMPLING.add("win10_full_sample")(full_sample)
_EMOTIVE_STRATA = f"SELECT id, CASE WHEN {_TOPIC_SQL} IS NOT NULL THEN {_TOPIC_SQL} WHEN {_EMO_SQL} >= 2 THEN 'emotive' ELSE 'random' END AS stratum FROM c"


def _strata(s, d):
    t = T.topic("body")
    return B.comments(s, d).select("id", F.when(t.isNotNull(), t).when(T.emotive_score("body") >= 2, "emotive").otherwise("random").alias("stratum"))


q("top03_gold_quotas", f"SELECT stratum, least(count(*), 20) AS n FROM ({_EMOTIVE_STRATA}) GROUP BY 1", "c")(lambda s, d: S.quota_sample(_strata(s, d), ["stratum"], F.lit(20), "id", SEED).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")))
q("top04_dev_split", f"WITH st AS ({_EMOTIVE_STRATA}), n AS (SELECT stratum, count(*) AS n FROM st GROUP BY 1) SELECT stratum, round_even(200.0::DOUBLE * n / (SELECT sum(n) FROM n), 0)::BIGINT AS n_dev FROM n WHERE round_even(200.0::DOUBLE * n / (SELECT sum(n) FROM n), 0) > 0", "c")(
    lambda s, d: S.stratified_dev(_strata(s, d), "stratum", "id", 200, SEED).where("split = 'dev'").groupBy("stratum").agg(F.count(F.lit(1)).alias("n_dev"))
)
_SPLIT = f"WITH st AS ({_EMOTIVE_STRATA}), n AS (SELECT stratum, round_even(200.0::DOUBLE * count(*) / (SELECT count(*) FROM st), 0) AS q FROM st GROUP BY 1), rk AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(id || ':{SEED}'), id) AS r FROM st)"
q("snk06_split_manifest", f"{_SPLIT} SELECT id, stratum, CASE WHEN r <= q THEN 'dev' ELSE 'train' END AS split FROM rk JOIN n USING (stratum)", "c")(lambda s, d: S.stratified_dev(_strata(s, d), "stratum", "id", 200, SEED).select("id", "stratum", "split"))
q("top03_gold_sample", f"{_SPLIT} SELECT id, stratum FROM rk WHERE r <= 20", "c")(lambda s, d: S.quota_sample(_strata(s, d), ["stratum"], F.lit(20), "id", SEED).select("id", "stratum"))
q("agg54_split_stats", f"SELECT stratum, count(*) AS n FROM ({_EMOTIVE_STRATA}) GROUP BY 1", "c")(lambda s, d: S.stratified_dev(_strata(s, d), "stratum", "id", 200, SEED).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")))


@q("src22_stride", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS line FROM c) WHERE line % 20 = 0", "c")
def src22(s, d):
    """Every twentieth physical line of label files, numbered over all files in order of their names."""
    path = f"{Scratch(s, 'lines').base}/comments"
    J.write_jsonl(B.comments(s, d).select("id", "body").repartitionByRange(8, "id").sortWithinPartitions("id"), path)
    lines = J.numbered_lines(s, path).where(F.col("line") % 20 == 0)
    return lines.select(F.get_json_object("value", "$.id").alias("id"))


q("agg53_progress", "SELECT r.annotator, count(l.comment_id) AS n FROM (VALUES ('A'), ('B'), ('C01'), ('NOBODY')) r(annotator) LEFT JOIN lab l ON l.annotator = r.annotator GROUP BY 1", "lab")(
    lambda s, d: s.createDataFrame([("A",), ("B",), ("C01",), ("NOBODY",)], "annotator string").join(B.labels(s, d).groupBy("annotator").agg(F.count(F.lit(1)).alias("c")), "annotator", "left").select("annotator", F.coalesce("c", F.lit(0)).alias("n"))
)

# joins of labels with items
q("joi04_label_sample", "SELECT comment_id, count(*) AS n_models FROM lab JOIN c ON c.id = comment_id GROUP BY 1", "lab", "c")(lambda s, d: B.labels(s, d).join(B.comments(s, d).select(F.col("id").alias("cid")), F.col("comment_id") == F.col("cid")).groupBy("comment_id").agg(F.count(F.lit(1)).alias("n_models")))


def _excluded(s, d):
    return B.labels(s, d).where("annotator = 'C01'").select("comment_id")


def _kept(s, d):
    return B.labels(s, d).where("annotator = 'A'").join(B.comments(s, d).select(F.col("id").alias("comment_id")), "comment_id", "left_semi").join(_excluded(s, d), "comment_id", "left_anti").select("comment_id")


q("joi05_kept_not_excluded", "SELECT comment_id FROM lab WHERE annotator = 'A' AND comment_id IN (SELECT id FROM c) AND comment_id NOT IN (SELECT comment_id FROM lab WHERE annotator = 'C01')", "lab", "c")(_kept)
q("joi06_two_annotators", "SELECT comment_id FROM ab", "ab")(lambda s, d: B.coded(s, d).select("comment_id"))
q("joi09_restrict", "SELECT comment_id, annotator FROM lab WHERE comment_id IN (SELECT comment_id FROM lab WHERE annotator = 'C02')", "lab")(lambda s, d: B.labels(s, d).join(B.labels(s, d).where("annotator = 'C02'").select("comment_id"), "comment_id", "left_semi").select("comment_id", "annotator"))
q("joi19_extra_ids", "SELECT comment_id FROM lab WHERE annotator = 'B' AND comment_id NOT IN (SELECT comment_id FROM lab WHERE annotator = 'A')", "lab")(lambda s, d: B.labels(s, d).where("annotator = 'B'").join(B.labels(s, d).where("annotator = 'A'").select("comment_id"), "comment_id", "left_anti").select("comment_id"))
q("set03_common_ids", "SELECT comment_id FROM lab WHERE annotator IN ('A', 'B', 'C01') GROUP BY 1 HAVING count(DISTINCT annotator) = 3", "lab")(lambda s, d: B.labels(s, d).where("annotator in ('A', 'B', 'C01')").groupBy("comment_id").agg(F.countDistinct("annotator").alias("k")).where("k = 3").select("comment_id"))
q("set05_leak_check", "SELECT count(*) AS n_leaked FROM (SELECT comment_id FROM lab WHERE annotator = 'A' INTERSECT SELECT comment_id FROM lab WHERE annotator = 'NOBODY')", "lab")(lambda s, d: R.leaked(_kept(s, d), _excluded(s, d)))
q("src12_most_active", "SELECT annotator, count(*) AS n FROM lab GROUP BY 1 ORDER BY n DESC, annotator LIMIT 1", "lab")(lambda s, d: B.labels(s, d).groupBy("annotator").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "annotator").limit(1))
q("src13_neutral_by_pairs", "SELECT comment_id, annotator, len(pairs) = 0 AS neutral FROM lab", "lab")(lambda s, d: B.labels(s, d).select("comment_id", "annotator", (F.size("pairs") == 0).alias("neutral")))
q("src14_explicit_neutral", "SELECT comment_id, annotator, coalesce(neutral, len(pairs) = 0) AS neutral FROM lab", "lab")(lambda s, d: B.labels(s, d).select("comment_id", "annotator", F.coalesce("neutral", F.size("pairs") == 0).alias("neutral")))
q("src11_double_coded", "SELECT annotator, comment_id, len(pairs)::INT AS n FROM lab WHERE annotator IN ('A', 'B')", "lab")(lambda s, d: B.labels(s, d).where("annotator in ('A', 'B')").select("annotator", "comment_id", F.size("pairs").alias("n")))
q("misc22_coded_slots", "SELECT comment_id, na, nb FROM ab", "ab")(lambda s, d: B.coded(s, d).select("comment_id", "na", "nb"))
q("misc23_prior_labels", "SELECT comment_id, annotator FROM lab WHERE annotator IN ('C01', 'C02')", "lab")(lambda s, d: B.labels(s, d).where("annotator in ('C01', 'C02')").select("comment_id", "annotator"))
q("misc21_adjudicated_pairs", "SELECT comment_id, len(pairs)::INT AS n FROM (SELECT comment_id, pairs, row_number() OVER (PARTITION BY comment_id ORDER BY updated_at DESC) AS rn FROM adjudications WHERE upper(trim(final)) IN ('A', 'B', 'NEUTRAL', 'CUSTOM')) WHERE rn = 1")(
    lambda s, d: B.table(s, d, "adjudications").where("upper(trim(final)) in ('A', 'B', 'NEUTRAL', 'CUSTOM')").groupBy("comment_id").agg(F.max(F.struct("updated_at", F.size("pairs").alias("n"))).alias("m")).select("comment_id", "m.n")
)
q("misc19_human_report", "SELECT annotator, round(avg((len(pairs) = 0)::INT), 6) AS neutral_rate, sum(len(list_filter(pairs, lambda p: p.sarcasm)))::BIGINT AS n_sarcastic FROM lab GROUP BY 1", "lab")(
    lambda s, d: B.labels(s, d).groupBy("annotator").agg(F.round(F.avg((F.size("pairs") == 0).cast("int")), 6).alias("neutral_rate"), F.sum(F.size(F.filter("pairs", lambda p: F.coalesce(p["sarcasm"], F.lit(False))))).alias("n_sarcastic"))
)
q("misc03_table_counts", "SELECT 'comments' AS name, count(*) AS n FROM c UNION ALL SELECT 'posts', count(*) FROM p", "c", "p")(lambda s, d: B.comments(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("comments").alias("name"), "n").unionByName(B.posts(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("posts").alias("name"), "n")))
q("api02_done_flags", "SELECT c.id, l.comment_id IS NOT NULL AS done FROM c LEFT JOIN lab l ON l.comment_id = c.id AND l.annotator = 'A'", "c", "lab")(lambda s, d: B.comments(s, d).select("id").join(B.labels(s, d).where("annotator = 'A'").select("comment_id"), F.col("id") == F.col("comment_id"), "left").select("id", F.col("comment_id").isNotNull().alias("done")))
q("flt13_blind", "SELECT comment_id, annotator, CASE WHEN annotator = 'A' THEN len(pairs)::INT END AS shown FROM lab", "lab")(lambda s, d: B.labels(s, d).select("comment_id", "annotator", F.when(F.col("annotator") == "A", F.size("pairs")).alias("shown")))
_ADJ = "adj AS (SELECT comment_id, final, updated_at FROM (SELECT comment_id, upper(trim(final)) AS final, updated_at, row_number() OVER (PARTITION BY comment_id ORDER BY updated_at DESC) AS rn FROM adjudications WHERE comment_id IS NOT NULL) WHERE rn = 1)"


def _latest_adj(s, d):
    return B.table(s, d, "adjudications").where("comment_id is not null").groupBy("comment_id").agg(F.max(F.struct("updated_at", F.upper(F.trim("final")).alias("final"))).alias("m")).select("comment_id", "m.final")


q("api06_adjudication_list", f"WITH {_ADJ} SELECT ab.comment_id, na, nb, final FROM ab LEFT JOIN adj USING (comment_id)", "ab")(lambda s, d: B.coded(s, d).join(_latest_adj(s, d), "comment_id", "left").select("comment_id", "na", "nb", "final"))
q("api08_adjudication_item", f"WITH {_ADJ} SELECT ab.comment_id, length(body)::INT AS n_chars, final, (SELECT count(*) FROM lab WHERE lab.comment_id = ab.comment_id) AS n_labels FROM ab JOIN c ON c.id = ab.comment_id LEFT JOIN adj ON adj.comment_id = ab.comment_id", "ab", "c")(
    lambda s, d: B.coded(s, d)
    .join(B.comments(s, d).select(F.col("id").alias("comment_id"), F.length("body").alias("n_chars")), "comment_id")
    .join(_latest_adj(s, d), "comment_id", "left")
    .join(B.labels(s, d).groupBy("comment_id").agg(F.count(F.lit(1)).alias("n_labels")), "comment_id")
    .select("comment_id", "n_chars", "final", "n_labels")
)

# checksums of items
_MAN = f"SELECT id AS comment_id, sha256(nullif(body, '')) AS sha256_comment, sha256(parent_body) AS sha256_parent, sha256({_POST_SQL}) AS sha256_post FROM item"


def _texts(s, d):
    it = B.items(s, d)
    return it.select(F.col("id").alias("comment_id"), F.nullif("body", F.lit("")).alias("comment_text"), F.col("parent_body").alias("parent_text"), T.post_text("post_title", "post_selftext").alias("post_text"))


def manifest(s, d):
    return _texts(s, d).select("comment_id", *[T.sha(f"{f}_text").alias(f"sha256_{f}") for f in ("comment", "parent", "post")])


q("src21_manifest", _MAN, "item")(manifest)


@q("joi17_verify", f"WITH man AS ({_MAN}), loc AS (SELECT id AS cid, CASE WHEN pos % 7 = 1 THEN body || '!' ELSE nullif(body, '') END AS body FROM item WHERE pos % 7 <> 0) SELECT m.comment_id, CASE WHEN cid IS NULL THEN 'unavailable' WHEN sha256(loc.body) IS NOT DISTINCT FROM sha256_comment THEN 'ok' ELSE 'mismatch' END AS status FROM man m LEFT JOIN loc ON cid = m.comment_id", "item")
def joi17(s, d):
    """Verification against local texts of which some are gone and some were edited."""
    pos = T.text_pos("comment_id")
    local = _texts(s, d).where(pos % 7 != 0).withColumn("comment_text", F.when(pos % 7 == 1, F.concat(F.coalesce("comment_text", F.lit("")), F.lit("!"))).otherwise(F.col("comment_text")))
    return R.checksum_status(manifest(s, d), local).select("comment_id", "status")


q("misc20_rehydration_missing", "SELECT id AS comment_id FROM item WHERE pos % 7 = 0", "item")(lambda s, d: manifest(s, d).join(_texts(s, d).where(T.text_pos("comment_id") % 7 != 0).select("comment_id"), "comment_id", "left_anti").select("comment_id"))
_SPAN_SQL = f"""(SELECT comment_id, annotator, p.emotion_span AS span FROM (SELECT comment_id, annotator, unnest(pairs) AS p FROM lab)) l JOIN c ON c.id = l.comment_id WHERE {span_in_sql('l.span', 'c.body')}"""


def _decoded_labels(s, d):
    """Labels with offsets decoded from the corpus: comments it lacks are flagged, and spans that come back otherwise counted.

    A span that ends within what a character reference stands for comes back with the reference cut off.
    """
    spans = B.labels(s, d).select("comment_id", "annotator", "pairs").join(B.comments(s, d).select("id", "body"), F.col("comment_id") == F.col("id"), "left")
    none = F.lit(None).cast("string")
    per = spans.where("id is not null").select("comment_id", "annotator", "body", F.explode("pairs.emotion_span").alias("span")).withColumn("offset", C.encode_udf("span", "body", none, none))
    got = per.where("offset.src is not null").withColumn("raw", C.decode_udf("offset", "body", none, none))
    n = got.groupBy(F.col("comment_id").alias("n_id"), F.col("annotator").alias("n_who")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~T.normalize("raw").eqNullSafe(T.normalize("span"))).alias("bad"))
    j = spans.join(n, (F.col("comment_id") == F.col("n_id")) & (F.col("annotator") == F.col("n_who")), "left")
    return j.select("comment_id", "annotator", F.col("id").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n_decoded"), F.coalesce("bad", F.lit(0)).alias("n_mismatch"))


q("joi18_decode_join", f"""SELECT l.comment_id, l.annotator, c.id IS NOT NULL AS present, coalesce(n, 0)::BIGINT AS n_decoded
    FROM lab l LEFT JOIN c ON c.id = l.comment_id LEFT JOIN (SELECT l.comment_id, l.annotator, count(*) AS n FROM {_SPAN_SQL} GROUP BY 1, 2) x ON x.comment_id = l.comment_id AND x.annotator = l.annotator""", "lab", "c")(  # fmt: skip
    lambda s, d: _decoded_labels(s, d).drop("n_mismatch")
)
SAMPLING.add("joi18_decode_report")(lambda s, d: _decoded_labels(s, d).agg(F.count(F.lit(1)).alias("n_labels"), F.count_if(~F.col("present")).alias("n_missing"), F.sum("n_decoded").alias("n_decoded"), F.sum("n_mismatch").alias("n_mismatch")))


# validation
_in = lambda x, vs: f"{x} IS NULL OR {x} NOT IN ({', '.join(chr(39) + v + chr(39) for v in vs)})"
_RULES = [
    (_in("p.emotion", EMOTIONS), "emotion: not in the list"), ("coalesce(p.emotion_span, '') = ''", "emotion_span: empty"), ("coalesce(p.cause_span = '', FALSE)", "cause_span: empty"),
    (f"p.cause_source IS NOT NULL AND p.cause_source NOT IN ({', '.join(chr(39) + v + chr(39) for v in SOURCES)})", "cause_source: not in the list"), (_in("p.cause_category", CAUSES), "cause_category: not in the list"), (_in("p.target_asset", ASSETS), "target_asset: not in the list"),
    ("p.intensity IS NULL OR NOT p.intensity BETWEEN 0 AND 1", "intensity: not within 0 and 1"), ("p.sarcasm IS NULL", "sarcasm: missing"),
    ("p.cause_span IS NULL AND NOT (p.cause_category IS NOT DISTINCT FROM 'unclear' AND p.cause_source IS NULL)", "cause: no span, but a category or source"),
    ("p.cause_span IS NOT NULL AND (p.cause_category IS NOT DISTINCT FROM 'unclear' OR p.cause_source IS NULL)", "cause: a span, but no category or source"),
]
_PX = "px AS (SELECT comment_id, annotator, i, pairs[i] AS p FROM (SELECT *, unnest(range(1, len(pairs) + 1)) AS i FROM lab))"
q("fn25_scheme_errors", f"WITH {_PX} " + " UNION ALL ".join(f"SELECT comment_id, annotator, 'pairs[' || (i - 1) || '].{m}' AS error FROM px WHERE {c}" for c, m in _RULES), "lab")(
    lambda s, d: B.labels(s, d).select("comment_id", "annotator", F.explode(V.scheme_errors(F.col("pairs"))).alias("error"))
)


def validated(s, d, **kw):
    it = B.items(s, d).select("id", "body", "parent_body", T.post_text("post_title", "post_selftext").alias("post_text"))
    return V.validate(B.labels(s, d).join(it, F.col("comment_id") == F.col("id")), **kw)


_FIX = f"SELECT comment_id, annotator, said, {_SOURCE_SQL} AS src FROM {_CAUSE_SQL} WHERE span IS NOT NULL"
q("fn26_source_fixes", f"SELECT l.comment_id, l.annotator, coalesce(sum((src IS NOT NULL AND src IS DISTINCT FROM said)::INT), 0)::INT AS fixes FROM lab l JOIN c ON c.id = l.comment_id LEFT JOIN ({_FIX}) f ON f.comment_id = l.comment_id AND f.annotator = l.annotator GROUP BY 1, 2", "lab", "item")(
    lambda s, d: validated(s, d).select("comment_id", "annotator", "fixes")
)
_ESP = f"SELECT comment_id, annotator, count(*) AS bad FROM (SELECT comment_id, annotator, i, pairs[i].emotion_span AS span FROM (SELECT *, unnest(range(1, len(pairs) + 1)) AS i FROM lab)) l JOIN item ON item.id = l.comment_id WHERE span IS NOT NULL AND NOT {span_in_sql('l.span', 'body')} GROUP BY 1, 2"
q("fn29_span_errors", f"SELECT comment_id, annotator, bad FROM ({_ESP})", "lab", "item")(
    lambda s, d: validated(s, d).select("comment_id", "annotator", F.size(F.filter("errors", lambda e: F.contains(e, F.lit("emotion_span: not in the comment")))).cast("bigint").alias("bad")).where("bad > 0")
)
q("agg27_model_report", f"SELECT annotator, count(*) AS n, count(*) FILTER (len(pairs) > 0) AS emotive, sum(len(pairs))::BIGINT AS n_pairs, round(avg(len(pairs)), 6) AS per_comment, count(*) FILTER (len(pairs) >= 8) AS at_cap FROM lab GROUP BY 1", "lab")(
    lambda s, d: B.labels(s, d).groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("pairs") > 0).alias("emotive"), F.sum(F.size("pairs")).alias("n_pairs"), F.round(F.avg(F.size("pairs")), 6).alias("per_comment"), F.count_if(F.size("pairs") >= 8).alias("at_cap"))
)
q("agg27_distributions", "SELECT annotator, p.emotion, p.cause_category AS cause, count(*) AS n FROM (SELECT annotator, unnest(pairs) AS p FROM lab) GROUP BY ALL", "lab")(lambda s, d: B.labels(s, d).select("annotator", F.explode("pairs").alias("p")).groupBy("annotator", "p.emotion", F.col("p.cause_category").alias("cause")).agg(F.count(F.lit(1)).alias("n")))
_REP = "WITH f AS (SELECT comment_id, len(pairs)::INT AS n, len(pairs) < 2 AS valid, 1.5 AS cost FROM lab WHERE annotator = 'A'), r AS (SELECT comment_id, len(pairs)::INT AS n, len(pairs) < 2 AS valid, 0.5 AS cost FROM lab WHERE annotator = 'B')"
q("str07_repair_merge", f"{_REP} SELECT f.comment_id, CASE WHEN r.comment_id IS NOT NULL THEN r.n ELSE f.n END AS n_pairs, f.valid OR r.comment_id IS NOT NULL AS valid, r.comment_id IS NOT NULL AS repaired, round(f.cost + coalesce(r.cost, 0), 3)::DOUBLE AS cost FROM f LEFT JOIN r ON r.comment_id = f.comment_id AND NOT f.valid AND r.valid", "lab")(
    lambda s, d: V.repaired(*[B.labels(s, d).where(F.col("annotator") == a).select("comment_id", "pairs", F.array().cast("array<string>").alias("errors"), F.lit(0).alias("fixes"), (F.size("pairs") < 2).alias("valid"), F.lit(c).alias("cost")) for a, c in (("A", 1.5), ("B", 0.5))]).select("comment_id", F.size("pairs").alias("n_pairs"), "valid", "repaired", F.round("cost", 3).alias("cost"))
)


# offsets
def _encoded(s, d):
    it = B.items(s, d).select("id", "body", "parent_body", F.trim(F.concat(F.coalesce("post_title", F.lit("")), F.lit(" "), F.coalesce("post_selftext", F.lit("")))).alias("post"))
    spans = B.labels(s, d).select("comment_id", "annotator", F.posexplode("pairs").alias("i", "p")).select("comment_id", "annotator", "i", F.explode(F.array("p.emotion_span", "p.cause_span")).alias("span")).where("span is not null")
    return spans.join(it, F.col("comment_id") == F.col("id")).withColumn("offset", C.encode_udf("span", "body", "parent_body", "post"))


SAMPLING.add("cod1_indexed")(lambda s, d: B.comments(s, d).select("id", C.indexed_udf("body").alias("x")).select("id", "x.norm", F.size("x.idx").alias("n")))
SAMPLING.add("cod2_encode")(lambda s, d: _encoded(s, d).select("comment_id", "annotator", "i", "span", "offset.*"))
SAMPLING.add("cod3_decode")(lambda s, d: _encoded(s, d).where("offset.src is not null").select("comment_id", "annotator", "i", "span", C.decode_udf("offset", "body", "parent_body", "post").alias("raw")))
SAMPLING.add("cod4_records")(lambda s, d: _encoded(s, d).groupBy("comment_id", "annotator").agg(F.sort_array(F.collect_list(F.struct("i", "offset"))).alias("offsets")))
q("fn01_full_normalize", f"SELECT id, {norm_sql('body')} AS norm FROM c", "c")(lambda s, d: B.comments(s, d).select("id", C.normalize_udf("body").alias("norm")))
q("fn12_first_object", "SELECT event_id, props AS js FROM events")(lambda s, d: B.table(s, d, "events").select("event_id", C.first_object_udf(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done"))).alias("js")))

# tags and examples
_SPN = f"sp AS (SELECT comment_id, annotator, i AS k, s1 AS s, e1 AS e, emotion AS label FROM (SELECT x.*, pairs[x.i].emotion AS emotion FROM ({_LOC_SQL}) x JOIN lab ON lab.comment_id = x.comment_id AND lab.annotator = x.annotator) WHERE s1 IS NOT NULL)"
_TOK = "tw AS (SELECT id AS comment_id, string_split(body, ' ') AS w FROM c WHERE id IN (SELECT comment_id FROM sp)), tk AS (SELECT comment_id, i - 1 AS i, list_sum(list_transform(w[1:i], lambda x: length(x) + 1)) - 1 - length(w[i]) AS a, list_sum(list_transform(w[1:i], lambda x: length(x) + 1)) - 1 AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM tw))"
LABEL = ["comment_id", "annotator"]


def _spans(s, d):
    lab = B.labels(s, d).select(*LABEL, F.posexplode("pairs").alias("p0", "p")).select(*LABEL, (F.col("p0") + 1).alias("i"), F.col("p.emotion").alias("label"), F.col("p.intensity").alias("value"))
    at = _located(s, d).where("s1 is not null").select(*LABEL, "i", F.col("s1").alias("s"), F.col("e1").alias("e"))
    return at.join(lab, [*LABEL, "i"]).withColumnRenamed("i", "k")


def _tokens(s, d):
    who = _spans(s, d).select(F.col("comment_id").alias("id"), "annotator").distinct()
    texts = B.comments(s, d).select("id", "body").join(who, "id").select(F.col("id").alias("comment_id"), "annotator", "body")
    return G.word_tokens(texts, "body", *LABEL)


q("udf07_bio_tags", f"""WITH {_SPN}, {_TOK}, who AS (SELECT DISTINCT comment_id, annotator FROM sp),
    hit AS (SELECT t.comment_id, annotator, t.i, k, label, min(t.i) OVER (PARTITION BY t.comment_id, annotator, k) AS f FROM tk t JOIN sp USING (comment_id) WHERE a < e AND b > s AND a < b),
    lt AS (SELECT comment_id, annotator, i, max_by(CASE WHEN i = f THEN 'B-' ELSE 'I-' END || label, k) AS tag FROM hit GROUP BY 1, 2, 3)
    SELECT comment_id, annotator, i::INT AS i, coalesce(tag, 'O') AS tag FROM tk JOIN who USING (comment_id) LEFT JOIN lt USING (comment_id, annotator, i) WHERE a < b""", "lab", "c")(  # fmt: skip
    lambda s, d: G.bio_tags(_tokens(s, d), _spans(s, d), *LABEL).select(*LABEL, "i", "tag")
)
_RUN = f"WITH tk AS (SELECT event_id AS i, user_id % 20 AS grp, event_type AS category, value AS p FROM events), b AS (SELECT *, (category IS DISTINCT FROM lag(category) OVER (PARTITION BY grp ORDER BY i))::INT AS brk FROM tk), r AS (SELECT *, sum(brk) OVER (PARTITION BY grp ORDER BY i) AS run FROM b)"
q("win07_runs", f"{_RUN} SELECT grp, run::BIGINT AS run, min(category) AS category, min(i) AS s, max(i) + 1 AS e, count(*) AS n, round(avg(p), 6) AS mean_p FROM r GROUP BY 1, 2 HAVING count(*) >= 2")(
    lambda s, d: G.tag_runs(B.table(s, d, "events").select((F.col("user_id") % 20).alias("grp"), F.col("event_id").alias("i"), F.col("event_id").alias("a"), (F.col("event_id") + 1).alias("b"), F.col("event_type").alias("category"), F.col("value").alias("p")), "grp").where("n >= 2").withColumn("mean_p", F.round("mean_p", 6))
)
_NEAR = f"""lc AS ({_LOC_SQL}), em AS (SELECT comment_id, annotator, i, s1 AS s, e1 AS e FROM lc WHERE s1 IS NOT NULL), ca AS (SELECT comment_id, annotator, i AS j, s2 AS s, e2 AS e FROM lc WHERE s2 IS NOT NULL),
    ne AS (SELECT em.comment_id, em.annotator, em.i, ca.j, row_number() OVER (PARTITION BY em.comment_id, em.annotator, em.i ORDER BY greatest(0, ca.s - em.e, em.s - ca.e), ca.j) AS rn FROM em JOIN ca USING (comment_id, annotator)),
    n1 AS (SELECT em.comment_id, em.annotator, em.i, ne.j FROM em LEFT JOIN ne ON ne.comment_id = em.comment_id AND ne.annotator = em.annotator AND ne.i = em.i AND rn = 1)"""


def _nearest(s, d):
    lc = _located(s, d)
    cause = lc.where("s2 is not null").groupBy(*LABEL).agg(F.array_sort(F.collect_list(F.struct("i", F.col("s2").alias("s"), F.col("e2").alias("e")))).alias("causes"))
    return lc.where("s1 is not null").join(cause, LABEL, "left").withColumn("near", G.nearest(F.col("causes"), F.col("s1"), F.col("e1")))


q("joi16_nearest_cause", f"WITH {_NEAR} SELECT comment_id, annotator, i, j FROM n1 WHERE j IS NOT NULL", "lab", "c")(lambda s, d: _nearest(s, d).where("near is not null").select(*LABEL, "i", F.col("near.i").alias("j")))
q("udf08_decoded_pairs", f"WITH {_NEAR} SELECT comment_id, annotator, i, coalesce(j, -1) AS cause FROM n1", "lab", "c")(lambda s, d: _nearest(s, d).select(*LABEL, "i", F.coalesce("near.i", F.lit(-1)).alias("cause")))
q("udf10_reference_pairs", f"WITH {_NEAR} SELECT n1.comment_id, n1.annotator, n1.i, CASE WHEN j IS NULL THEN 'other' ELSE l.pairs[j].cause_category END AS cause FROM n1 JOIN lab l ON l.comment_id = n1.comment_id AND l.annotator = n1.annotator", "lab", "c")(
    lambda s, d: _nearest(s, d).join(B.labels(s, d).select(*LABEL, "pairs"), LABEL).select(*LABEL, "i", F.when(F.col("near").isNull(), "other").otherwise(F.get("pairs", F.col("near.i") - 1)["cause_category"]).alias("cause"))
)
q("udf11_chat_examples", f"SELECT l.comment_id, annotator, len(pairs)::INT AS n_pairs, length({RENDER_SQL}) AS n_user FROM lab l JOIN item ON item.id = l.comment_id", "lab", "item")(
    lambda s, d: B.labels(s, d)
    .join(B.items(s, d), F.col("comment_id") == F.col("id"))
    .select("comment_id", "annotator", F.size("pairs").alias("n_pairs"), F.array(F.struct(F.lit("system").alias("role"), F.lit("label the comment").alias("content")), F.struct(F.lit("user").alias("role"), _render().alias("content")), F.struct(F.lit("assistant").alias("role"), F.to_json(F.struct(R.clean_pairs("pairs").alias("pairs"))).alias("content"))).alias("messages"))
    .select("comment_id", "annotator", "n_pairs", F.length(F.get("messages", F.lit(1))["content"]).alias("n_user"))
)
q("udf12_tagger_examples", f"SELECT comment_id, annotator, count(s1) AS n_emo, count(s2) AS n_cause, count(*) FILTER (s2 IS NULL) AS cause_missing FROM ({_LOC_SQL}) GROUP BY 1, 2", "lab", "c")(lambda s, d: _located(s, d).groupBy(*LABEL).agg(F.count("s1").alias("n_emo"), F.count("s2").alias("n_cause"), F.count_if(F.col("s2").isNull()).alias("cause_missing")))
q("misc12_judge_prompt", f"SELECT l.comment_id, annotator, md5({RENDER_SQL} || chr(10) || chr(10) || 'SPAN: ' || pairs[1].emotion_span) AS digest FROM lab l JOIN item ON item.id = l.comment_id WHERE len(pairs) > 0", "lab", "item")(
    lambda s, d: B.labels(s, d).where("size(pairs) > 0").join(B.items(s, d), F.col("comment_id") == F.col("id")).select("comment_id", "annotator", F.md5(F.concat(_render(), F.lit("\n\nSPAN: "), F.get("pairs", F.lit(0))["emotion_span"])).alias("digest"))
)
