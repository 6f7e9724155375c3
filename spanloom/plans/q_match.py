"""Queries of matching, agreement, voting and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import match as M
from ..operators import voting as V
from . import bindings as B
from .bindings import containment_sql, iou_sql, sql, tokens_sql
from .registry import Registry
from .scratch import Scratch

MATCH = Registry()


def q(name: str, body: str, *views: str):
    return MATCH.add(name, sql(body, *views))


def match_ctes(src: str, k: str = "comment_id", thr: float = 0.5, relaxed: bool = False, tag: str = "", order: str = "DESC") -> str:
    """Relations ``mt{tag}(k, i, j, s)``: the greedy matches of the arrays pa and pb of ``src``; positions from 1."""
    score = containment_sql("ta", "tb") if relaxed else iou_sql("ta", "tb")
    return f"""
    ta{tag} AS (SELECT {k} AS k, i, {tokens_sql("pa[i].emotion_span")} AS ta FROM (SELECT *, unnest(range(1, len(pa) + 1)) AS i FROM {src})),
    tb{tag} AS (SELECT {k} AS k, j, {tokens_sql("pb[j].emotion_span")} AS tb FROM (SELECT *, unnest(range(1, len(pb) + 1)) AS j FROM {src})),
    sc{tag} AS (SELECT a.k, i, j, {score} AS s FROM ta{tag} a JOIN tb{tag} b ON a.k = b.k),
    cand{tag} AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, i {order}, j {order}) AS rn FROM sc{tag} WHERE s >= {thr}),
    go{tag}(k, rn, ua, ub, took) AS (
      SELECT DISTINCT k, 0::BIGINT, []::BIGINT[], []::BIGINT[], FALSE FROM cand{tag}
      UNION ALL
      SELECT g.k, c.rn, CASE WHEN ok THEN list_append(ua, c.i) ELSE ua END, CASE WHEN ok THEN list_append(ub, c.j) ELSE ub END, ok
      FROM go{tag} g JOIN cand{tag} c ON c.k = g.k AND c.rn = g.rn + 1, LATERAL (SELECT NOT list_contains(g.ua, c.i) AND NOT list_contains(g.ub, c.j) AS ok)),
    mt{tag} AS (SELECT c.k, c.i, c.j, c.s FROM go{tag} g JOIN cand{tag} c ON c.k = g.k AND c.rn = g.rn WHERE took)"""


AB = "WITH " + match_ctes("ab").strip()
#: matched pairs of two annotators with both pairs
ABX = AB + ", mx AS (SELECT m.k AS comment_id, m.i, m.j, m.s, ab.pa[m.i] AS x, ab.pb[m.j] AS y FROM mt m JOIN ab ON ab.comment_id = m.k)"
TALLY = ABX + """, tal AS (SELECT ab.comment_id, len(pa) AS n_a, len(pb) AS n_b, coalesce(n_span, 0) AS n_span, coalesce(n_typed, 0) AS n_typed, coalesce(n_full, 0) AS n_full
  FROM ab LEFT JOIN (SELECT comment_id, count(*) AS n_span, count(*) FILTER (x.emotion = y.emotion) AS n_typed, count(*) FILTER (x.emotion = y.emotion AND x.cause_category = y.cause_category) AS n_full FROM mx GROUP BY 1) t USING (comment_id))"""
F1 = "count(*) AS n, round(coalesce(200.0 * sum(n_span) / nullif(sum(n_a + n_b), 0), 0), 6) AS pair_f1, round(coalesce(200.0 * sum(n_typed) / nullif(sum(n_a + n_b), 0), 0), 6) AS typed_f1, round(coalesce(200.0 * sum(n_full) / nullif(sum(n_a + n_b), 0), 0), 6) AS full_f1"


def kappa_sql(rows: str, a: str, b: str, keys: str = "") -> str:
    """Cohen's kappa over the statement ``rows``, per ``keys``."""
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON TRUE"
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""WITH r AS ({rows}), per AS (SELECT {k}{a} AS va, {b} AS vb, count(*) AS c FROM r GROUP BY ALL),
    n AS (SELECT {k}sum(c) AS n, sum(c) FILTER (va IS NOT DISTINCT FROM vb) AS same FROM per {grp}),
    ma AS (SELECT {k}va AS v, sum(c) AS ca FROM per GROUP BY ALL), mb AS (SELECT {k}vb AS v, sum(c) AS cb FROM per GROUP BY ALL),
    ch AS (SELECT {k}sum(ca * cb) AS p FROM ma JOIN mb USING ({k}v) {grp}),
    f AS (SELECT {k}n, coalesce(same, 0)::DOUBLE / n AS po, coalesce(p::DOUBLE / (n * n), 0) AS pe FROM n LEFT JOIN ch {using} WHERE n > 0)
    SELECT {k}n::BIGINT AS n, round(po, 6) AS po, round(pe, 6) AS pe, round(CASE WHEN pe >= 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM f"""


def _ab(s, d, **kw):
    return M.with_matches(B.coded(s, d), **kw)


def _mx(s, d):
    return M.matched_pairs(_ab(s, d))


q("joi15_greedy_match", f"{AB} SELECT k AS comment_id, i - 1 AS i, j - 1 AS j, round(s, 6) AS score FROM mt", "ab")(lambda s, d: _ab(s, d).select("comment_id", F.explode("m").alias("m")).select("comment_id", "m.i", "m.j", F.round("m.s", 6).alias("score")))
q("joi15_relaxed_match", "WITH " + match_ctes("ab", thr=0.8, relaxed=True).strip() + " SELECT k AS comment_id, i - 1 AS i, j - 1 AS j, round(s, 6) AS score FROM mt", "ab")(
    lambda s, d: _ab(s, d, thr=0.8, relaxed=True).select("comment_id", F.explode("m").alias("m")).select("comment_id", "m.i", "m.j", F.round("m.s", 6).alias("score"))
)
q("fn30_lowest_first_match", "WITH " + match_ctes("ab", order="ASC").strip() + " SELECT k AS comment_id, i - 1 AS i, j - 1 AS j, round(s, 6) AS score FROM mt", "ab")(
    lambda s, d: _ab(s, d, lowest_first=True).select("comment_id", F.explode("m").alias("m")).select("comment_id", "m.i", "m.j", F.round("m.s", 6).alias("score"))
)
q("agg21_tallies", f"{TALLY} SELECT * FROM tal", "ab")(lambda s, d: M.tallies(_ab(s, d)).select("comment_id", "n_a", "n_b", "n_span", "n_typed", "n_full"))
q("agg18_micro_f1", f"{TALLY} SELECT {F1} FROM tal", "ab")(lambda s, d: M.micro_f1(M.tallies(_ab(s, d))))
q("agg20_tagger_f1", f"{TALLY} SELECT sum(n_a)::BIGINT AS n_gold, sum(n_b)::BIGINT AS n_pred, round(2.0 * sum(n_span) / sum(n_a + n_b), 4) AS span_f1, round(2.0 * sum(n_typed) / sum(n_a + n_b), 4) AS typed_f1, round(2.0 * sum(n_full) / sum(n_a + n_b), 4) AS full_f1 FROM tal", "ab")(
    lambda s, d: M.tallies(_ab(s, d)).agg(F.sum("n_a").cast("bigint").alias("n_gold"), F.sum("n_b").cast("bigint").alias("n_pred"), *[F.round(2.0 * F.sum(f"n_{k}") / F.sum(F.col("n_a") + F.col("n_b")), 4).alias(f"{k}_f1") for k in ("span", "typed", "full")])
)
q("agg16_kappa_neutral", kappa_sql("SELECT na, nb FROM ab", "na", "nb"), "ab")(lambda s, d: M.kappa(B.coded(s, d), "na", "nb"))
_FIELDS = "SELECT 'emotion' AS field, x.emotion AS a, y.emotion AS b FROM mx UNION ALL SELECT 'cause_category', x.cause_category, y.cause_category FROM mx"


def _fields(s, d):
    return _mx(s, d).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").alias("a"), F.col(f"y.{f}").alias("b")) for f in ("emotion", "cause_category")])).alias("z")).select("z.*")


q("agg16_kappa_fields", ABX + ", " + kappa_sql(_FIELDS, "a", "b", "field")[5:], "ab")(lambda s, d: M.kappa(_fields(s, d), "a", "b", "field"))

_IAA = f"""{TALLY}, {match_ctes("ab", thr=0.8, relaxed=True, tag="r").strip()},
    fm AS (SELECT comment_id, bool_or(x.emotion IS DISTINCT FROM y.emotion OR x.cause_category IS DISTINCT FROM y.cause_category) AS fm FROM mx GROUP BY 1),
    dis AS (SELECT ab.comment_id, (na <> nb) OR n_span <> n_a OR n_span <> n_b OR coalesce(fm, FALSE) AS differs FROM ab JOIN tal USING (comment_id) LEFT JOIN fm USING (comment_id))"""


def _differing(s, d):
    df = _ab(s, d)
    return df.withColumn("differs", M.disagreement(df))


@q("agg22_iaa", _IAA + """ SELECT count(*) AS n, sum(n_a)::BIGINT AS a_pairs, sum(n_b)::BIGINT AS b_pairs, sum(n_span)::BIGINT AS matched, (SELECT count(*) FROM mtr) AS matched_relaxed,
    round(2.0 * sum(n_span) / sum(n_a + n_b), 6) AS span_f1, round(2.0 * (SELECT count(*) FROM mtr) / sum(n_a + n_b), 6) AS span_f1_relaxed, (SELECT count(*) FROM dis WHERE differs) AS n_differ FROM tal""", "ab")  # fmt: skip
def agg22(s, d):
    df = M.with_matches(_differing(s, d), thr=0.8, relaxed=True, out="mr")
    pairs = F.sum(F.size("pa") + F.size("pb"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("pa")).alias("a_pairs"), F.sum(F.size("pb")).alias("b_pairs"), F.sum(F.size("m")).alias("matched"), F.sum(F.size("mr")).alias("matched_relaxed"), F.round(2.0 * F.sum(F.size("m")) / pairs, 6).alias("span_f1"), F.round(2.0 * F.sum(F.size("mr")) / pairs, 6).alias("span_f1_relaxed"), F.count_if("differs").alias("n_differ"))


q("agg22_disagreements", _IAA + " SELECT comment_id FROM dis WHERE differs", "ab")(lambda s, d: _differing(s, d).where("differs").select("comment_id"))
RESOLVED = "res AS (SELECT DISTINCT comment_id FROM adjudications WHERE comment_id IS NOT NULL AND upper(trim(final)) IN ('A', 'B', 'NEUTRAL', 'CUSTOM'))"
_res = lambda s, d: B.table(s, d, "adjudications").where("comment_id is not null and upper(trim(final)) in ('A', 'B', 'NEUTRAL', 'CUSTOM')").select("comment_id").distinct()
q("api05_disagreement_progress", f"{_IAA}, {RESOLVED} SELECT x.comment_id, r.comment_id IS NOT NULL AS done FROM (SELECT comment_id FROM dis WHERE differs) x LEFT JOIN res r ON r.comment_id = x.comment_id", "ab")(
    lambda s, d: _differing(s, d).where("differs").select("comment_id").join(_res(s, d).select(F.col("comment_id").alias("r")), F.col("comment_id") == F.col("r"), "left").select("comment_id", F.col("r").isNotNull().alias("done"))
)
q("api07_adjudication_progress", f"{_IAA}, {RESOLVED} SELECT count(*) FILTER (comment_id IN (SELECT comment_id FROM res)) AS resolved, count(*) AS total FROM dis WHERE differs", "ab")(
    lambda s, d: _differing(s, d).where("differs").select("comment_id").join(_res(s, d).select(F.col("comment_id").alias("r")), F.col("comment_id") == F.col("r"), "left").agg(F.count("r").alias("resolved"), F.count(F.lit(1)).alias("total"))
)
q("joi20_missing_adjudication", f"{_IAA}, {RESOLVED} SELECT comment_id FROM dis WHERE differs AND comment_id NOT IN (SELECT comment_id FROM res)", "ab")(lambda s, d: _differing(s, d).where("differs").select("comment_id").join(_res(s, d), "comment_id", "left_anti"))

# the gold record of comments without disagreement is A's, of the others what was resolved
ADJ = "adj AS (SELECT comment_id, final, pairs FROM (SELECT comment_id, upper(trim(final)) AS final, coalesce(pairs, []) AS pairs, row_number() OVER (PARTITION BY comment_id ORDER BY updated_at DESC) AS rn FROM adjudications WHERE comment_id IS NOT NULL AND upper(trim(final)) IN ('A', 'B', 'NEUTRAL', 'CUSTOM')) WHERE rn = 1)"


def adjudicated(s, d):
    raw = B.table(s, d, "adjudications")
    rows = raw.where("comment_id is not null and upper(trim(final)) in ('A', 'B', 'NEUTRAL', 'CUSTOM')").select("comment_id", F.upper(F.trim("final")).alias("final"), F.coalesce("pairs", F.array().cast(raw.schema["pairs"].dataType)).alias("pairs"), F.col("updated_at").alias("at"))
    return rows.groupBy("comment_id").agg(F.max(F.struct("at", "final", "pairs")).alias("m")).select("comment_id", "m.final", "m.pairs")


_GOLD = f"{_IAA}, {ADJ}, gold AS (SELECT ab.comment_id, CASE WHEN NOT differs THEN 'AGREED' ELSE adj.final END AS final, CASE WHEN NOT differs THEN pa ELSE adj.pairs END AS pairs FROM ab JOIN dis USING (comment_id) LEFT JOIN adj USING (comment_id) WHERE NOT differs OR adj.final IS NOT NULL)"


def gold(s, d):
    df = _differing(s, d).join(adjudicated(s, d).withColumnsRenamed({"comment_id": "a_id", "pairs": "a_pairs"}), F.col("comment_id") == F.col("a_id"), "left")
    df = df.where("not differs or final is not null")
    return df.select("comment_id", F.when(~F.col("differs"), "AGREED").otherwise(F.col("final")).alias("final"), F.when(~F.col("differs"), F.col("pa")).otherwise(F.col("a_pairs")).alias("pairs"))


q("set08_gold", f"{_GOLD} SELECT comment_id, final, len(pairs) AS n_pairs FROM gold", "ab")(lambda s, d: gold(s, d).select("comment_id", "final", F.size("pairs").alias("n_pairs")))
q("api11_export", f"{_GOLD} SELECT comment_id, final, len(pairs) = 0 AS neutral FROM gold", "ab")(lambda s, d: gold(s, d).select("comment_id", "final", (F.size("pairs") == 0).alias("neutral")))

# scoring against gold, missing predictions penalised
_SCORED = f"{_GOLD}, gp AS (SELECT g.comment_id, g.pairs AS pa, coalesce(l.pairs, []) AS pb FROM gold g LEFT JOIN lab l ON l.comment_id = g.comment_id AND l.annotator = 'C01'), {match_ctes('gp', tag='g').strip()}"


def _gold_vs(s, d, who="C01"):
    pred = B.labels(s, d).where(F.col("annotator") == who).select(F.col("comment_id").alias("p_id"), F.col("pairs").alias("pb"))
    j = gold(s, d).withColumnRenamed("pairs", "pa").join(pred, F.col("comment_id") == F.col("p_id"), "left")
    return M.with_matches(j.withColumn("pb", F.coalesce("pb", F.slice("pa", 1, 0))))


q("joi08_gold_left_predictions", f"{_GOLD} SELECT g.comment_id, len(coalesce(l.pairs, [])) AS n_pred FROM gold g LEFT JOIN lab l ON l.comment_id = g.comment_id AND l.annotator = 'C01'", "ab")(lambda s, d: _gold_vs(s, d).select("comment_id", F.size("pb").alias("n_pred")))
q("agg19_prediction_vs_gold", f"{_SCORED} SELECT count(*) AS n, sum(len(pa))::BIGINT AS n_gold, sum(len(pb))::BIGINT AS n_pred, round(200.0 * (SELECT count(*) FROM mtg) / sum(len(pa) + len(pb)), 6) AS pair_f1 FROM gp", "ab")(
    lambda s, d: _gold_vs(s, d).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("pa")).alias("n_gold"), F.sum(F.size("pb")).alias("n_pred"), F.round(200.0 * F.sum(F.size("m")) / F.sum(F.size("pa") + F.size("pb")), 6).alias("pair_f1"))
)
q("agg56_neutral_accuracy", f"{_GOLD} SELECT count(*) AS n, round(avg(((len(g.pairs) = 0) = (len(l.pairs) = 0))::INT), 6) AS accuracy FROM gold g JOIN lab l ON l.comment_id = g.comment_id AND l.annotator = 'C01'", "ab")(
    lambda s, d: gold(s, d).join(B.labels(s, d).where("annotator = 'C01'").select("comment_id", F.col("pairs").alias("pb")), "comment_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.size("pairs") == 0) == (F.size("pb") == 0)).cast("int")), 6).alias("accuracy"))
)

# fields of matched pairs
q("agg26_field_agreement", f"""{ABX} SELECT count(*) FILTER (x.target_asset IS NOT NULL AND y.target_asset IS NOT NULL) AS n_matched, round(avg((x.target_asset = y.target_asset)::INT), 6) AS asset_acc,
    round(corr(x.intensity, y.intensity), 6) AS intensity_r, round(avg(abs(x.intensity - y.intensity)), 6) AS intensity_mae, round(avg((abs(x.intensity - y.intensity) < 1e-9)::INT), 6) AS intensity_exact FROM mx""", "ab")(  # fmt: skip
    lambda s, d: _mx(s, d).agg(
        F.count_if(F.col("x.target_asset").isNotNull() & F.col("y.target_asset").isNotNull()).alias("n_matched"),
        F.round(F.avg((F.col("x.target_asset") == F.col("y.target_asset")).cast("int")), 6).alias("asset_acc"),
        F.round(F.corr("x.intensity", "y.intensity"), 6).alias("intensity_r"),
        F.round(F.avg(F.abs(F.col("x.intensity") - F.col("y.intensity"))), 6).alias("intensity_mae"),
        F.round(F.avg((F.abs(F.col("x.intensity") - F.col("y.intensity")) < 1e-9).cast("int")), 6).alias("intensity_exact"),
    )
)
q("agg25_sarcasm_check", f"""{ABX}, f AS (SELECT count(*) AS n, count(*) FILTER (x.sarcasm AND y.sarcasm) AS tp, count(*) FILTER (NOT x.sarcasm AND y.sarcasm) AS fp, count(*) FILTER (x.sarcasm AND NOT y.sarcasm) AS fn FROM mx)
    SELECT n, tp, fp, fn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS prec, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS rec, CASE WHEN tp > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM f""", "ab")(  # fmt: skip
    lambda s, d: _mx(s, d)
    .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("x.sarcasm and y.sarcasm")).alias("tp"), F.count_if(F.expr("not x.sarcasm and y.sarcasm")).alias("fp"), F.count_if(F.expr("x.sarcasm and not y.sarcasm")).alias("fn"))
    .selectExpr("n", "tp", "fp", "fn", "round(try_divide(tp, tp + fp), 6) as prec", "round(try_divide(tp, tp + fn), 6) as rec", "case when tp > 0 then round(2e0 * tp / (2 * tp + fp + fn), 6) end as f1")
)
q("agg25_sarcasm_kappa", ABX + ", " + kappa_sql("SELECT x.sarcasm AS a, y.sarcasm AS b FROM mx", "a", "b")[5:], "ab")(lambda s, d: M.kappa(_mx(s, d).select(F.col("x.sarcasm").alias("a"), F.col("y.sarcasm").alias("b")), "a", "b"))

# three annotators
_H = "h AS (SELECT ab.*, l.pairs AS ph FROM ab JOIN lab l ON l.comment_id = ab.comment_id AND l.annotator = 'C01')"
_TOK = lambda e: tokens_sql(e)
_DEC = f"""{ABX}, {_H}, hp AS (SELECT comment_id, i, ph[i] AS p, {_TOK('ph[i].emotion_span')} AS th FROM (SELECT *, unnest(range(1, len(ph) + 1)) AS i FROM h)),
    al AS (SELECT mx.comment_id, mx.i, mx.j, x, y, p, row_number() OVER (PARTITION BY mx.comment_id, mx.i, mx.j ORDER BY s2 DESC, hi DESC) AS rn FROM (
      SELECT mx.*, hp.p, hp.i AS hi, {iou_sql('th', 'tx')} AS s2 FROM (SELECT *, {_TOK('x.emotion_span')} AS tx FROM mx) mx JOIN hp USING (comment_id)) mx WHERE s2 >= 0.5),
    dec AS (SELECT comment_id, 'neutral' AS field, CASE WHEN len(ph) = 0 THEN 'neutral' ELSE 'emotive' END AS human, CASE WHEN na THEN 'neutral' ELSE 'emotive' END AS a, CASE WHEN nb THEN 'neutral' ELSE 'emotive' END AS b FROM h
      UNION ALL SELECT comment_id, 'emotion', p.emotion, x.emotion, y.emotion FROM al WHERE rn = 1
      UNION ALL SELECT comment_id, 'cause_category', p.cause_category, x.cause_category, y.cause_category FROM al WHERE rn = 1)"""


def decisions(s, d):
    """One row per decision that three annotators made about the same thing."""
    ab = M.with_matches(B.coded(s, d))
    third = B.labels(s, d).where("annotator = 'C01'").select(F.col("comment_id").alias("h_id"), F.col("pairs").alias("ph"))
    j = ab.join(third, F.col("comment_id") == F.col("h_id"))
    call = lambda c: F.when(c, "neutral").otherwise("emotive")
    neutral = j.select("comment_id", F.lit("neutral").alias("field"), call(F.size("ph") == 0).alias("human"), call(F.col("na")).alias("a"), call(F.col("nb")).alias("b"))
    m = M.matched_pairs(j).withColumn("px", F.array("x"))
    m = M.with_matches(m, "ph", "px", out="hm").where(F.size("hm") > 0).withColumn("p", F.get("ph", F.get("hm", F.lit(0))["i"]))
    fields = m.select("comment_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p.{f}").alias("human"), F.col(f"x.{f}").alias("a"), F.col(f"y.{f}").alias("b")) for f in ("emotion", "cause_category")])).alias("z")).select("comment_id", "z.*")
    return neutral.unionByName(fields)


q("joi07_three_way", f"{ABX}, {_H} SELECT comment_id, len(pa) AS n_a, len(pb) AS n_b, len(ph) AS n_h FROM h", "ab")(
    lambda s, d: B.coded(s, d).join(B.labels(s, d).where("annotator = 'C01'").select("comment_id", F.size("pairs").alias("n_h")), "comment_id").select("comment_id", F.size("pa").alias("n_a"), F.size("pb").alias("n_b"), "n_h")
)
q("agg23_decisions", f"{_DEC} SELECT comment_id, field, human, a, b FROM dec", "ab")(decisions)
q("agg23_decompose", f"""{_DEC} SELECT coalesce(field, 'ALL') AS field, count(*) AS n, count(*) FILTER (a = b) AS agree, count(*) FILTER (a = b AND human = a) AS validated, count(*) FILTER (a = b AND human <> a) AS shared_bias,
    count(*) FILTER (a <> b) AS ambiguous, count(*) FILTER (a <> b AND human = a) AS backs_a, count(*) FILTER (a <> b AND human = b) AS backs_b, count(*) FILTER (a <> b AND human <> a AND human <> b) AS backs_none FROM dec GROUP BY ROLLUP (field)""", "ab")(  # fmt: skip
    lambda s, d: decisions(s, d)
    .rollup("field")
    .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(e)).alias(n) for n, e in {"agree": "a = b", "validated": "a = b and human = a", "shared_bias": "a = b and human <> a", "ambiguous": "a <> b", "backs_a": "a <> b and human = a", "backs_b": "a <> b and human = b", "backs_none": "a <> b and human <> a and human <> b"}.items()])
    .withColumn("field", F.coalesce("field", F.lit("ALL")))
)
q("top05_most_common_bias", f"{_DEC} SELECT a || ' vs ' || human AS pair, count(*) AS n FROM dec WHERE a = b AND human <> a GROUP BY 1 ORDER BY n DESC, min(comment_id), pair LIMIT 10", "ab")(
    lambda s, d: decisions(s, d).where("a = b and human <> a").groupBy(F.concat("a", F.lit(" vs "), "human").alias("pair")).agg(F.count(F.lit(1)).alias("n"), F.min("comment_id").alias("first")).orderBy(F.desc("n"), "first", "pair").limit(10).select("pair", "n")
)

# models against each other
_ALL_PAIRS = "m4 AS (SELECT a.comment_id || '|' || a.annotator || '|' || b.annotator AS k, a.annotator AS ma, b.annotator AS mb, a.comment_id, a.pairs AS pa, b.pairs AS pb FROM lab a JOIN lab b ON a.comment_id = b.comment_id AND a.annotator < b.annotator WHERE len(a.pairs) + len(b.pairs) > 0)"


@q("agg28_cross_model", f"""WITH {_ALL_PAIRS}, {match_ctes('m4', 'k', tag='n').strip()}, x4 AS (SELECT k, m4.pa[i] AS x, m4.pb[j] AS y FROM mtn JOIN m4 USING (k)),
    c4 AS (SELECT k, count(*) AS n, count(*) FILTER (x.emotion IS NOT DISTINCT FROM y.emotion) AS e, count(*) FILTER (x.cause_category IS NOT DISTINCT FROM y.cause_category) AS c FROM x4 GROUP BY 1)
    SELECT ma, mb, count(*) AS n, round(avg(2.0 * coalesce(c4.n, 0) / (len(pa) + len(pb))), 6) AS match_rate, coalesce(sum(c4.n), 0)::BIGINT AS n_matched, round(sum(e)::DOUBLE / sum(c4.n), 6) AS emotion_agreement, round(sum(c)::DOUBLE / sum(c4.n), 6) AS cause_agreement
    FROM m4 LEFT JOIN c4 USING (k) GROUP BY 1, 2""", "lab")  # fmt: skip
def agg28_all(s, d):
    """Match rate of every two annotators, and how far matched pairs agree on emotion and cause."""
    lab = B.labels(s, d)
    b = lab.select(F.col("comment_id").alias("b_id"), F.col("annotator").alias("mb"), F.col("pairs").alias("pb"))
    j = lab.select("comment_id", F.col("annotator").alias("ma"), F.col("pairs").alias("pa")).join(b, (F.col("comment_id") == F.col("b_id")) & (F.col("ma") < F.col("mb"))).where(F.size("pa") + F.size("pb") > 0)
    same = lambda f: F.size(F.filter("m", lambda t: F.get("pa", t["i"])[f].eqNullSafe(F.get("pb", t["j"])[f])))
    rows = M.with_matches(j).select("ma", "mb", F.size("m").alias("k"), (2.0 * F.size("m") / (F.size("pa") + F.size("pb"))).alias("rate"), same("emotion").alias("e"), same("cause_category").alias("c"))
    share = lambda f: F.round(F.try_divide(F.sum(f), F.sum("k")), 6)
    return rows.groupBy("ma", "mb").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rate"), 6).alias("match_rate"), F.sum("k").alias("n_matched"), share("e").alias("emotion_agreement"), share("c").alias("cause_agreement"))


_SARC_ALL = "fl AS (SELECT comment_id, count(*) FILTER (s) AS yes, count(*) FILTER (NOT s) AS no FROM (SELECT comment_id, coalesce(list_bool_or(list_transform(pairs, lambda p: coalesce(p.sarcasm, FALSE))), FALSE) AS s FROM lab) GROUP BY 1)"
q("agg17_fleiss_sarcasm", f"WITH {_SARC_ALL}, r AS (SELECT *, yes + no AS n FROM fl WHERE yes + no > 1), t AS (SELECT count(*) AS items, avg((yes * yes + no * no - n)::DOUBLE / (n * (n - 1))) AS pb, sum(yes)::DOUBLE / sum(n) AS sy, sum(no)::DOUBLE / sum(n) AS sn FROM r) SELECT items, round(CASE WHEN sy * sy + sn * sn >= 1 THEN 1.0 ELSE (pb - sy * sy - sn * sn) / (1 - sy * sy - sn * sn) END, 6) AS kappa FROM t", "lab")(
    lambda s, d: M.fleiss(B.labels(s, d).withColumn("y", F.exists("pairs", lambda p: F.coalesce(p["sarcasm"], F.lit(False)))).groupBy("comment_id").agg(F.count_if("y").alias("yes"), F.count_if(~F.col("y")).alias("no")), ["yes", "no"])
)

# votes
# votes over the pairs of all annotators that name the same span of a comment, letter case and outer blanks aside
_VOTE = """vp AS (SELECT *, row_number() OVER (PARTITION BY comment_id, span ORDER BY annotator, i) - 1 AS seat FROM (
    SELECT comment_id, annotator, i, pairs[i] AS p, lower(trim(coalesce(pairs[i].emotion_span, ''))) AS span FROM (SELECT *, unnest(range(1, len(pairs) + 1)) AS i FROM lab)))"""
SPAN = ["comment_id", "span"]


def _seats(s, d):
    from pyspark.sql import Window

    pairs = B.labels(s, d).select("comment_id", "annotator", F.posexplode("pairs").alias("i", "pair"))
    pairs = pairs.withColumn("span", F.lower(F.trim(F.coalesce("pair.emotion_span", F.lit("")))))
    return pairs.select(*SPAN, (F.row_number().over(Window.partitionBy(*SPAN).orderBy("annotator", "i")) - 1).alias("seat"), "pair")


@q("agg10_majority_vote", f"""WITH {_VOTE}, long AS ({" UNION ALL ".join(f"SELECT comment_id, span, seat, '{f}' AS f, p.{f}::VARCHAR AS v FROM vp" for f in V.VOTED)}),
    per AS (SELECT comment_id, span, f, v, count(*) AS c, min(seat) AS fs FROM long GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY comment_id, span, f ORDER BY c DESC, fs) AS r FROM per),
    h AS (SELECT comment_id, span, count(*) AS support, count(*) FILTER (p.cause_span IS NULL) AS null_causes, round(avg(p.intensity), 6) AS intensity FROM vp GROUP BY 1, 2)
    SELECT h.*, {", ".join(f"max(v) FILTER (f = '{f}') AS {f}, bool_or(c * 2 <= support) FILTER (f = '{f}') AS {f}_tie" for f in V.VOTED)} FROM h JOIN best USING (comment_id, span) WHERE r = 1 GROUP BY ALL""", "lab")  # fmt: skip
def agg10(s, d):
    return V.vote_fields(_seats(s, d), SPAN)


q("agg11_null_cause_majority", f"WITH {_VOTE} SELECT comment_id, span, count(*) FILTER (p.cause_span IS NULL) * 2 > count(*) AS unclear FROM vp GROUP BY 1, 2", "lab")(lambda s, d: V.null_cause_majority(_seats(s, d), SPAN))
q("agg13_mean_intensity", f"WITH {_VOTE} SELECT comment_id, span, round(avg(p.intensity), 6) AS intensity FROM vp GROUP BY 1, 2", "lab")(lambda s, d: _seats(s, d).groupBy(*SPAN).agg(F.round(F.avg("pair.intensity"), 6).alias("intensity")))


@q("agg12_medoid", f"""WITH ps AS (SELECT comment_id, row_number() OVER (PARTITION BY comment_id ORDER BY annotator, i) AS seat, pairs[i].emotion_span AS span FROM (SELECT *, unnest(range(1, len(pairs) + 1)) AS i FROM lab)),
    sp AS (SELECT comment_id, seat, span, {tokens_sql('span')} AS t FROM ps WHERE coalesce(span, '') <> ''),
    sm AS (SELECT a.comment_id, a.seat, a.span, sum(CASE WHEN a.seat = b.seat THEN 0.0 ELSE {iou_sql('a.t', 'b.t')} END) AS tot FROM sp a JOIN sp b USING (comment_id) GROUP BY ALL)
    SELECT comment_id, round(max(tot), 6) AS best FROM sm GROUP BY 1""", "lab")  # fmt: skip
def agg12(s, d):
    """The summed overlap of the medoid of all emotion spans of each comment."""
    pairs = B.labels(s, d).select("comment_id", "annotator", F.posexplode("pairs").alias("i", "pair"))
    real = pairs.where(F.coalesce("pair.emotion_span", F.lit("")) != "").select("comment_id", "annotator", "i", T.tokens("pair.emotion_span").alias("toks"))
    per = real.groupBy("comment_id").agg(F.array_sort(F.collect_list(F.struct("annotator", "i", "toks"))).alias("spans"))
    return per.select("comment_id", F.round(F.array_max(V.overlaps(F.transform("spans", lambda x: x["toks"]))), 6).alias("best"))


q("agg14_neutrality", "SELECT comment_id, count(*) FILTER (len(pairs) = 0) * 2 > count(*) AS neutral FROM lab GROUP BY 1", "lab")(lambda s, d: B.labels(s, d).groupBy("comment_id").agg((F.count_if(F.size("pairs") == 0) * 2 > F.count(F.lit(1))).alias("neutral")))


def _two_model_clusters(s, d):
    return V.clusters(B.labels(s, d).where(F.col("annotator").isin("A", "B")).select("comment_id", "annotator", "pairs"))


_CL2 = f"{AB}, cl AS (SELECT k AS comment_id, i, j, 2 AS support FROM mt UNION ALL SELECT comment_id, i, NULL, 1 FROM (SELECT comment_id, unnest(range(1, len(pa) + 1)) AS i FROM ab) x WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.k = x.comment_id AND mt.i = x.i) UNION ALL SELECT comment_id, NULL, j, 1 FROM (SELECT comment_id, unnest(range(1, len(pb) + 1)) AS j FROM ab) x WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.k = x.comment_id AND mt.j = x.j))"
q("set09_clusters_two_models", f"{_CL2} SELECT comment_id, support, count(*) AS n FROM cl GROUP BY ALL", "ab")(
    lambda s, d: _two_model_clusters(s, d).join(B.coded(s, d).select("comment_id"), "comment_id", "left_semi").groupBy("comment_id", "cluster").agg(F.count(F.lit(1)).cast("int").alias("support")).groupBy("comment_id", "support").agg(F.count(F.lit(1)).alias("n"))
)
q("agg15_support_histogram_two_models", f"{_CL2} SELECT support, count(*) AS n FROM cl GROUP BY 1", "ab")(
    lambda s, d: _two_model_clusters(s, d).join(B.coded(s, d).select("comment_id"), "comment_id", "left_semi").groupBy("comment_id", "cluster").agg(F.count(F.lit(1)).cast("int").alias("support")).groupBy("support").agg(F.count(F.lit(1)).alias("n"))
)


@MATCH.add("set09_clusters")
def set09(s, d):
    """Clusters over all annotators of every comment."""
    return V.clusters(B.labels(s, d).select("comment_id", "annotator", "pairs")).select("comment_id", "cluster", "annotator", F.col("pair.emotion").alias("emotion"))


CLUSTER = ["comment_id", "cluster"]


def _members(s, d):
    """The members of every cluster over all annotators and pairs."""
    return Scratch(s, "clusters").table(V.clusters(B.labels(s, d).select("comment_id", "annotator", "pairs")), "members")


# votes per matched cluster over all pairs
MATCH.add("agg10_cluster_vote")(lambda s, d: V.vote_fields(_members(s, d), CLUSTER))
MATCH.add("agg11_cluster_null_cause")(lambda s, d: V.null_cause_majority(_members(s, d), CLUSTER))
MATCH.add("agg12_cluster_medoid")(lambda s, d: V.medoids(_members(s, d), CLUSTER))
MATCH.add("agg13_cluster_intensity")(lambda s, d: _members(s, d).groupBy(*CLUSTER).agg(F.round(F.avg("pair.intensity"), 6).alias("intensity")))
MATCH.add("agg15_support_histogram")(lambda s, d: _members(s, d).groupBy(*CLUSTER).agg(F.count(F.lit(1)).cast("int").alias("support")).groupBy("support").agg(F.count(F.lit(1)).alias("n")))
MATCH.add("misc10_cluster_judge_splits")(lambda s, d: V.judge_splits(_members(s, d), CLUSTER))


@MATCH.add("misc11_consensus")
def misc11(s, d):
    """Voted consensus pairs per comment, singletons not included, with the fields left to a judge."""
    members = _members(s, d)
    v = V.vote_fields(members, CLUSTER).join(V.medoids(members, CLUSTER), CLUSTER)
    unclear = F.col("null_causes") * 2 > F.col("support")
    disputes = F.array_compact(F.array(F.when(F.col("emotion_tie"), "emotion"), F.when(F.col("cause_category_tie") & ~unclear, "cause_category")))
    return v.select("comment_id", "cluster", "support", "emotion", F.when(unclear, "unclear").otherwise(F.col("cause_category")).alias("cause_category"), "target_asset", "sarcasm", "intensity", "emotion_span", F.when(~unclear, F.col("cause_span")).alias("cause_span"), (F.col("support") > 1).alias("included"), F.array_join(disputes, ",").alias("disputes"))


def _disputed(s, d, members):
    """Comments with a pair that one annotator alone has, or a cluster without a majority for a judged field."""
    v = V.vote_fields(members, CLUSTER)
    unclear = F.col("null_causes") * 2 > F.col("support")
    return v.where((F.col("support") == 1) | F.col("emotion_tie") | (F.col("cause_category_tie") & ~unclear)).select("comment_id").distinct()


MATCH.add("set04_export_disputed")(lambda s, d: _disputed(s, d, _members(s, d)))
_TIED = "SELECT comment_id FROM mx WHERE x.emotion IS DISTINCT FROM y.emotion OR (x.cause_category IS DISTINCT FROM y.cause_category AND NOT (x.cause_span IS NULL AND y.cause_span IS NULL))"
q("set04_export_disputed_two_models", f"{_CL2.replace(AB, ABX, 1)} SELECT comment_id FROM cl WHERE support = 1 UNION {_TIED}", "ab")(
    lambda s, d: _disputed(s, d, _two_model_clusters(s, d).join(B.coded(s, d).select("comment_id"), "comment_id", "left_semi"))
)
_JUDGED = " UNION ALL ".join(f"SELECT comment_id, span, '{f}' AS field, p.{f} AS v, p.cause_span IS NULL AS none FROM vp" for f in V.JUDGED)
q("misc10_judge_splits", f"""WITH {_VOTE}, per AS (SELECT comment_id, span, field, v, count(*) AS c, count(*) FILTER (none) AS none FROM ({_JUDGED}) GROUP BY 1, 2, 3, 4),
    t AS (SELECT comment_id, span, field, sum(c) AS n, max(c) AS top, sum(none) AS none, array_to_string(list_sort(coalesce(list(v) FILTER (v <> ''), [])), ',') AS cands FROM per GROUP BY 1, 2, 3),
    w AS (SELECT *, CASE WHEN field = 'cause_category' AND none * 2 > n THEN none ELSE top END AS won FROM t) SELECT comment_id, span, field, cands FROM w WHERE won * 2 > n AND won < n""", "lab")(  # fmt: skip
    lambda s, d: V.judge_splits(_seats(s, d), SPAN)
)
q("agg58_candidate_pool", "SELECT comment_id, p.emotion AS candidate, count(DISTINCT annotator) AS backing, array_to_string(list_sort(list(DISTINCT annotator)), ',') AS backers FROM (SELECT comment_id, annotator, unnest(pairs) AS p FROM lab) GROUP BY 1, 2", "lab")(
    lambda s, d: B.labels(s, d).select("comment_id", "annotator", F.explode("pairs").alias("p")).groupBy("comment_id", F.col("p.emotion").alias("candidate")).agg(F.countDistinct("annotator").alias("backing"), F.array_join(F.array_sort(F.collect_set("annotator")), ",").alias("backers"))
)
