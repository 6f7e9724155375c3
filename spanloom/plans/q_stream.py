"""Queries of sources, sinks, sets, streams and debates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as TK
from ..operators import match as M
from ..operators import relational as R
from ..operators import resample as RS
from ..operators import store as ST
from ..schema import ASSETS, CAUSES, CORPUS_LABEL, EMOTIONS, PAIRS, SOURCES
from ..sources import jsonl as J
from ..sources import retry as RT
from ..sources import state as SS
from ..sources import tail as TL
from ..sources import worklist as W
from ..streaming import archive as A
from ..streaming import debate as D
from ..streaming import ingest as I
from ..streaming import mock as MK
from . import bindings as B
from .bindings import sql
from .q_match import _IAA, TALLY, gold, match_ctes
from .registry import Registry
from .scratch import Scratch
from .tables import table

STREAM = Registry()


def q(name: str, body: str, *views: str):
    return STREAM.add(name, sql(body, *views))


def _corpus(s, d):
    """All current labels as a corpus label file, with broken lines in between."""
    lab = B.labels(s, d).join(B.comments(s, d).select("id", "created_utc", "link_id"), F.col("comment_id") == F.col("id"))
    path = f"{Scratch(s, 'corpus').base}/labels"
    J.write_jsonl(lab.select("comment_id", "created_utc", "link_id", (F.size("pairs") == 0).alias("neutral"), "pairs"), path)
    dirt = s.createDataFrame([("",), ('{"comment_id": "cut off",',), ('\x00{"comment_id": "nul", "created_utc": null, "pairs": []}',), ("not json",)], "value string")
    dirt.coalesce(1).write.mode("append").text(path)
    return path


_CORPUS = "co AS (SELECT l.comment_id, c.created_utc AS ts, p.emotion, p.cause_category AS cause, coalesce(p.intensity, 0) AS intensity, coalesce(p.sarcasm, FALSE) AS sarcasm FROM (SELECT comment_id, unnest(pairs) AS p FROM lab) l JOIN c ON c.id = l.comment_id WHERE created_utc IS NOT NULL AND coalesce(p.cause_category, '') <> 'interpersonal')"
q("src06_load_pairs", f"WITH {_CORPUS} SELECT * FROM co", "lab", "c")(lambda s, d: J.load_pairs(s, _corpus(s, d)))


@q("str11_live_tail", f"WITH {_CORPUS} SELECT emotion, count(*) AS n FROM co GROUP BY 1", "lab", "c")
def str11(s, d):
    """Label files that grow while they are read: half of the labels, with a line cut off, then the other half."""
    scratch = Scratch(s, "live")
    lab = B.labels(s, d).join(B.comments(s, d).select("id", "created_utc", "link_id"), F.col("comment_id") == F.col("id")).select("comment_id", "annotator", "created_utc", "link_id", (F.size("pairs") == 0).alias("neutral"), "pairs")
    path, offsets, out = f"{scratch.base}/labels", {}, None
    for half in (0, 1):
        J.write_jsonl(lab.where(F.pmod(F.xxhash64("comment_id", "annotator"), F.lit(2)) == half), path, "overwrite" if half == 0 else "append")
        s.createDataFrame([('{"comment_id": "cut off",',)], "value string").coalesce(1).write.mode("append").option("lineSep", " ").text(path)
        lines, offsets = TL.tail(s, path, offsets, scratch)
        out = lines if out is None else out.unionByName(lines)
    return J.flat_pairs(J.parse_tolerant(out.select("value", "file", "at"), CORPUS_LABEL)).groupBy("emotion").agg(F.count(F.lit(1)).alias("n"))


q("set01_pooled_files", f"WITH {_CORPUS} SELECT emotion, count(*) * 2 AS n FROM co GROUP BY 1", "lab", "c")(lambda s, d: J.load_pairs(s, [_corpus(s, d), _corpus(s, d)]).groupBy("emotion").agg(F.count(F.lit(1)).alias("n")))


def _scanned(s, d, lab):
    """Label files per model, read in path order; the later record of an id wins."""
    base = Scratch(s, "models").base
    J.write_jsonl(lab.select(F.col("annotator").alias("model"), "comment_id", F.slice("pairs", 1, 0).alias("pairs"), F.lit(0).alias("rev")), f"{base}/a")
    J.write_jsonl(lab.select(F.col("annotator").alias("model"), "comment_id", "pairs", F.lit(1).alias("rev")), f"{base}/b")
    rows = J.parse_tolerant(J.read_lines(s, [f"{base}/a", f"{base}/b"]), f"model string, comment_id string, pairs {B.table(s, d, 'labels').schema['pairs'].dataType.simpleString()}, rev int")
    return J.latest(rows.where("not _bad"), ["model", "comment_id"], ["rev", "file", "at"]).select("model", "comment_id", F.size("pairs").alias("n"))


q("src08_label_scan", "SELECT annotator AS model, comment_id, len(pairs)::INT AS n FROM lab", "lab")(lambda s, d: _scanned(s, d, B.labels(s, d)))


q("src09_sample_scan", "SELECT id, body FROM c", "c")(lambda s, d: J.latest(B.comments(s, d).select("id", "body", "pos"), ["id"], ["pos"]).select("id", "body"))
q("src10_latest_record", "SELECT comment_id, annotator, max(updated_at) AS at FROM (SELECT comment_id, nullif(upper(trim(annotator)), '') AS annotator, updated_at FROM labels) WHERE comment_id IS NOT NULL AND annotator IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: J.latest(table(s, d, "labels").select("comment_id", F.nullif(F.upper(F.trim("annotator")), F.lit("")).alias("annotator"), F.col("updated_at").alias("at")).where("comment_id is not null and annotator is not null"), ["comment_id", "annotator"], ["at"])
)
_INC = "SELECT comment_id, annotator, CASE WHEN n1 % 2 = 0 THEN len(list_filter(pairs, lambda p: p.intensity > 0.5)) ELSE len(pairs) END::INT AS n FROM (SELECT *, ('0x' || substr(md5(comment_id), 32, 1))::INT AS n1 FROM lab)"


def _flagged(s, d):
    """Pairs of every current label, half of the comments with a flag for those included."""
    return B.labels(s, d).select("comment_id", "annotator", F.transform("pairs", lambda p: p.withField("included", F.when(T.half("comment_id") == 0, p["intensity"] > 0.5)).withField("support", F.when(p["intensity"] > 0.5, 2).otherwise(1))).alias("pairs"))


def _keep(s, d, f):
    return _flagged(s, d).select("comment_id", "annotator", F.size(f(F.col("pairs"))).alias("n"))


q("src15_included_or_all", _INC, "lab")(lambda s, d: _keep(s, d, R.keep_included))
q("src16_included_only", "SELECT comment_id, annotator, CASE WHEN n1 % 2 = 0 THEN len(list_filter(pairs, lambda p: p.intensity > 0.5)) ELSE 0 END::INT AS n FROM (SELECT *, ('0x' || substr(md5(comment_id), 32, 1))::INT AS n1 FROM lab)", "lab")(lambda s, d: _keep(s, d, lambda p: R.keep_supported(p, None)))
q("flt06_support_filter", "SELECT comment_id, annotator, len(list_filter(pairs, lambda p: p.intensity > 0.5))::INT AS n FROM lab", "lab")(lambda s, d: _keep(s, d, lambda p: R.keep_supported(p, 2)))
q("flt11_length_budget", "SELECT id FROM c WHERE length(body) // 4 <= 60", "c")(lambda s, d: B.comments(s, d).where(F.floor(F.length("body") / 4) <= 60).select("id"))


STREAM.add("flt11_token_budget")(lambda s, d: B.items(s, d).where(TK.within_budget(s, T.render_item(F.col("post_title"), F.col("post_selftext"), F.col("parent_body"), F.col("body")), 256)).select("id"))


# turn logs from the scripted model
def turns(s, d):
    """Turn logs of all disagreements: scripted content, one row per turn."""
    ab = M.with_matches(B.coded(s, d))
    ids = ab.where(M.disagreement(ab)).select("comment_id")
    mode = F.conv(F.substring(F.md5("comment_id"), 32, 1), 16, 10).cast("int") % 4
    n = F.when(mode == 3, 3).when(mode == 2, 6).otherwise(2)
    t = ids.withColumn("mode", mode).withColumn("turn", F.explode(F.sequence(F.lit(0), n - 1)))
    said = F.when(F.col("mode") == 0, "VERDICT: A").when(F.col("mode") == 1, "VERDICT: B").when(F.col("mode") == 2, F.when(F.col("turn") % 2 == 0, "VERDICT: A").otherwise("VERDICT: B")).otherwise(F.when(F.col("turn") == 0, "VERDICT: UNSURE").otherwise("- emotion: surprise\n  intensity: 0.5\n\nVERDICT: CUSTOM"))
    return t.select("comment_id", "turn", F.concat(F.lit("m"), (F.col("turn") % 2).cast("string")).alias("model"), said.alias("content"))


_TURNS = _IAA + """, tu AS (SELECT comment_id, mode, turn, 'm' || turn % 2 AS model, CASE mode WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN 'A' ELSE 'B' END ELSE CASE WHEN turn = 0 THEN 'UNSURE' ELSE 'CUSTOM' END END AS verdict
    FROM (SELECT comment_id, mode, unnest(range(0, CASE mode WHEN 3 THEN 3 WHEN 2 THEN 6 ELSE 2 END)) AS turn FROM (SELECT comment_id, ('0x' || substr(md5(comment_id), 32, 1))::INT % 4 AS mode FROM dis WHERE differs))),
    po AS (SELECT comment_id, model, max_by(verdict, turn) AS verdict FROM tu GROUP BY 1, 2)"""
q("win05_latest_turn", f"{_TURNS} SELECT comment_id, turn::INT AS turn, model FROM tu", "ab")(lambda s, d: J.latest(turns(s, d).withColumn("rev", F.lit(0)).unionByName(turns(s, d).withColumn("rev", F.lit(1))), ["comment_id", "turn"], ["rev"]).select("comment_id", "turn", "model"))
q("win06_contiguous", f"{_TURNS} SELECT comment_id, count(*) AS n, mode % 2 = 0 AS whole FROM tu WHERE mode % 2 = 0 OR turn > 0 GROUP BY comment_id, mode", "ab")(lambda s, d: D.contiguous(turns(s, d).where((F.conv(F.substring(F.md5("comment_id"), 32, 1), 16, 10).cast("int") % 2 == 0) | (F.col("turn") > 0))))
def _superseded(s, d):
    """The turn logs with rows of an earlier, longer run behind them, and how many turns each debate has."""
    t = turns(s, d)
    n = t.groupBy("comment_id").agg(F.count(F.lit(1)).cast("int").alias("n_turns"))
    old = t.join(n, "comment_id").select("comment_id", (F.col("turn") + F.col("n_turns")).alias("turn"), "model", F.lit("VERDICT: UNSURE").alias("content"))
    return t.unionByName(old), n


q("flt12_stale_turns", f"{_TURNS} SELECT comment_id, turn::INT AS turn, 'VERDICT: ' || verdict AS said FROM tu", "ab")(lambda s, d: D.without_stale(*_superseded(s, d)).select("comment_id", "turn", F.concat(F.lit("VERDICT: "), T.verdict("content")).alias("said")))
q("str09_valid_prefix", f"{_TURNS} SELECT comment_id, count(*) AS n FROM tu WHERE turn < 3 GROUP BY 1", "ab")(
    lambda s, d: D.valid_prefix(turns(s, d).withColumn("expected", F.when(F.col("turn") < 3, F.col("model")).otherwise("other"))).groupBy("comment_id").agg(F.count(F.lit(1)).alias("n"))
)
q("misc13_final_positions", f"{_TURNS} SELECT comment_id, model, verdict FROM po", "ab")(lambda s, d: D.positions(turns(s, d)).select("comment_id", "model", "verdict"))
q("agg52_unanimity", f"{_TURNS} SELECT comment_id, count(DISTINCT verdict) = 1 AS unanimous, CASE WHEN count(DISTINCT verdict) = 1 THEN min(verdict) END AS majority FROM po GROUP BY 1", "ab")(lambda s, d: D.agreement(D.positions(turns(s, d))))
q("agg51_outcomes", f"{_TURNS} SELECT coalesce(m, 'split') AS outcome, count(*) AS n FROM (SELECT comment_id, CASE WHEN count(DISTINCT verdict) = 1 THEN min(verdict) END AS m FROM po GROUP BY 1) GROUP BY 1", "ab")(
    lambda s, d: D.agreement(D.positions(turns(s, d))).groupBy(F.coalesce("majority", F.lit("split")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
)
q("str10_gold_from_debates", f"{_TURNS}, oc AS (SELECT comment_id, CASE WHEN count(DISTINCT verdict) = 1 THEN min(verdict) END AS m FROM po GROUP BY 1) SELECT ab.comment_id, CASE WHEN NOT differs THEN 'AGREED' ELSE coalesce(m, 'SPLIT') END AS final, CASE WHEN NOT differs OR m = 'A' THEN len(pa) WHEN m = 'B' THEN len(pb) WHEN m = 'CUSTOM' THEN 1 ELSE 0 END::INT AS n_pairs FROM ab JOIN dis USING (comment_id) LEFT JOIN oc ON oc.comment_id = ab.comment_id", "ab")(
    lambda s, d: _from_debates(s, d)
)


def _from_debates(s, d):
    """Agreed labels, and for the others what their debate decided."""
    ab = M.with_matches(B.coded(s, d))
    won = D.agreement(D.positions(turns(s, d))).select(F.col("comment_id").alias("w_id"), "majority")
    j = ab.withColumn("differs", M.disagreement(ab)).join(won, F.col("comment_id") == F.col("w_id"), "left")
    m = F.col("majority")
    n = F.when(~F.col("differs") | (m == "A"), F.size("pa")).when(m == "B", F.size("pb")).when(m == "CUSTOM", 1).otherwise(0)
    return j.select("comment_id", F.when(~F.col("differs"), "AGREED").otherwise(F.coalesce(m, F.lit("SPLIT"))).alias("final"), n.alias("n_pairs"))


@STREAM.add("str08_debates")
def str08(s, d):
    """Debates of all disagreements with a scripted model, escalated where they split."""
    ab = M.with_matches(B.coded(s, d))
    return D.debates(ab.where(M.disagreement(ab)))


STREAM.add("misc16_debate_report")(lambda s, d: str08(s, d).groupBy("outcome", "escalated").agg(F.count(F.lit(1)).alias("n"), F.sum("n_questions").alias("n_questions"), F.round(F.avg("n_turns"), 3).alias("mean_turns")))
_FIRST = "list_filter(w, lambda x, i: list_position(w, x) = i)"
q("set07_question_dedup", f"SELECT id, array_to_string({_FIRST}, ' ') AS w FROM (SELECT id, string_split(lower(body), ' ') AS w FROM c)", "c")(lambda s, d: B.comments(s, d).select("id", F.array_join(T.in_first_order(F.split(F.lower("body"), " ")), " ").alias("w")))


@q("set07_debate_questions", f"{_TURNS} SELECT comment_id, ['what is meant?', 'how strong is ' || ((max(turn) // 2)::INT) || '?'] AS questions FROM tu WHERE turn % 2 = 0 GROUP BY 1 HAVING max(turn) > 1 UNION ALL SELECT comment_id, ['what is meant?', 'how strong is 0?'] FROM tu GROUP BY 1 HAVING max(turn) < 2", "ab")
def set07(s, d):
    """The questions of every debate, each at its first place: all even turns ask two, the last one's second is new."""
    t = turns(s, d)
    top = t.groupBy("comment_id").agg(F.max("turn").alias("top"))
    asked = F.concat(F.lit("QUESTION FOR A & B: what is meant?\nQUESTION FOR A AND B: how strong is "), F.floor(F.col("top") / 2).cast("string"), F.lit("?\n"), "content")
    return D.questions(t.join(top, "comment_id").withColumn("content", F.when(F.col("turn") % 2 == 0, asked).otherwise(F.col("content"))))


q("str06_done_ids", "SELECT DISTINCT id FROM c WHERE pos % 3 <> 0", "c")(lambda s, d: B.comments(s, d).withColumn("error", F.when(F.col("pos") % 3 == 0, "e")).where("error is null").select("id").distinct())
q("str05_resume", "SELECT id FROM c WHERE pos % 3 = 0", "c")(lambda s, d: I.resume(B.comments(s, d), B.comments(s, d).withColumn("error", F.when(F.col("pos") % 3 == 0, "e")), "id").select("id"))


def _stub(texts: list[str]) -> list[str]:
    """A model stand-in that fails on a batch holding an empty text."""
    if any(not t for t in texts):
        raise ValueError("empty text")
    return [f"{len(t)}" for t in texts]


q("str04_bisection", "SELECT id, CASE WHEN body <> '' THEN length(body)::VARCHAR END AS output, CASE WHEN body = '' THEN 'failed' END AS error FROM c", "c")(lambda s, d: I.label_batches(B.comments(s, d), _stub, "id", "body"))


def _events_glob(d):
    return f"{d}/events.parq*t"


q("set06_boundary_dedup", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id) = 1")(lambda s, d: I.replay(s, _events_glob(d), table(s, d, "events").schema, "event_id").select("event_id", "event_type"))


def _archive(s, df, label, id_col, ts_col, shows=(0.4, 0.8)):
    """Ingest a table that shows more and more of its rows, in order of time; returns what was taken and the cursor.

    A part ends within a second: of its last second it shows every other id.
    """
    scratch = Scratch(s, label)
    rows = scratch.table(df, "archive")
    out, state = f"{scratch.base}/out", f"{scratch.base}/state/{label}.json"
    ends = [x for x in rows.agg(F.percentile_approx(ts_col, F.array(*[F.lit(x) for x in shows]))).first()[0] or [] if x is not None]
    for end in ends:
        part = rows.where((F.col(ts_col) < end) | ((F.col(ts_col) == end) & (F.pmod(F.xxhash64(id_col), F.lit(2)) == 0)))
        A.ingest(part, state, out, id_col, ts_col, pages=1)
    cursor = A.ingest(rows, state, out, id_col, ts_col)
    return A.ingested(s, out, rows.schema), cursor, state


def _seconds(s, d):
    return table(s, d, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))


q("src01_archive_replay", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL GROUP BY 1")(
    lambda s, d: _archive(s, _seconds(s, d), "events", "event_id", "sec")[0].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))
)


def _cursor_row(s, c):
    return s.createDataFrame([(c.after, c.total, len(c.boundary), c.complete)], "after bigint, total bigint, n_boundary int, complete boolean")


q("str01_cursor", "SELECT max(epoch(ts)::BIGINT) AS after, count(*) AS total, count(DISTINCT event_id) FILTER (epoch(ts)::BIGINT = (SELECT max(epoch(ts)::BIGINT) FROM events))::INT AS n_boundary, TRUE AS complete FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL")(
    lambda s, d: _cursor_row(s, _archive(s, _seconds(s, d), "events", "event_id", "sec")[1])
)


@q("src03_incremental_tail", "SELECT id, CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END AS rev FROM c", "c")
def src03(s, d):
    """Comments from files that are read by offset: all of them, then half again as a second revision."""
    scratch = Scratch(s, "tail")
    path, out, state = f"{scratch.base}/in", f"{scratch.base}/out", f"{scratch.base}/offsets.json"
    rows = B.comments(s, d).select("id", "body", "pos")
    for rev in (0, 1):
        J.write_jsonl(rows.where(f"pos % 2 = 0 or {rev} = 0").select("id", "body", F.lit(rev).alias("rev")), path, "append")
        TL.ingest_tail(s, path, "id string, body string, rev int", ["id"], out, state)
    return TL.upserted(s, out, "id string, body string, rev int", ["id"]).select("id", "rev")


@q("src03_stream_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def src03_stream(s, d):
    """The newest event per user from a stream, upserted batch by batch."""
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(_events_glob(d)).select("user_id", "event_id", "event_type")
    return I.upsert(s, stream, ["user_id"], ["event_id"], Scratch(s, "stream-upsert")).select("user_id", "event_id")


@q("snk07_label_upsert", "SELECT comment_id, annotator, len(pairs)::INT AS n FROM lab", "lab")
def snk07(s, d):
    """Labels upserted by comment and annotator from a stream of revisions."""
    scratch = Scratch(s, "label-upsert")
    B.table(s, d, "labels").select("comment_id", F.nullif(F.upper(F.trim("annotator")), F.lit("")).alias("annotator"), F.coalesce(F.size("pairs"), F.lit(0)).alias("n"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at")).where("comment_id is not null and annotator is not null").repartition(4).write.mode("overwrite").parquet(f"{scratch.base}/in")
    schema = "comment_id string, annotator string, n int, updated_at timestamp_ntz"
    stream = s.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{scratch.base}/in")
    return I.upsert(s, stream, ["comment_id", "annotator"], ["updated_at"], scratch).select("comment_id", "annotator", F.greatest("n", F.lit(0)).alias("n"))


@q("snk08_adjudication_upsert", "SELECT comment_id, max(updated_at) AS updated_at FROM adjudications WHERE comment_id IS NOT NULL GROUP BY 1")
def snk08(s, d):
    scratch = Scratch(s, "adjudication-upsert")
    B.table(s, d, "adjudications").where("comment_id is not null").select("comment_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at")).write.mode("overwrite").parquet(f"{scratch.base}/in")
    stream = s.readStream.schema("comment_id string, updated_at timestamp_ntz").parquet(f"{scratch.base}/in")
    return I.upsert(s, stream, ["comment_id"], ["updated_at"], scratch)


@q("snk09_append_log", "SELECT row_number() OVER (ORDER BY event_id % 2, event_id) AS id, event_id::VARCHAR AS body FROM events")
def snk09(s, d):
    """A log appended twice: the even events, then the odd ones; ids go on."""
    scratch = Scratch(s, "log")
    ev = table(s, d, "events").select("event_id", F.col("event_type").alias("comment_id"), F.lit("x").alias("author"), F.col("event_id").cast("string").alias("body"))
    log = s.createDataFrame([], "id bigint, comment_id string, author string, body string")
    for half in (0, 1):
        log = scratch.table(ST.append_messages(log, ev.where(F.col("event_id") % 2 == half), ["event_id"], scratch), "log")
    return log.select("id", "body")


@q("snk01_jsonl_round_trip", "SELECT id, created_utc, body FROM c", "c")
def snk01(s, d):
    path = f"{Scratch(s, 'jsonl').base}/comments"
    J.write_jsonl(B.comments(s, d).select("id", "created_utc", "body"), path)
    return J.parse_tolerant(J.read_lines(s, path), "id string, created_utc bigint, body string").where("not _bad").select("id", "created_utc", "body")


@q("snk02_csv_round_trip", "SELECT day, ticker, round(close, 4) AS close FROM px", "px")
def snk02(s, d):
    path = f"{Scratch(s, 'csv').base}/prices"
    J.write_csv(B.prices(s, d).select("day", "ticker", F.round("close", 4).alias("close")), path)
    return s.read.schema("day date, ticker string, close double").option("header", True).csv(path)


def _sections(s, d):
    block = "- emotion: surprise\n  emotion_span: x\n  cause_span: null\n  cause_source: null\n  cause_category: unclear\n  target_asset: none\n  intensity: 0.5\n  sarcasm: false"
    rows = B.coded(s, d).join(B.comments(s, d).select(F.col("id").alias("comment_id"), "body"), "comment_id")
    final = F.element_at(F.array(*[F.lit(v) for v in W.VERDICTS]), F.pmod(T.text_pos("comment_id"), F.lit(4)).cast("int") + 1)
    caused = block.replace("cause_span: null\n  cause_source: null", "cause_span: y\n  cause_source: comment")
    own = F.when(T.half("comment_id") == 1, F.lit(caused)).otherwise(F.lit(block))
    return W.render_worklist(rows.select("comment_id", "body", final.alias("final")).withColumn("block", F.when(F.col("final") == "CUSTOM", own)))


STREAM.add("misc17_worklist")(_sections)
q("src24_parse_worklist", "SELECT comment_id, ['A', 'B', 'NEUTRAL', 'CUSTOM'][('0x' || substr(md5(comment_id), 1, 7))::BIGINT % 4 + 1] AS final, CASE WHEN ('0x' || substr(md5(comment_id), 1, 7))::BIGINT % 4 = 3 THEN 1 ELSE 0 END AS n FROM ab JOIN c ON c.id = comment_id", "ab", "c")(
    lambda s, d: W.parse_worklist(_sections(s, d)).select("comment_id", "final", F.size("pairs").alias("n"))
)
STREAM.add("src25_parse_block")(lambda s, d: W.parse_worklist(_sections(s, d)).where("final = 'CUSTOM'").select("comment_id", F.explode("pairs").alias("p")).select("comment_id", "p.*"))
STREAM.add("misc18_review_sheet")(
    lambda s, d: B.labels(s, d).join(B.comments(s, d).select(F.col("id").alias("comment_id"), "body"), "comment_id").groupBy("comment_id", "body").agg(F.array_sort(F.collect_list(F.concat("annotator", F.lit(": "), F.array_join(F.col("pairs.emotion"), ", ")))).alias("lines")).select("comment_id", F.concat(F.lit("### "), "comment_id", F.lit("\n"), "body", F.lit("\n"), F.array_join("lines", "\n")).alias("sheet"))
)


def _paired_tallies(s, d):
    """Per gold comment the tallies of two models; a model without a label for it has no pairs."""

    def tal(who, tag):
        pred = B.labels(s, d).where(F.col("annotator") == who).select(F.col("comment_id").alias("p_id"), F.col("pairs").alias("pb"))
        j = gold(s, d).withColumnRenamed("pairs", "pa").join(pred, F.col("comment_id") == F.col("p_id"), "left")
        t = M.tallies(M.with_matches(j.withColumn("pb", F.coalesce("pb", F.slice("pa", 1, 0)))))
        return t.select("comment_id", (F.col("n_a") + F.col("n_b")).alias(f"d_{tag}"), *[F.col(f"n_{m}").alias(f"{m}_{tag}") for m in METRICS])

    return tal("C01", "a").join(tal("C02", "b"), "comment_id")


METRICS = ("span", "typed", "full")


@STREAM.add("agg24_paired_bootstrap")
def agg24(s, d):
    """Difference of the three F1 between two models against gold: comments drawn with replacement, 2000 times."""
    return RS.paired_f1_bootstrap(Scratch(s, "bootstrap").table(_paired_tallies(s, d)), "comment_id", METRICS)


_REPRO = TALLY + ", " + match_ctes("ab", thr=0.6, tag="o").strip() + ", scr AS (SELECT round(200.0 * sum(n_span) / sum(n_a + n_b), 6) AS now, round(200.0 * (SELECT count(*) FROM mto) / sum(n_a + n_b), 6) AS before FROM tal)"


@q("misc09_reproduction", f"{_REPRO} SELECT now, before, round(abs(now - before), 6) AS delta, abs(now - before) >= 0.6 AS flag FROM scr", "ab")
def misc09(s, d):
    """Deltas of scores under two token rules, flagged where they are large."""
    new = M.micro_f1(M.tallies(M.with_matches(B.coded(s, d)))).select(F.col("pair_f1").alias("now"))
    old = M.micro_f1(M.tallies(M.with_matches(B.coded(s, d), thr=0.6))).select(F.col("pair_f1").alias("before"))
    return new.crossJoin(old).select("now", "before", F.round(F.abs(F.col("now") - F.col("before")), 6).alias("delta"), (F.abs(F.col("now") - F.col("before")) >= 0.6).alias("flag"))


_SWEEP = "WITH th AS (SELECT comment_id || '|' || thr AS k, thr, pa, list_filter(pb, lambda p: p.intensity >= thr) AS pb FROM ab, (VALUES (0.0::DOUBLE), (0.5), (0.7), (0.8), (0.9), (0.95)) t(thr)), " + match_ctes("th", "k", tag="w").strip() + """,
    ty AS (SELECT th.k, count(*) FILTER (pa[i].emotion = pb[j].emotion) AS n FROM mtw JOIN th USING (k) GROUP BY 1)
    SELECT thr, round(200.0 * sum(coalesce(ty.n, 0)) / sum(len(pa) + len(pb)), 6) AS typed_f1 FROM th LEFT JOIN ty USING (k) GROUP BY 1 ORDER BY typed_f1 DESC, thr LIMIT 1"""


@q("udf09_threshold_sweep", _SWEEP, "ab")
def udf09(s, d):
    """The best of six thresholds on intensity by typed F1; the first of equals."""
    ab = B.coded(s, d).withColumn("thr", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 0.7, 0.8, 0.9, 0.95)])))
    cut = ab.withColumn("pb", F.filter("pb", lambda p: p["intensity"] >= F.col("thr")))
    f1 = M.micro_f1(M.tallies(M.with_matches(cut)), "thr")
    return f1.orderBy(F.desc("typed_f1"), "thr").limit(1).select("thr", "typed_f1")


def _sources(s, d):
    return B.items(s, d).select("id", "body", "parent_body", T.post_text("post_title", "post_selftext").alias("post_text"))


def _judged_labels(s, d):
    """Every row of the labels as a request; any annotator is known."""
    raw = B.table(s, d, "labels").select("comment_id", F.nullif(F.upper(F.trim("annotator")), F.lit("")).alias("annotator"), "neutral", "pairs", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
    return ST.judge_labels(raw, _sources(s, d), ["A", "B", *[f"C{i:02}" for i in range(1, 23)]])


@STREAM.add("api04_put_label")
def api04(s, d):
    """The label store after all requests, valid ones only."""
    judged = Scratch(s, "put").table(_judged_labels(s, d).drop("errors"))
    return ST.put_labels(judged.limit(0), judged).select("comment_id", "annotator", "neutral", F.size("pairs").alias("n_pairs"))


q("api04_refused_empty", "SELECT comment_id, nullif(upper(trim(annotator)), '') AS annotator, count(*) AS n FROM labels WHERE NOT coalesce(neutral, FALSE) AND coalesce(len(pairs), 0) = 0 GROUP BY 1, 2")(
    lambda s, d: _judged_labels(s, d).where(F.array_contains("errors", "pairs: none, and not neutral")).groupBy("comment_id", "annotator").agg(F.count(F.lit(1)).alias("n"))
)


@STREAM.add("api10_put_adjudication")
def api10(s, d):
    """The store of adjudications after all requests; A and B copy the stored label."""
    raw = B.table(s, d, "adjudications").select("comment_id", "final", "pairs", "resolved_by", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
    judged = Scratch(s, "adjudicate").table(ST.judge_adjudications(raw, B.labels(s, d), _sources(s, d)).drop("errors"))
    return ST.put_adjudications(judged.limit(0), judged).select("comment_id", "final", "neutral", F.size("pairs").alias("n_pairs"))


@q("api09_messages", f"{_TURNS} SELECT comment_id, row_number() OVER (ORDER BY comment_id, turn) AS id, model AS author FROM tu", "ab")
def api09(s, d):
    """The turns appended to an empty message log; their ids list them per comment."""
    scratch = Scratch(s, "messages")
    said = turns(s, d).select("comment_id", "turn", F.col("model").alias("author"), F.concat(F.lit("  "), "content").alias("body"))
    blank = said.withColumn("body", F.lit(" "))
    log = ST.append_messages(s.createDataFrame([], "id bigint, comment_id string, author string, body string"), said.unionByName(blank), ["comment_id", "turn"], scratch)
    return log.select("comment_id", "id", "author")


# the mock model: decided by the first hexadecimal digits of the id's MD5
_MOCK = "('0x' || substr(md5(id), 1, 7))::BIGINT"


def mocked(s, d, only=None):
    """Raw output of the mock model per comment, or per comment with an ``id`` of ``only``, with the texts that it saw."""
    it = B.items(s, d, only).select("id", "body", "post_title", "parent_body", T.post_text("post_title", "post_selftext").alias("post_text"))
    return it.withColumn("raw", MK.mock_output("id", "post_title", "body"))


@q("udf03_stub_model", f"SELECT id, CASE WHEN h % 10 = 0 THEN 'bad' WHEN h % 4 = 0 AND trim(body) <> '' THEN 'pair' ELSE 'none' END AS kind FROM (SELECT id, body, {_MOCK} AS h FROM c)", "c")
def udf03(s, d):
    """What the mock model answers: a span that isn't in the text, a pair, or none."""
    pairs = MK.parse_output("raw")
    kind = F.when(F.size(pairs) == 0, "none").when(F.get(pairs, F.lit(0))["emotion_span"] == MK.BAD_SPAN, "bad").otherwise("pair")
    return mocked(s, d).select("id", kind.alias("kind"))


@q("udf03_mock_is_valid", f"SELECT id, h % 10 <> 0 AS valid FROM (SELECT id, {_MOCK} AS h FROM c)", "c")
def udf03_valid(s, d):
    """Whether the mock's answers keep the scheme: all but the planted bad spans do, once sources are corrected."""
    from ..operators.validate import validate

    return validate(mocked(s, d).withColumn("pairs", MK.parse_output("raw"))).select("id", "valid")


@STREAM.add("udf16_infer_and_score")
def udf16(s, d):
    """The mock's raw output for the items of gold parsed, validated (invalid pairs dropped) and scored against gold."""
    from ..operators.validate import validate

    # the model is asked about gold's items alone; gold and the scored items are needed twice, so both are written once
    scratch = Scratch(s, "infer")
    wanted = scratch.table(gold(s, d).select("comment_id", "pairs"))
    fixed = validate(mocked(s, d, wanted.select(F.col("comment_id").alias("id"))).withColumn("pairs", MK.parse_output("raw")), drop_invalid=True)
    parsed = fixed.select(F.col("id").alias("p_id"), F.col("pairs").alias("pb"), "valid")
    j = wanted.withColumnRenamed("pairs", "pa").join(parsed, F.col("comment_id") == F.col("p_id"), "left").withColumn("pb", F.coalesce("pb", F.array().cast(PAIRS)))
    t = scratch.table(M.tallies(M.with_matches(j)).select("valid", "n_a", "n_b", "n_span", "n_typed", "n_full"))
    return M.micro_f1(t).crossJoin(t.agg(F.count_if(~F.coalesce("valid", F.lit(True))).alias("n_invalid"), F.round(F.avg(((F.col("n_a") == 0) == (F.col("n_b") == 0)).cast("int")), 6).alias("neutral_accuracy")))


@STREAM.add("str03_labelling_loop")
def str03(s, d):
    """A labelling stream: every micro-batch calls the stub and writes below its batch id."""
    scratch = Scratch(s, "labelling")
    B.comments(s, d).select("id", "body").repartition(4).write.parquet(f"{scratch.base}/in")
    out = f"{scratch.base}/out"

    def sink(batch, batch_id):
        I.label_batches(batch, _stub, "id", "body").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = s.readStream.schema("id string, body string").option("maxFilesPerTrigger", 2).parquet(f"{scratch.base}/in")
    I.run_to_end(stream.writeStream.foreachBatch(sink), f"{scratch.base}/checkpoint")
    return s.read.schema("id string, output string, error string, batch bigint").parquet(out).select("id", "output", "error")


@q("str02_resume_offsets", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def str02(s, d):
    """Two runs over one checkpoint: the second continues where the first stopped, nothing appears twice."""
    scratch = Scratch(s, "resume")
    ev = table(s, d, "events").select("event_id", "user_id")
    for half in (0, 1):
        ev.where(F.col("event_id") % 2 == half).write.mode("overwrite").parquet(f"{scratch.base}/in/part={half}")
        stream = s.readStream.schema("event_id bigint, user_id bigint").parquet(f"{scratch.base}/in/*")
        I.run_to_end(stream.writeStream.format("parquet").option("path", f"{scratch.base}/out"), f"{scratch.base}/checkpoint")
    return s.read.schema("event_id bigint, user_id bigint").parquet(f"{scratch.base}/out").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_ids"))


@STREAM.add("snk03_commit_log")
def snk03(s, d):
    """The committed batches of a finished stream: one commit file per batch, written atomically."""
    scratch = Scratch(s, "commits")
    table(s, d, "events").select("event_id").repartition(3).write.parquet(f"{scratch.base}/in")
    stream = s.readStream.schema("event_id bigint").option("maxFilesPerTrigger", 1).parquet(f"{scratch.base}/in")
    I.run_to_end(stream.writeStream.format("parquet").option("path", f"{scratch.base}/out"), f"{scratch.base}/checkpoint")
    log = s.read.format("binaryFile").load(f"{scratch.base}/checkpoint/commits")
    return log.select(F.regexp_extract("path", r"([0-9]+)$", 1).cast("int").alias("batch"), "length")


@q(
    "misc01_ingest_states",
    """SELECT 'comments' AS stream, max(created_utc) AS after, count(*) AS total, TRUE AS complete FROM comments WHERE id IS NOT NULL AND created_utc IS NOT NULL
    UNION ALL SELECT 'posts', max(created_utc), count(*), TRUE FROM posts WHERE id IS NOT NULL AND created_utc IS NOT NULL""",
)
def misc01(s, d):
    """The stored states of two ingests, each in a file of its own."""
    rows = []
    for name in ("posts", "comments"):
        df = table(s, d, name).select("id", "created_utc")
        state = SS.read_state(s, _archive(s, df, name, "id", "created_utc", shows=())[2])
        rows.append((name, state["after"], state["total"], state["complete"]))
    return s.createDataFrame(rows, "stream string, after bigint, total bigint, complete boolean")


@q(
    "misc02_ingest_status",
    """SELECT stream, n AS saved, strftime(make_timestamp(after * 1000000), '%Y-%m-%d') AS day, TRUE AS complete FROM (
    SELECT 'comments' AS stream, max(created_utc) AS after, count(*) AS n FROM comments WHERE id IS NOT NULL AND created_utc IS NOT NULL
    UNION ALL SELECT 'posts', max(created_utc), count(*) FROM posts WHERE id IS NOT NULL AND created_utc IS NOT NULL)""",
)
def misc02(s, d):
    """How far each ingest has come: records saved, the day of its cursor, whether it is complete."""
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("after") / 86400).cast("int")), "yyyy-MM-dd")
    return misc01(s, d).select("stream", F.col("total").alias("saved"), day.alias("day"), "complete")


_SCHEME = {"emotion": EMOTIONS, "cause_source": SOURCES, "cause_category": CAUSES, "target_asset": ASSETS}
q("api01_schema", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i}, '{v}')" for f, vs in _SCHEME.items() for i, v in enumerate(vs)) + ") t(field, position, value)")(
    lambda s, d: s.createDataFrame([(f, i, v) for f, vs in _SCHEME.items() for i, v in enumerate(vs)], "field string, position int, value string")
)


def _flaky(calls: dict):
    """An archive that fails now and then: by the key's last digit with a passing status, a broken line, or for good."""

    def fetch(key: str) -> tuple[int, str]:
        n = calls[key] = calls.get(key, 0) + 1
        kind = int(key[-1], 16) % 4
        if kind == 3:
            return 404, ""
        if n <= kind:
            return (503, "") if n == 1 else (200, "{cut")
        return 200, f'{{"key": "{key}"}}'

    return fetch


@q("src02_retrying_get", """SELECT key, CASE WHEN kind < 3 THEN '{"key": "' || key || '"}' END AS answer, CASE kind WHEN 1 THEN 2.0 WHEN 2 THEN 5.0 ELSE 0.0 END AS waited
    FROM (SELECT key, ('0x' || substr(key, 32, 1))::INT % 4 AS kind FROM (SELECT md5(id) AS key FROM c))""", "c")  # fmt: skip
def src02(s, d):
    """Every comment's record asked of an archive that fails now and then; the waits are added up instead of slept."""
    return RT.fetch_all(B.comments(s, d).select(F.md5("id").alias("key")), "key", _flaky({}), sleep=lambda _: None)


@q("snk03_atomic_state", "SELECT 3 AS version, 1 AS n_files")
def snk03_state(s, d):
    """A state that is replaced three times: readers see the last version, and no other file is left."""
    path = f"{Scratch(s, 'state').base}/state.json"
    for version in (1, 2, 3):
        SS.write_state(s, path, {"version": version})
    return s.createDataFrame([(SS.read_state(s, path)["version"], len(SS.file_sizes(s, path.rsplit("/", 1)[0])))], "version int, n_files int")


@STREAM.add("snk04_one_writer_per_task")
def snk04(s, d):
    """Lines appended by several jobs: every task writes files of its own, so no lock is shared."""
    path = f"{Scratch(s, 'append').base}/log"
    for k in range(2):
        J.write_jsonl(turns(s, d).where(F.col("turn") % 2 == k), path, "append")
    return J.read_lines(s, path).groupBy().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("n_files"))


@STREAM.add("snk05_markdown_report")
def snk05(s, d):
    """The agreement report as Markdown lines, rendered from one row of figures."""
    from .q_match import agg22

    r = agg22(s, d)
    line = lambda label, col: F.concat(F.lit(f"- {label}: "), F.col(col).cast("string"))
    lines = F.array(F.lit("# Agreement of two annotators"), line("comments", "n"), line("matched pairs", "matched"), line("span F1", "span_f1"), line("relaxed span F1", "span_f1_relaxed"), line("comments that differ", "n_differ"))
    return r.select(F.posexplode(lines).alias("line_no", "line"))
