import json

from pyspark.sql import functions as F

from spanloom.plans.scratch import Scratch
from spanloom.sources import jsonl as J
from spanloom.sources import worklist as W
from spanloom.streaming import debate as D
from spanloom.streaming import ingest as I


def test_tolerant_loader(spark, tmp_path):
    pair = {"emotion": "surprise", "cause_category": None, "intensity": None}
    lines = [
        json.dumps({"comment_id": "a", "created_utc": 5, "pairs": [pair, {**pair, "cause_category": "interpersonal"}]}),
        "", "   ", "\x00" + json.dumps({"comment_id": "b", "created_utc": 6, "pairs": [pair]}), json.dumps({"comment_id": "c", "created_utc": None, "pairs": [pair]}),
        json.dumps({"comment_id": "d", "created_utc": 7, "pairs": None}), '{"comment_id": "e", "created_utc": 8, "pairs": [{"emo',
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = sorted(tuple(r) for r in J.load_pairs(spark, str(tmp_path / "x.jsonl")).collect())
    assert got == [("a", 5, "surprise", None, 0.0, False), ("b", 6, "surprise", None, 0.0, False)]


def test_upsert_is_idempotent_over_batches(spark, tmp_path):
    for i, rows in enumerate([[("k", 1, "old"), ("j", 1, "x")], [("k", 3, "new")], [("k", 2, "mid"), ("l", 1, None)]]):
        spark.createDataFrame(rows, "k string, v int, t string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("k string, v int, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = sorted(tuple(r) for r in I.upsert(spark, stream, ["k"], ["v"], Scratch(spark, "t")).collect())
    assert got == [("j", 1, "x"), ("k", 3, "new"), ("l", 1, None)]


def test_replay_keeps_late_rows_and_each_id_once(spark, tmp_path):
    for i, rows in enumerate([[(1, 100), (2, 200)], [(2, 200), (3, 1), (3, 1)], [(None, 5), (4, 150), (1, 100)]]):
        spark.createDataFrame(rows, "id int, ts int").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    got = sorted(tuple(r) for r in I.replay(spark, str(tmp_path / "in/*"), "id int, ts int", "id").collect())
    assert got == [(1, 100), (2, 200), (3, 1), (4, 150)]


def test_bisection_isolates_bad_rows():
    def call(xs):
        if "bad" in xs:
            raise ValueError
        return [x.upper() for x in xs]

    assert I.bisect(["a", "bad", "c", "d"], call) == ["A", None, "C", "D"]
    assert I.bisect(["bad"], call) == [None]


def test_resume_keeps_failed(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    done = spark.createDataFrame([("a", None), ("b", "e")], "id string, error string")
    assert sorted(r.id for r in I.resume(df, done, "id").collect()) == ["b", "c"]


def test_debate_paths():
    say = lambda *v: lambda cid, t: f"VERDICT: {v[min(t, len(v) - 1)]}"
    assert D.play("x", ("p", "q"), None, say("A"))["outcome"] == "consensus"
    split = D.play("x", ("p", "q"), None, lambda c, t: f"VERDICT: {'AB'[t % 2]}")
    assert split["outcome"] == "split" and split["n_turns"] == 6 and split["majority"] is None
    third = D.play("x", ("p", "q"), "r", lambda c, t: f"VERDICT: {'AB'[t % 2] if t < 6 else 'A'}")
    assert third["escalated"] and third["outcome"] == "consensus" and third["consensus"] == "A"
    custom = lambda blocks: lambda c, t: f"- emotion: {blocks[t % 2]}\n\nVERDICT: CUSTOM"
    assert D.play("x", ("p", "q"), None, custom("aa"))["consensus"] == "CUSTOM"
    assert D.play("x", ("p", "q"), None, custom("ab"))["outcome"] == "split"
    assert D.play("x", ("p", "q"), None, say("UNSURE"))["outcome"] == "split"
    replay = D.play("x", ("p", "q"), None, say("B"), prior=["VERDICT: A", "VERDICT: A"])
    assert replay["consensus"] == "A" and replay["n_turns"] == 2


def test_log_checks(spark):
    t = spark.createDataFrame([("a", 0, "m", "m"), ("a", 1, "n", "m"), ("a", 2, "m", "m"), ("b", 0, "m", "m"), ("b", 2, "m", "m")], "comment_id string, turn int, model string, expected string")
    assert sorted((r["comment_id"], r["turn"]) for r in D.valid_prefix(t).collect()) == [("a", 0), ("b", 0), ("b", 2)]
    assert {r["comment_id"]: r["whole"] for r in D.contiguous(t).collect()} == {"a": True, "b": False}


def test_worklist(spark):
    rows = spark.createDataFrame([("a", "text", "CUSTOM", "- emotion: surprise\n  cause_span: null\n  intensity: 0.75\n  sarcasm: yes\n  unknown: 1"), ("b", "t", "A", None)], "comment_id string, body string, final string, block string")
    got = {r["comment_id"]: r for r in W.parse_worklist(W.render_worklist(rows)).collect()}
    assert got["b"]["pairs"] == [] and got["a"]["pairs"][0]["intensity"] == 0.75 and got["a"]["pairs"][0]["sarcasm"] and got["a"]["pairs"][0]["cause_span"] is None
    import pytest

    with pytest.raises(Exception, match="unresolved"):
        W.parse_worklist(W.render_worklist(rows.withColumn("final", F.lit("TBD")))).collect()
