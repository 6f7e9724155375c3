"""Requests against stores, debate logs and the mock model on fixtures."""

from spanloom.operators import store as S
from spanloom.plans.scratch import Scratch
from spanloom.schema import PAIRS
from spanloom.streaming import debate as D
from spanloom.streaming import mock as K

ITEMS = "id string, body string, parent_body string, post_text string"
REQ = f"comment_id string, annotator string, neutral boolean, pairs {PAIRS}, updated_at int, extra string"
GOOD = ("surprise", "so odd", "the rate", "post", "other", "none", 0.5, False)


def items(spark):
    return spark.createDataFrame([("c1", "this is so odd", None, "The rate"), ("c2", "fine", None, None)], ITEMS)


def test_put_labels(spark):
    rows = [
        ("c1", "A", False, [GOOD], 1, "x"),
        ("c1", "A", False, [(*GOOD[:3], "comment", *GOOD[4:])], 2, "x"),  # a wrong source is corrected
        ("c1", "A", False, [(GOOD[0], "not there", *GOOD[2:])], 3, "x"),  # refused
        ("c1", "B", False, [], 1, "x"), ("c1", "B", None, None, 1, "x"),  # neither neutral nor pairs
        ("c2", "B", True, [GOOD], 1, "x"),  # neutral: what was sent beside it doesn't count
        ("c9", "A", True, [], 1, "x"), ("c2", "nobody", True, [], 1, "x"), ("c2", None, True, [], 1, "x"), (None, "A", True, [], 1, "x"),
    ]
    judged = S.judge_labels(spark.createDataFrame(rows, REQ), items(spark), ["A", "B"])
    store = {(r["comment_id"], r["annotator"]): r for r in S.put_labels(judged.limit(0), judged).collect()}
    assert set(store) == {("c1", "A"), ("c2", "B")}
    assert store["c1", "A"]["updated_at"] == 2 and store["c1", "A"]["pairs"][0]["cause_source"] == "post" and store["c2", "B"]["pairs"] == []
    why = {r["comment_id"]: r["errors"] for r in judged.where("not accepted and annotator = 'A'").collect()}
    assert why["c9"] == ["comment: unknown"] and why["c1"] == ["pairs[0].emotion_span: not in the comment"]
    # a stored label gives way to a request of the same time
    again = S.put_labels(judged.where("accepted and updated_at = 2"), judged.where("updated_at = 2"))
    assert again.count() == 1
    empty = spark.createDataFrame([], REQ)
    assert S.judge_labels(empty, items(spark), ["A"]).count() == 0


def test_put_adjudications(spark):
    labels = spark.createDataFrame([("c1", "A", False, [GOOD]), ("c1", "C01", True, [])], f"comment_id string, annotator string, neutral boolean, pairs {PAIRS}")
    req = f"comment_id string, final string, pairs {PAIRS}, resolved_by string, updated_at int"
    rows = [("c1", " a ", None, "B", 1), ("c1", "B", None, "B", 9), ("c1", "TBD", None, "B", 9), ("c1", None, None, "B", 9), ("c1", "NEUTRAL", None, " ", 9), ("c2", "custom", [], "A", 1), ("c2", "CUSTOM", [GOOD], "A", 2), ("c9", "NEUTRAL", None, "A", 1)]
    judged = S.judge_adjudications(spark.createDataFrame(rows, req), labels, items(spark))
    store = {r["comment_id"]: (r["final"], r["neutral"], len(r["pairs"])) for r in S.put_adjudications(judged.limit(0), judged).collect()}
    assert store == {"c1": ("A", False, 1), "c2": ("CUSTOM", True, 0)}


def test_messages_are_appended(spark):
    log = spark.createDataFrame([(7, "c", "A", "old")], "id bigint, comment_id string, author string, body string")
    new = spark.createDataFrame([(2, "c", "B", " two "), (1, "d", "A", "one"), (3, "c", "B", "  "), (4, "c", None, "x"), (5, "c", "A", None)], "at int, comment_id string, author string, body string")
    got = [tuple(r) for r in S.append_messages(log, new, ["at"], Scratch(spark, "t")).orderBy("id").collect()]
    assert got == [(7, "c", "A", "old"), (8, "d", "A", "one"), (9, "c", "B", "two")]
    assert S.append_messages(log.limit(0), new.limit(0), ["at"], Scratch(spark, "t")).count() == 0


def test_stale_turns_and_questions(spark):
    ask = lambda *qs: "\n".join([*(f"QUESTION FOR A & B: {q}" for q in qs), "VERDICT: A"])
    t = spark.createDataFrame([("x", 1, ask("b?", "a?")), ("x", 0, ask("a?")), ("x", 2, ask("late?")), ("y", 0, "VERDICT: A"), ("z", 0, "")], "comment_id string, turn int, content string")
    n = spark.createDataFrame([("x", 2), ("y", 1)], "comment_id string, n_turns int")
    kept = D.without_stale(t, n)
    assert sorted((r["comment_id"], r["turn"]) for r in kept.collect()) == [("x", 0), ("x", 1), ("y", 0)]
    assert [tuple(r) for r in D.questions(kept).collect()] == [("x", ["a?", "b?"])]


def test_read_turn():
    t = D.read_turn("VERDICT: A\n- emotion: surprise\n  intensity: 0.5\nQUESTION FOR A AND B: why?\nVERDICT: custom, I think")
    assert t.verdict == "CUSTOM" and t.questions == ("why?",) and dict(t.proposal[0])["emotion"] == "surprise"
    same = D.read_turn("- emotion:   surprise\n  intensity: 0.50\n\nVERDICT: CUSTOM")
    assert same.proposal == t.proposal
    assert D.read_turn(None) == D.read_turn("no verdict") == D.Turn("UNSURE", None, ())
    assert D.read_turn("- emotion: x\n  intensity: high").proposal == ("- emotion: x", "intensity: high")
    assert D.scripted("x", 0) == D.scripted("x", 0) and D.play("abc", ("p", "q"), "r", D.scripted)["n_turns"] <= D.MAX_TURNS + D.MAX_EXTRA


def test_mock_outputs_parse(spark):
    df = spark.createDataFrame([(f"k{i}", "A title", "some words of a comment here") for i in range(60)] + [("e", None, ""), ("n", None, None)], "id string, title string, body string")
    got = df.select("id", K.mock_output("id", "title", "body").alias("raw")).select("id", K.parse_output("raw").alias("pairs")).collect()
    spans = [r["pairs"][0]["emotion_span"] for r in got if r["pairs"]]
    assert K.BAD_SPAN in spans and "some words of a comment here" in spans and any(not r["pairs"] for r in got)
    assert spark.createDataFrame([("not json",), (None,)], "raw string").select(K.parse_output("raw").alias("p")).collect() == [([],), ([],)]
