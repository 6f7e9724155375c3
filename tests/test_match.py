"""Matching, clusters, votes and agreement against plain implementations."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import match as M
from spanloom.operators import voting as V

SPANS = "id int, pa array<struct<emotion_span:string,emotion:string,cause_category:string>>, pb array<struct<emotion_span:string,emotion:string,cause_category:string>>"


def plain(a, b, thr, lowest=False):
    toks = lambda s: set((s or "").lower().split())
    c = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s = len(toks(x) & toks(y)) / len(toks(x) | toks(y)) if toks(x) and toks(y) else 0.0
            c.append((s, -i, -j) if lowest else (s, i, j))
    out, ua, ub = [], set(), set()
    for s, i, j in sorted(c, reverse=True):
        if s >= thr and abs(i) not in ua and abs(j) not in ub:
            out.append((abs(i), abs(j)))
            ua.add(abs(i))
            ub.add(abs(j))
    return sorted(out)


@pytest.mark.parametrize("lowest", [False, True])
def test_greedy_match(spark, lowest):
    rng = random.Random(1)
    word = lambda: " ".join(rng.choices("abcd", k=rng.randint(1, 3)))
    data = [(i, [word() for _ in range(rng.randint(0, 4))], [word() for _ in range(rng.randint(0, 4))]) for i in range(150)]
    data.append((150, ["a b", "a b"], ["a b", "a b"]))  # ties
    data.append((151, [None, ""], ["a"]))
    mk = lambda xs: [(x, "e", "c") for x in xs]
    df = spark.createDataFrame([(i, mk(a), mk(b)) for i, a, b in data], SPANS)
    got = {r["id"]: sorted((m["i"], m["j"]) for m in r["m"]) for r in M.with_matches(df, lowest_first=lowest).collect()}
    assert got == {i: plain(a, b, 0.5, lowest) for i, a, b in data}
    assert got[150] == [(0, 0), (1, 1)]


def test_null_sides_match_nothing(spark):
    df = spark.createDataFrame([(1, None, [("a", "e", "c")]), (2, [], [])], SPANS)
    t = {r["id"]: (r["n_a"], r["n_b"], r["n_span"]) for r in M.tallies(M.with_matches(df)).collect()}
    assert t == {1: (0, 1, 0), 2: (0, 0, 0)}
    assert M.micro_f1(M.tallies(M.with_matches(df.where("id = 2")))).first()["pair_f1"] == 0.0


def test_scoring_a_model_against_itself(spark):
    df = spark.createDataFrame([(1, [("a b", "e", "c"), ("d", "e", "c")])], "id int, pa array<struct<emotion_span:string,emotion:string,cause_category:string>>").withColumn("pb", F.col("pa"))
    assert tuple(M.micro_f1(M.tallies(M.with_matches(df))).first()) == (1, 100.0, 100.0, 100.0)


def test_kappa_cases(spark):
    k = lambda rows: [tuple(r) for r in M.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()]
    assert k([]) == []
    assert k([("x", "x")] * 3) == [(3, 1.0, 1.0, 1.0)]
    assert k([("x", "x"), ("y", "y")])[0][3] == 1.0
    assert k([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")])[0][3] == 0.0


def test_fleiss_drops_single_ratings(spark):
    df = spark.createDataFrame([(3, 0), (0, 3), (1, 0)], "yes int, no int")
    assert M.fleiss(df, ["yes", "no"]).first()["kappa"] == 1.0


def test_clusters(spark):
    pair = "struct<emotion:string,emotion_span:string,extra:int>"

    def groups(votes):
        df = spark.createDataFrame([("c", m, [("e", t, i) for i, t in enumerate(spans)]) for m, spans in votes] + [("none", "m1", [])], f"comment_id string, annotator string, pairs array<{pair}>")
        out = {}
        for r in V.clusters(df).orderBy("cluster", "seat").collect():
            out.setdefault(r["cluster"], []).append((r["annotator"], r["pair"]["extra"]))
            assert r["seat"] == len(out[r["cluster"]]) - 1
        return sorted(out.values())

    assert groups([("m1", ["a b"]), ("m2", ["a b c"]), ("m3", ["b c d", "z"])]) == [[("m1", 0), ("m2", 0), ("m3", 0)], [("m3", 1)]]
    # two pairs of m1 in one component: the better connected stays, the other stands alone
    found = groups([("m1", ["a b c", "b c d e"]), ("m2", ["a b c"]), ("m3", ["b c d e"]), ("m4", ["a b c d e"])])
    assert sum(map(len, found)) == 5 and all(len({m for m, _ in g}) == len(g) for g in found)
    # of equally connected ones the first stays; a null span matches nothing
    assert groups([("m1", ["a b", None]), ("m2", [None])]) == [[("m1", 0)], [("m1", 1)], [("m2", 0)]]


def test_votes_prefer_first_seen_on_ties(spark):
    pair = "struct<emotion:string,emotion_span:string,cause_span:string,cause_source:string,cause_category:string,target_asset:string,intensity:double,sarcasm:boolean>"
    mk = lambda e, c, cs: (e, "s", cs, None, c, "none", 0.5, False)
    df = spark.createDataFrame([("x", 0, mk("b", "k", None)), ("x", 1, mk("a", "k", "q")), ("y", 0, mk("a", "k", None)), ("y", 1, mk("b", "l", None)), ("y", 2, mk("b", "l", "q"))], f"cid string, seat int, pair {pair}")
    got = {r["cid"]: r for r in V.vote_fields(df, ["cid"]).collect()}
    assert got["x"]["emotion"] == "b" and got["x"]["emotion_tie"] and got["x"]["null_causes"] == 1
    assert got["y"]["emotion"] == "b" and not got["y"]["emotion_tie"] and got["y"]["support"] == 3


def test_medoid(spark):
    df = spark.createDataFrame([(["a b", "a b c", "z", None],)], "s array<string>")
    assert df.select(V.medoid(F.col("s")).alias("m")).first()["m"] == "a b"
