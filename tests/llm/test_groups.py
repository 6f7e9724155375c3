"""Splits, caps, mixing and consensus against brute force and invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import capping as P
from spanloom.llm import consensus as C
from spanloom.llm import mixing as X
from spanloom.llm import splits as G
from spanloom.llm.capping import cap_contributors
from spanloom.llm.consensus import agreement, estimate, resolved, vote_of
from spanloom.llm.splits import components, group_splits
from spanloom.plans.scratch import Scratch
from spanloom.schema import PAIRS


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"a{rng.randrange(150):03}", f"b{rng.randrange(260)}") for _ in range(220)]
    edges += [(f"c{i:02}", f"d{i}") for i in range(40)] + [(f"c{i + 1:02}", f"d{i}") for i in range(39)]  # a long chain
    edges += [("a000", f"hub{i}") for i in range(200)] + [(f"h{i:03}", "hub") for i in range(200)]  # hot on either side
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(b)] = top(a)
    low = {}
    for a, _ in edges:
        low[top(a)] = min(low.get(top(a), a), a)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t")).collect()}
    assert got == {x: low[top(x)] for e in edges for x in e}
    assert components(spark.createDataFrame([], "a string, b string"), Scratch(spark, "t")).count() == 0


def test_splits_keep_groups_and_proportions(spark):
    rng = random.Random(6)
    rows = [(f"r{i}", f"l{rng.randrange(600)}" if rng.random() < 0.9 else None, f"p{i}" if rng.random() < 0.8 else None, rng.choice(["x", "y", None])) for i in range(3000)]
    rows += [(f"big{i}", "huge", None, "x") for i in range(300)] + [("alone", None, None, None)]
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = {r["id"]: r for r in group_splits(spark.createDataFrame(rows, "id string, e1 string, e2 string, label string"), shares).collect()}
    assert len(got) == len(rows)
    for pos in (1, 2):
        seen = {}
        for r in rows:
            if r[pos]:
                assert seen.setdefault(r[pos], got[r[0]]["split"]) == got[r[0]]["split"]
    for lab in ("x", "y"):
        n = [g["split"] for g in got.values() if g["label"] == lab]
        for s, p in shares.items():
            assert abs(n.count(s) / len(n) - p) < 0.03
    assert got["big0"]["comp"] == "huge"
    assert group_splits(spark.createDataFrame([], "id string, e1 string, e2 string, label string"), shares).count() == 0


def test_splits_balance_every_label_beyond_the_first_block(spark, monkeypatch):
    # 700 labels, and more groups than one task places
    monkeypatch.setattr(G, "GROUPS_PER_TASK", 500)
    rng = random.Random(9)
    rows = [(f"r{i}", f"g{rng.randrange(3000)}", None, f"l{i % 700}" if i % 701 else None) for i in range(14_000)]
    got = group_splits(spark.createDataFrame(rows, "id string, e1 string, e2 string, label string"), {"train": 0.8, "test": 0.2}).collect()
    assert len(got) == 14_000 and len({(r["comp"], r["split"]) for r in got}) == len({r["comp"] for r in got})
    share = {}
    for r in got:
        share.setdefault(r["label"], []).append(r["split"] == "train")
    dev = [sum(v) - 0.8 * len(v) for v in share.values()]
    # drawing groups at random would deviate by about 1.8 per label of 20
    assert len(share) == 701 and np.sqrt(np.mean(np.square(dev))) < 1.2 and abs(sum(dev)) < 140


def greedy(recs, lists, cap):
    used, kept = {}, set()
    for i, q in sorted(recs, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])):
        cs = set(lists.get(i, ())) - {None}
        if all(used.get(c, 0) < cap(c) for c in cs):
            kept.add(i)
            for c in cs:
                used[c] = used.get(c, 0) + 1
    return kept


@pytest.mark.parametrize("most,window", [(1, 4096), (3, 4096), (3, 0), (2, 10)])
def test_caps_equal_the_greedy_choice(spark, monkeypatch, most, window):
    rng = random.Random(most)
    recs = [(f"i{i:04}", rng.choice([None, 1, 2, 3, 4])) for i in range(500)]
    lists = {i: [rng.choice(["hot", "warm", *[f"c{k}" for k in range(40)], None]) for _ in range(rng.randint(0, most))] for i, _ in recs}
    cap = lambda c: 0 if c == "c0" else 25 if c == "hot" else 5
    r = spark.createDataFrame([(i, q, "x") for i, q in recs], "id string, quality int, kept string")
    pairs = [(i, c) for i, cs in lists.items() for c in cs]
    c = spark.createDataFrame(pairs + pairs[:5], "id string, contributor string")
    monkeypatch.setattr(P, "WINDOW_ROOM", window)
    limit = F.when(F.col("contributor") == "c0", 0).when(F.col("contributor") == "hot", 25).otherwise(5)
    got = {x["id"] for x in cap_contributors(r, c, limit).where("kept").collect()}
    assert got == greedy(recs, lists, cap)


def test_caps_edge_cases(spark):
    r = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "id string, quality int")
    c = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "u")], "id string, contributor string")
    keep = lambda **kw: sorted(x["id"] for x in cap_contributors(r, c, 2, **kw).where("kept").collect())
    assert keep() == ["a", "b"] and keep(max_share=0.34) == ["a"]
    assert cap_contributors(r.limit(0), c.limit(0), 2).count() == 0
    assert cap_contributors(r, c.limit(0), 2).where("kept").count() == 3


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture
def narrow_tree(monkeypatch):
    monkeypatch.setattr(X, "FAN_IN", 4)
    monkeypatch.setattr(X, "GROUP_ROWS", 40)


def _round(rows, spark, seed=1):
    return X.round_fractions(rows, Scratch(spark, "t"), seed)


def test_pivotal_rounding_keeps_sums_and_expectations(spark, narrow_tree):
    n = 6000
    rows = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.when(F.col("id") % 3 == 0, 0.3).otherwise(0.75).alias("p"), (F.col("id") % 50).alias("n_tokens")).repartition(7)
    p = F.when(F.col("source") == "a", 0.3).otherwise(0.75)
    got = _round(rows, spark).groupBy("source").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"), F.sum(F.col("up") * F.col("n_tokens")).alias("t"), F.sum(p * F.col("n_tokens")).alias("w")).collect()
    for r in got:
        assert abs(r["up"] - (0.3 if r["source"] == "a" else 0.75) * r["n"]) < 1 and abs(r["t"] / r["w"] - 1) < 0.01
    assert sum(r["n"] for r in got) == n
    means = [_round(rows.where("k < 40"), spark, s).where("k = 7").first()["up"] for s in range(12)]
    assert 4 <= sum(means) <= 12  # document 7 has p = 0.75


@pytest.mark.parametrize("sources", [12, 300])
def test_the_tree_ends_for_more_sources_than_its_fan_in(spark, narrow_tree, sources):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("s"), (F.col("id") % sources).cast("string")).alias("source"), F.lit(0.37).alias("p"), (F.col("id") * 7 % 1000).alias("n_tokens"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = _round(rows, spark).groupBy("source").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"), F.max("level").alias("level")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == sources and all(abs(r["up"] - 0.37 * r["n"]) < 1 for r in got)
    assert max(r["level"] for r in got) <= 4


def test_one_source_over_many_tasks(spark, narrow_tree):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.lit("only").alias("source"), (F.lit(0.2) + (F.col("id") % 3) * 0.3).alias("p"), F.lit(5).alias("n_tokens"), F.lit("x").alias("extra"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = _round(rows, spark)
        want = rows.agg(F.sum("p")).first()[0]
        assert abs(got.agg(F.sum("up")).first()[0] - want) < 1 and got.count() == 4000 and 3 <= got.agg(F.max("level")).first()[0] <= 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_groups_over_many_batches(spark, small_batches):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("source"), F.lit(0.31).alias("p"), (F.col("id") % 3 + 100).alias("n_tokens"), F.lit(1).alias("whole"))
    got = _round(rows, spark)
    per = {r["source"]: r for r in got.groupBy("source").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("k"), F.max("rounds").alias("rounds")).collect()}
    assert per["a"]["n"] == per["a"]["k"] == 1000 and per["b"]["n"] == per["b"]["k"] == 4000
    assert all(abs(r["up"] - 0.31 * r["n"]) < 1 for r in per.values()) and per["b"]["rounds"] > per["a"]["rounds"] > 6


def test_pairing_keeps_mass_and_is_unbiased():
    rng = np.random.default_rng(5)
    group = np.sort(rng.integers(0, 6, 500))
    p = rng.uniform(0.01, 0.99, 500)
    total = np.zeros(500)
    for seed in range(300):
        q, _ = X.pair_off(group, p, rng.integers(-(2**62), 2**62, 500), seed)
        for g in range(6):
            assert abs(q[group == g].sum() - p[group == g].sum()) < 1e-6 and ((q[group == g] > 0) & (q[group == g] < 1)).sum() <= 1
        total += q
    assert np.abs(total / 300 - p).max() < 0.13


def test_mixture(spark):
    docs = [(i, "word " * (i % 7 + 1), s, "e") for i, s in enumerate(["a"] * 50 + ["b"] * 10 + ["c"] * 30 + ["d"] * 60 + [None] * 3 + ["other"] * 5)] + [(900, None, "a", "e"), (901, "", "a", "e")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, copies string")
    t = spark.createDataFrame([("a", 0.3, 3), ("b", 0.4, 2), ("c", 0.05, 1), ("d", 0.2, 9), ("none", 0.05, 3), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    copies, plan, shares = X.mix(d, t)
    c = copies.collect()
    assert len(c) == 152 and {r["copies"] for r in c if r["source"] == "b"} == {2} and max(r["copies"] for r in c if r["source"] == "c") <= 1
    assert {r["source"] for r in plan.where("is_short").collect()} == {"b", "none"}
    s = {r["source"]: r for r in shares.collect()}
    total = sum(r["have"] for r in s.values())
    # what b and none lack is asked of the others by weight; the mix keeps its size
    assert abs(sum(r["goal"] for r in s.values()) - total) < 0.1 and s["none"]["got"] == 0 and s["b"]["got"] == 2 * s["b"]["have"]
    assert abs(s["a"]["goal"] / s["d"]["goal"] - 1.5) < 0.01 and abs(s["c"]["goal"] / s["d"]["goal"] - 0.25) < 0.01
    assert all(abs(r["got"] - r["goal"]) <= r["error_bound"] for r in s.values())
    assert abs(sum(r["actual_share"] for r in s.values()) - 1) < 1e-9 and all(abs(s[x]["actual_share"] - s[x]["goal_share"]) < 0.03 for x in s)
    # the same seed makes the same mix, however the rows lie; another seed another one
    again = {r["doc_id"]: r["copies"] for r in X.mix(d.repartition(5), t)[0].collect()}
    other = {r["doc_id"]: r["copies"] for r in X.mix(d, t, seed=1)[0].collect()}
    assert again == {r["doc_id"]: r["copies"] for r in c} != other
    copies, plan, shares = X.mix(d.limit(0), t)
    assert copies.count() == 0 and shares.count() == 5


def test_goals_raise_the_level_until_nobody_new_is_short(spark):
    rows = [("a", 0.5, 10.0), ("b", 0.3, 30.0), ("c", 0.1, 900.0), ("d", 0.1, 900.0)]
    df = spark.createDataFrame([(s, w, c, 100) for s, w, c in rows], "source string, weight double, cap double, total int")
    g = {r["source"]: round(r["goal"], 6) for r in X.goals(df, None).collect()}
    assert g == {"a": 10.0, "b": 30.0, "c": 30.0, "d": 30.0}
    assert all(r["goal"] <= r["cap"] for r in X.goals(df.withColumn("cap", F.lit(7.0)), None).collect())


@pytest.mark.parametrize("text", ["some words and 12 numbers " * 40_000, "x" * 450_000, "a b" + " " * 300_000 + "c\n\n d's" + "\n" * 250_000 + "e" + "\n\n  word" * 60_000, "né à 'll " * 70_000])
def test_long_texts_are_tokenized_whole(spark, text):
    n = X.with_tokens(spark.createDataFrame([(1, text)], "k int, t string"), "t").first()["n_tokens"]
    assert n == len(X._tokenizer(X.TOKENIZER).encode_ordinary(text)) and "".join(X._pieces(text)) == text


def test_votes(spark):
    mk = lambda e, v: (e, "s", None, None, "other", "none", v, False)
    rows = [([mk(" Surprise", 0.2), mk("fear_anxiety", 0.9)],), ([mk("a", 0.5), mk("b", 0.5)],), ([mk("a", None), mk("b", 0.0)],), ([],), (None,), ([mk(None, 0.5)],)]
    got = [r[0] for r in spark.createDataFrame(rows, f"pairs {PAIRS}").select(vote_of()).collect()]
    assert got == ["fear_anxiety", "a", "b", "neutral", "neutral", None]


def _crowd(seed, n_items=600):
    rng = np.random.default_rng(seed)
    labels = list("abcdefg")
    skill = {f"good{i}": 0.85 for i in range(4)} | {f"fair{i}": 0.6 for i in range(4)} | {f"bad{i}": 0.1 for i in range(2)}
    truth, votes = {}, []
    for i in range(n_items):
        t = truth[f"i{i}"] = labels[rng.integers(7)]
        wrong = lambda: labels[(labels.index(t) + rng.integers(1, 7)) % 7]
        for who in rng.choice(list(skill), 5, replace=False):
            votes.append((f"i{i}", str(who), t if rng.random() < skill[who] else wrong()))
        if i % 2:  # three who copy one mediocre source
            v = t if rng.random() < 0.4 else wrong()
            votes += [(f"i{i}", f"copy{k}", v) for k in range(3)]
    return truth, votes


def test_consensus_beats_majority_and_finds_copiers(spark):
    truth, votes = _crowd(1)
    df = spark.createDataFrame(votes, "item string, annotator string, label string")
    items, people = estimate(df)
    got = {r["item"]: r["consensus"] for r in items.collect()}
    count = {}
    for i, _, v in votes:
        count.setdefault(i, []).append(v)
    majority = np.mean([max(sorted(set(v)), key=v.count) == truth[i] for i, v in count.items()])
    ours = np.mean([got[i] == t for i, t in truth.items()])
    assert ours > majority + 0.05 and ours > 0.85
    p = {r["annotator"]: r for r in people.collect()}
    assert p["good0"]["ability"] > p["fair0"]["ability"] > p["bad0"]["ability"] and p["good0"]["reliability"] > 0.7
    assert {p[f"copy{k}"]["circle"] for k in range(3)} == {"copy0"} and p["good0"]["circle"] == "good0"
    assert all(0.2 < sum(x["p"] for x in r["posterior"]) <= 1 + 1e-6 for r in items.limit(20).collect())


def test_copiers_among_many_annotators_are_found(spark):
    truth, votes = _crowd(2, 200)
    # more annotators of greater activity than were ever compared, on items of their own
    rng = random.Random(2)
    busy = [(f"z{(w * 61 + t * 37) % 4000}", f"busy{w:04}", rng.choice("abcdefg")) for w in range(2100) for t in range(130)]
    people = {r["annotator"]: r["circle"] for r in estimate(spark.createDataFrame(votes + busy, "item string, annotator string, label string"))[1].collect()}
    assert len(people) > 2100 and {people[f"copy{k}"] for k in range(3)} == {"copy0"} and people["good0"] == "good0"


@pytest.mark.parametrize("held", [0, 50, 10**6])
def test_sums_of_annotator_pairs(monkeypatch, held):
    rng = np.random.default_rng(held)
    monkeypatch.setattr(C, "JOINT_VOTES", 20)
    size = rng.integers(0, 9, 60)
    item = np.repeat(np.arange(60), size)
    who = np.concatenate([np.sort(rng.choice(12, n, replace=False)) for n in size]).astype(int)
    want, sums, got = {}, C._PairSums(12), {}
    for a in range(len(item)):
        for b in range(a + 1, len(item)):
            if item[a] == item[b]:
                want[who[a], who[b]] = want.get((who[a], who[b]), 0) + 1
    out = []
    for a, b in C._later(item):
        one = np.ones(len(a))
        sums.add(who[a], who[b], one, one, one, one)
        out += sums.take(held)
    for batch in [*out, *sums.take(0)]:
        for r in batch.to_pylist():
            got[r["x"], r["y"]] = got.get((r["x"], r["y"]), 0) + r["both"]
    assert got == want


def test_more_labels_than_a_fixed_table_would_hold(spark):
    rng = random.Random(8)
    votes = [(f"i{i}", f"p{j}", f"l{i}" if rng.random() < 0.8 else f"l{rng.randrange(1500)}") for i in range(1500) for j in range(3)]
    got = {r["item"]: r["consensus"] for r in estimate(spark.createDataFrame(votes, "item string, annotator string, label string"))[0].collect()}
    assert len(got) == 1500 and np.mean([got[f"i{i}"] == f"l{i}" for i in range(1500)]) > 0.86


def test_passes_end_by_convergence(spark, monkeypatch):
    calls = []
    step = C._Model.step
    monkeypatch.setattr(C._Model, "step", lambda self: calls.append(step(self)) or calls[-1])
    _, votes = _crowd(3, 300)
    estimate(spark.createDataFrame(votes, "item string, annotator string, label string"))
    assert len(calls) < C.MOST_PASSES and calls[-1] < C.TOLERANCE


def test_known_labels_decide(spark):
    df = spark.createDataFrame([("i", "a", "x"), ("i", "b", "x"), ("j", "a", "y")], "item string, annotator string, label string")
    known = spark.createDataFrame([("i", "z")], "item string, known string")
    got = {r["item"]: r["consensus"] for r in estimate(df, known)[0].collect()}
    assert got["i"] == "z" and set(got) == {"i", "j"}
    empty = df.limit(0)
    items, people = estimate(empty)
    assert items.count() == 0 and people.count() == 0 and agreement(empty).first()["alpha"] is None


def test_resolved_adjudications(spark):
    votes = spark.createDataFrame([("i", "A", "x"), ("i", "B", "y")], "item string, annotator string, label string")
    mk = lambda e: [(e, "s", None, None, "other", "none", 0.5, False)]
    rows = [("i", "b ", None, 2), ("i", "TBD", None, 3), ("i", None, None, 4), ("i", "A", None, 1), ("j", "custom", mk("w"), 1), ("k", "NEUTRAL", None, 1), ("l", "A", mk("q"), 1), ("m", "TBD", None, 1), (None, "A", None, 1)]
    df = spark.createDataFrame(rows, f"comment_id string, final string, pairs {PAIRS}, t int").withColumn("updated_at", F.timestamp_seconds("t"))
    assert {r["item"]: r["known"] for r in resolved(df, votes).collect()} == {"i": "y", "j": "w", "k": "neutral", "l": "q"}


def test_agreement_of_identical_votes(spark):
    df = spark.createDataFrame([("i", "a", "x"), ("i", "b", "x"), ("j", "a", "y"), ("j", "b", "y"), ("k", "a", "y")], "item string, annotator string, label string")
    r = agreement(df).first()
    assert r["alpha"] == 1.0 and r["n_items"] == 2
