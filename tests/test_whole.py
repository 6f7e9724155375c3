"""Queries over all rows of their job, on small tables of their own and against plain implementations."""

import json
import random
from collections import Counter

import pytest

from spanloom.plans.catalog import catalog
from spanloom.schema import PAIR_FIELDS

CAT = catalog()
PAIR = "struct<support:int,sarcasm:boolean,emotion:string,emotion_span:string,cause_span:string,cause_source:string,cause_category:string,target_asset:string,intensity:double>"
LABELS = f"comment_id string, annotator string, neutral boolean, pairs array<{PAIR}>, updated_at timestamp_ntz"


def pair(span="s", emotion="e", cause="c", category="k", intensity=0.5, sarcasm=False, asset="none"):
    return (2, sarcasm, emotion, span, cause, "comment" if cause else None, category, asset, intensity)


@pytest.fixture
def labelled(spark, tmp_path):
    """Write rows of (comment, annotator, pairs) as a label table; returns its folder."""
    from datetime import datetime

    def put(rows):
        spark.createDataFrame([(c, a, not ps, ps, datetime(2024, 1, 1)) for c, a, ps in rows], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return put


def run(spark, name, d):
    return CAT.queries[name](spark, d).collect()


def test_every_pair_is_projected_to_the_scheme(spark, labelled):
    d = labelled([("x", "A", [pair(), pair("t", cause=None)]), ("x", "C07", [pair("u")]), ("y", "B", [])])
    got = {(r["comment_id"], r["annotator"]): json.loads(r["js"]) for r in run(spark, "flt07_clean_pairs", d)}
    assert {k: len(v) for k, v in got.items()} == {("x", "A"): 2, ("x", "C07"): 1, ("y", "B"): 0}
    assert all(tuple(p) == PAIR_FIELDS for ps in got.values() for p in ps)
    assert got["x", "A"][1]["cause_span"] is None and got["x", "A"][1]["emotion_span"] == "t"


def test_context_is_capped_at_its_own_lengths(spark, tmp_path):
    from helpers import comments, posts

    posts(spark, [("p1", "x" * 40_005, 1), ("p2", "y" * 41, 1), ("p3", "", 1)]).write.parquet(f"{tmp_path}/posts.parquet")
    rows = [("a", "t3_p1", "t3_p1", "u", 1, "z" * 10_007, 1), ("b", "t3_p1", "t1_a"), ("c", "t3_p2", "t1_b"), ("d", "t3_p3", "t1_gone")]
    comments(spark, rows).write.parquet(f"{tmp_path}/comments.parquet")
    got = {r["id"]: (r["n_selftext"], r["n_parent"]) for r in run(spark, "flt05_context_caps", str(tmp_path))}
    assert got == {"a": (40_000, None), "b": (40_000, 10_000), "c": (41, 4), "d": (None, None)}


def iou(a, b):
    a, b = set((a or "").split()), set((b or "").split())
    return len(a & b) / len(a | b) if a and b else 0.0


def plain_clusters(votes):
    """Clusters of one comment as lists of pairs; votes are (annotator, pairs)."""
    votes = sorted(votes)
    part = {(a, i): {(a, i)} for a, ps in votes for i in range(len(ps))}
    span = {(a, i): p[3] for a, ps in votes for i, p in enumerate(ps)}
    for n, (a, pa) in enumerate(votes):
        for b, pb in votes[n + 1 :]:
            left, right = set(range(len(pa))), set(range(len(pb)))
            for s, i, j in sorted(((iou(span[a, i], span[b, j]), i, j) for i in left for j in right), reverse=True):
                if s >= 0.5 and i in left and j in right:
                    left.remove(i)
                    right.remove(j)
                    both = part[a, i] | part[b, j]
                    for k in both:
                        part[k] = both
    of = {(a, i): p for a, ps in votes for i, p in enumerate(ps)}
    for comp in {id(c): c for c in part.values()}.values():
        kept = []
        for who in sorted({a for a, _ in comp}):
            own = sorted(k for k in comp if k[0] == who)
            kept.append(max(own, key=lambda k: round(sum(iou(span[k], span[o]) for o in sorted(comp) if o[0] != who), 9)))
        yield [of[k] for k in kept]
        yield from ([of[k]] for k in comp if k not in kept)


def plain_medoid(spans):
    real = [x for x in spans if x]
    at = max(range(len(real)), key=lambda i: round(sum(iou(real[i], o) for j, o in enumerate(real) if j != i), 9), default=None)
    return None if at is None else real[at]


def plain_record(ps):
    n, out = len(ps), {"support": len(ps)}
    nulls = sum(p[4] is None for p in ps)
    out["unclear"] = nulls * 2 > n
    out["intensity"] = round(sum(p[8] for p in ps) / n, 6)
    out["spans"] = (plain_medoid([p[3] for p in ps]), plain_medoid([p[4] for p in ps]))
    out["splits"] = set()
    for f, at in (("emotion", 2), ("cause_category", 6)):
        (top, c), *_ = Counter(p[at] for p in ps).most_common(1)
        out[f], out[f"{f}_tie"] = top, c * 2 <= n
        won = nulls if f == "cause_category" and out["unclear"] else c
        if n / 2 < won < n:
            out["splits"].add((f, ",".join(sorted({p[at] for p in ps if p[at]}))))
    return out


def crowd(seed, n_items=60, people=("A", "B", "C01", "C02", "C03")):
    rng = random.Random(seed)
    one = lambda: pair(rng.choice(["a b c d", "a b c", "b c d", "e f", "e f g", "h", "h i"]), rng.choice("uvw"), rng.choice([None, "p q", "q r", "p"]), rng.choice("kl"), rng.choice([0.25, 0.5, 1.0]), asset=rng.choice(["gold", "none"]))
    return [(f"c{i:02}", a, [one() for _ in range(rng.randint(0, 3))]) for i in range(n_items) for a in people if rng.random() < 0.8]


def test_votes_are_taken_per_matched_cluster(spark, labelled):
    rows = crowd(3)
    rows += [("two", "A", [pair("x y", "u"), pair("z", "v")]), ("two", "B", [pair("z", "v"), pair("x y", "u")])]
    d = labelled(rows)
    key = lambda r: (r["comment_id"], r["cluster"])
    got = {key(r): r.asDict() for r in run(spark, "agg10_cluster_vote", d)}
    for name in ("agg11_cluster_null_cause", "agg12_cluster_medoid", "agg13_cluster_intensity"):
        found = {key(r): r.asDict() for r in run(spark, name, d)}
        assert set(found) == set(got)
        for k, r in found.items():
            got[k] |= r
    for r in got.values():
        r["splits"] = set()
    for r in run(spark, "misc10_cluster_judge_splits", d):
        got[key(r)]["splits"].add((r["field"], r["cands"]))
    have, want = {}, {}
    for (c, _), r in got.items():
        assert r["unclear"] == (r["null_causes"] * 2 > r["support"])
        have.setdefault(c, []).append(str((r["support"], r["unclear"], round(r["intensity"], 5), r["emotion_span"], r["cause_span"], r["emotion"], r["emotion_tie"], r["cause_category"], r["cause_category_tie"], sorted(r["splits"]))))
    for c in {r[0] for r in rows}:
        for ps in plain_clusters([(a, ps) for x, a, ps in rows if x == c]):
            r = plain_record(ps)
            want.setdefault(c, []).append(str((r["support"], r["unclear"], round(r["intensity"], 5), *r["spans"], r["emotion"], r["emotion_tie"], r["cause_category"], r["cause_category_tie"], sorted(r["splits"]))))
    assert {c: sorted(v) for c, v in have.items()} == {c: sorted(v) for c, v in want.items()}
    assert sum(r["support"] for r in got.values()) == sum(len(ps) for *_, ps in rows)
    assert sorted(r["support"] for (c, _), r in got.items() if c == "two") == [2, 2] and any(r["splits"] for r in got.values())
    cons = {key(r): r for r in run(spark, "misc11_consensus", d)}
    assert set(cons) == set(got)
    for k, r in cons.items():
        assert (r["emotion_span"], r["cause_span"]) == (got[k]["emotion_span"], None if got[k]["unclear"] else got[k]["cause_span"])


def test_ties_are_exported_besides_singletons(spark, labelled):
    one = lambda *a, **k: [pair(*a, **k)]
    rows = [("agreed", "A", one("x y")), ("agreed", "B", one("x y")), ("emotion", "A", one("x y", "u")), ("emotion", "B", one("x y", "v")), ("cause", "A", one("x y", category="k")), ("cause", "B", one("x y", category="l"))]
    rows += [("unclear", "A", one("x y", cause=None, category="k")), ("unclear", "B", one("x y", cause=None, category="l")), ("alone", "A", one("x y")), ("alone", "B", []), ("third", "A", one("x y")), ("third", "B", one("x y")), ("third", "C01", one("z"))]
    d = labelled(rows)
    ids = lambda n: sorted(r["comment_id"] for r in run(spark, n, d))
    assert ids("set04_export_disputed_two_models") == ["alone", "cause", "emotion"]
    assert ids("set04_export_disputed") == ["alone", "cause", "emotion", "third"]


def test_all_annotators_are_compared(spark, labelled):
    rows = crowd(5) + [("s", a, [pair("x y", sarcasm=a < "C")]) for a in ("A", "B", "C01", "C02", "C03")]
    d = labelled(rows)
    by = {}
    for c, a, ps in rows:
        by.setdefault(c, []).append((a, ps))
    support = Counter(len(ps) for votes in by.values() for ps in plain_clusters(votes))
    assert {r["support"]: r["n"] for r in run(spark, "agg15_support_histogram", d)} == support and max(support) > 2
    assert {(r["model"], r["comment_id"]): r["n"] for r in run(spark, "src08_label_scan", d)} == {(a, c): len(ps) for c, a, ps in rows}
    n = {c: (sum(any(p[1] for p in ps) for _, ps in v), len(v)) for c, v in by.items() if len(v) > 1}
    share = sum(y for y, _ in n.values()) / sum(m for _, m in n.values())
    seen = sum((y * y + (m - y) ** 2 - m) / (m * (m - 1)) for y, m in n.values()) / len(n)
    chance = share**2 + (1 - share) ** 2
    (r,) = run(spark, "agg17_fleiss_sarcasm", d)
    assert r["items"] == len(n) and r["kappa"] == pytest.approx((seen - chance) / (1 - chance), abs=1e-6)
    want = {}
    for votes in by.values():
        votes = sorted(votes)
        for i, (a, pa) in enumerate(votes):
            for b, pb in votes[i + 1 :]:
                if pa or pb:
                    # two annotators' clusters of two are their matches
                    m = [c for c in plain_clusters([(a, pa), (b, pb)]) if len(c) == 2]
                    w = want.setdefault((a, b), [[], [], []])
                    w[0].append(2 * len(m) / (len(pa) + len(pb)))
                    w[1] += [x[2] == y[2] for x, y in m]
                    w[2] += [x[6] == y[6] for x, y in m]
    got = {(r["ma"], r["mb"]): (r["n"], r["n_matched"], r["match_rate"], r["emotion_agreement"], r["cause_agreement"]) for r in run(spark, "agg28_cross_model", d)}
    assert set(got) == set(want) and len(want) == 10
    for k, (rate, emo, cause) in want.items():
        mean = lambda xs: sum(xs) / len(xs)
        assert got[k] == pytest.approx((len(rate), len(emo), mean(rate), mean(emo), mean(cause)), abs=2e-6)


def test_a_planted_leak_is_counted(spark):
    from spanloom.operators.relational import leaked

    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "comment_id string")
    assert leaked(ids("a", "b", "b", "c"), ids("b", "d")).first()["n_leaked"] == 1
    assert leaked(ids("a"), ids("d")).first()["n_leaked"] == 0


def test_leak_check_reads_the_kept_and_the_excluded_ids(spark, monkeypatch, tmp_path, labelled):
    from helpers import comments

    from spanloom.plans import q_sampling as S

    d = labelled([("a", "A", []), ("b", "A", []), ("b", "C01", [])])
    comments(spark, [("a", "t3_p", "t3_p"), ("b", "t3_p", "t3_p")]).write.parquet(f"{tmp_path}/comments.parquet")
    assert [r["n_leaked"] for r in run(spark, "set05_leak_check", d)] == [0]
    monkeypatch.setattr(S, "_kept", lambda s, d: s.createDataFrame([("a",), ("b",)], "comment_id string"))
    assert [r["n_leaked"] for r in run(spark, "set05_leak_check", d)] == [1]
