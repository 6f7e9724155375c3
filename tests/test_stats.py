import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import stats as S
from spanloom.operators import panel as P
from spanloom.operators import resample as R


def test_tail_probabilities():
    # textbook values
    assert float(S.t_tail(np.array(2.228), np.array(10.0))) == pytest.approx(0.05, abs=2e-4)
    assert float(S.f_tail(np.array(4.26), np.array(2.0), np.array(9.0))) == pytest.approx(0.05, abs=2e-4)
    assert float(S.betainc(np.array(2.0), np.array(3.0), np.array(0.5))) == pytest.approx(0.6875)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0.01,), (0.03,), (0.04,), (None,)], "p double")
    got = {r["p"]: r["q"] for r in P.benjamini_hochberg(df, "p", "q").collect()}
    assert got[0.01] == pytest.approx(0.03) and got[0.03] == pytest.approx(0.04) and got[0.04] == pytest.approx(0.04) and got[None] is None
    ties = P.benjamini_hochberg(spark.createDataFrame([(0.02,), (0.02,), (0.5,)], "p double"), "p", "q")
    assert sorted(round(r["q"], 6) for r in ties.collect()) == [0.03, 0.03, 0.5]


def test_zero_variance_gives_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(S.corr("x", "y").alias("r")).first()["r"] is None


def test_missing_weeks_are_made(spark):
    d = lambda s: dt.date.fromisoformat(s)
    pairs = spark.createDataFrame([(d("2024-01-05"), "surprise", None, 0.5, 0.0), (d("2024-01-20"), "surprise", "other", 0.5, 0.0), (None, "surprise", "other", 0.5, 0.0)], "day date, emotion string, cause string, intensity double, valence double")
    got = {str(r["week"]): r["n_pairs"] for r in P.weekly_panel(pairs).collect()}
    assert got == {"2024-01-05": 1, "2024-01-12": 0, "2024-01-19": 0, "2024-01-26": 1}


def test_forward_returns_count_dense_weeks(spark):
    d = lambda s: dt.date.fromisoformat(s)
    px = spark.createDataFrame([(d("2024-01-05"), "t", 10.0), (d("2024-01-19"), "t", 20.0), (d("2024-01-18"), "t", None)], "day date, ticker string, close double")
    got = {(str(r["week"]), r["horizon"]): r["y"] for r in P.forward_returns(P.weekly_close(px), {"1w": 1, "2w": 2}).collect()}
    assert got == {("2024-01-05", "2w"): 1.0}  # the week between has no close


def test_two_way_demeaning_against_least_squares(spark):
    rng = np.random.default_rng(0)
    rows = [(str(a), str(b), float(x := rng.normal()), float(0.7 * x + a * 0.3 - b * 0.2 + rng.normal() * 0.1)) for a in range(4) for b in range(9) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "a string, b string, x double, y double")
    z = P.demean_two_way(df, ["x", "y"], "a", "b").agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("beta")).first()["beta"]
    dummies = np.array([[1.0 * (r[0] == str(a)) for a in range(4)] + [1.0 * (r[1] == str(b)) for b in range(1, 9)] + [r[2]] for r in rows])
    want = np.linalg.lstsq(dummies, np.array([r[3] for r in rows]), rcond=None)[0][-1]
    assert z == pytest.approx(want, abs=1e-4)


def test_block_resamples_are_circular_and_fixed_length():
    idx = S.block_indices(20, 8, 50, np.random.default_rng(1))
    assert idx.shape == (50, 20) and idx.min() >= 0 and idx.max() < 20
    assert ((np.diff(idx[:, :8], axis=1) % 20) == 1).all()


def test_granger_finds_a_lead():
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + rng.normal(size=200) * 0.3
    assert S.granger_min_p(y, x) < 1e-6 and S.granger_min_p(rng.normal(size=200), x) > 1e-4


def test_weighted_corr_with_equal_weights(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(50, 2))
    df = spark.createDataFrame([(float(a), float(b), 2.0) for a, b in v], "x double, y double, w double")
    r = df.agg(*[c.alias(n) for n, c in P.weighted_corr(F.col("x"), F.col("y"), F.col("w")).items()]).first()
    assert r["r"] == pytest.approx(np.corrcoef(v.T)[0, 1]) and r["n_eff"] == pytest.approx(50)


def test_paired_bootstrap_draws_with_replacement(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"c{i}", *[int(v) for v in rng.integers(0, 9, 4)]) for i in range(120)]
    df = spark.createDataFrame([(k, a + 9, b + 9, x % (a + 1), y % (b + 1), "z") for k, a, b, x, y in rows], "k string, d_a int, d_b int, span_a int, span_b int, extra string")
    counts = R.resampled_sums(df.withColumn("one", F.lit(1)), "k", ["one", "d_a"], 400, block=25).toPandas().set_index("rep").sort_index()
    whole = df.toPandas()
    # every replicate draws as many rows as there are; the spread is that of sums of draws
    assert (counts["one"] == 120).all() and counts.loc[0, "d_a"] == whole["d_a"].sum()
    draws = counts.loc[1:, "d_a"]
    want = np.sqrt(120) * whole["d_a"].std(ddof=0)
    assert abs(draws.mean() - whole["d_a"].sum()) < 4 * want / 20 and 0.85 < draws.std() / want < 1.15
    got = R.paired_f1_bootstrap(df, "k", ["span"], 500).first()
    f1 = lambda t, x: 200 * t[f"span_{x}"].sum() / t[f"d_{x}"].sum()
    assert got["delta"] == pytest.approx(f1(whole, "a") - f1(whole, "b"))
    ref = [(lambda t: f1(t, "a") - f1(t, "b"))(whole.iloc[rng.integers(0, 120, 120)]) for _ in range(1500)]
    lo, hi = np.percentile(ref, [2.5, 97.5])
    assert abs(got["ci_low"] - lo) < 0.25 * (hi - lo) and abs(got["ci_high"] - hi) < 0.25 * (hi - lo) and 0 < got["p"] <= 1
    assert R.paired_f1_bootstrap(df.limit(0), "k", ["span"], 5).count() == 0


@pytest.mark.parametrize("two_way", [False, True])
def test_clustered_errors_against_dummies(spark, two_way):
    rng = np.random.default_rng(2)
    cells = [(t, w) for t in range(5) for w in range(30) if rng.random() < 0.8]
    x = rng.normal(size=len(cells))
    y = 0.3 * x + np.array([t * 0.2 + np.sin(w) for t, w in cells]) + rng.normal(size=len(cells))
    design = [np.ones(len(cells)), x, *[np.array([t == k for t, _ in cells], float) for k in range(1, 5)]]
    if two_way:
        design += [np.array([w == k for _, w in cells], float) for k in sorted({w for _, w in cells})[1:]]
    m = np.column_stack(design)
    inv = np.linalg.pinv(m.T @ m)
    beta = inv @ m.T @ y
    e = y - m @ beta
    weeks = sorted({w for _, w in cells})
    scores = np.array([m[[c[1] == w for c in cells]].T @ e[[c[1] == w for c in cells]] for w in weeks])
    n, k, g = len(cells), m.shape[1], len(weeks)
    cov = inv @ (scores.T @ scores) @ inv * g / (g - 1) * (n - 1) / (n - k)
    df = spark.createDataFrame([(f"t{t}", w, float(a), float(b)) for (t, w), a, b in zip(cells, x, y)] + [("t0", 1, None, 1.0), (None, 1, 1.0, 1.0)], "t string, w int, x double, y double")
    got = R.fixed_effects(df, "x", "y", "t", "w", two_way=two_way).first()
    assert got["beta"] == pytest.approx(beta[1], abs=1e-5) and got["se"] == pytest.approx(np.sqrt(cov[1, 1]), rel=1e-4)
    assert got["n"] == n and got["n_clusters"] == g and got["p"] == pytest.approx(float(np.vectorize(__import__("math").erfc)(abs(got["z"]) / 2**0.5)))
    assert R.fixed_effects(df.where("w = 0"), "x", "y", "t", "w").first()["se"] is None


def test_reality_check_counts():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(150, 6)), np.ones(150)])
    y = 0.5 * x[:, 0] + rng.normal(size=150)
    seen, family, own = S.max_stat_counts(x, y, 8, 400, np.random.default_rng(4))
    assert seen[:6] == pytest.approx([abs(np.corrcoef(x[:, i], y)[0, 1]) for i in range(6)]) and seen[6] == 0
    # the planted feature stands out; the family's best reaches the others almost always, themselves less often
    assert family[0] <= 4 and own[0] <= family[0] and (family[1:] >= own[1:]).all() and family[6] == own[6] == 400
    again = S.max_stat_counts(x, y, 8, 400, np.random.default_rng(4))
    assert (again[1] == family).all()
