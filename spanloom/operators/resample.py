"""Resampling tests: paired bootstrap of summed tallies, clustered standard errors of within estimators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_p
from .panel import demean, demean_two_way

#: Rows of one block: what a task holds of the sample at a time.
BLOCK = 5_000


def resampled_sums(rows: DataFrame, key: str, cols: Sequence[str], reps: int, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """``rep`` and the sums of ``cols`` over ``n`` rows drawn with replacement, for ``reps`` replicates; rep 0 is the sample itself.

    ``key`` is unique. The sample lies in blocks by a hash of the key. The number of draws that fall to each block is
    multinomial and depends on the replicate alone, so every task works it out alike; within a block
    the draws fall to its rows by a multinomial of the replicate and the block. Together that is drawing
    with replacement, and runs repeat exactly. An empty sample gives no rows.
    """
    base = rows.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in cols])
    n = base.count()
    if not n:
        return base.select(F.lit(0).alias("rep"), *cols).limit(0)
    blocks = -(-n // block)
    base = base.withColumn("b", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(blocks)).cast("int"))
    # one number per block comes to the driver
    size = np.zeros(blocks, np.int64)
    for r in base.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["b"]] = r["n"]
    names = list(cols)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        b = int(f["b"].iloc[0])
        f = f.sort_values("k")
        x = f[names].to_numpy()
        out = [x.sum(axis=0)]
        for rep in range(1, reps + 1):
            share = np.random.default_rng([seed, rep]).multinomial(n, size / n)[b]
            out.append(np.random.default_rng([seed, rep, b]).multinomial(share, np.full(len(x), 1 / len(x))) @ x)
        return pd.DataFrame(np.array(out), columns=names).assign(rep=np.arange(reps + 1))[["rep", *names]]

    parts = base.groupBy("b").applyInPandas(run, ", ".join(["rep int", *[f"`{c}` double" for c in names]]))
    return parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])


def paired_f1_bootstrap(tallies: DataFrame, key: str, metrics: Sequence[str], reps: int = 2000, seed: int = 7) -> DataFrame:
    """``metric, delta, ci_low, ci_high, p``: difference of micro F1 of two systems on the same items.

    tallies: for systems ``a`` and ``b`` the columns ``d_a, d_b`` (pairs of gold and system) and
    ``<metric>_a, <metric>_b`` (matches). Items are resampled, so the pairing is kept. The interval
    is the central 95 % of the replicates; p is twice the smaller share of replicates on either side
    of zero, at least 1 / reps. A replicate without pairs counts as 0.
    """
    sums = resampled_sums(tallies, key, ["d_a", "d_b", *[f"{m}_{x}" for m in metrics for x in "ab"]], reps, seed)
    f1 = lambda m, x: F.coalesce(F.try_divide(200.0 * F.col(f"{m}_{x}"), F.col(f"d_{x}")), F.lit(0.0))
    long = sums.select("rep", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (f1(m, "a") - f1(m, "b")).alias("d")) for m in metrics])).alias("x")).select("rep", "x.metric", "x.d")
    drawn = F.when(F.col("rep") > 0, F.col("d"))
    per = long.groupBy("metric").agg(
        F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("delta"), F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.avg((drawn <= 0).cast("int")).alias("lo"), F.avg((drawn >= 0).cast("int")).alias("hi")
    )
    return per.select("metric", "delta", F.get("ci", F.lit(0)).alias("ci_low"), F.get("ci", F.lit(1)).alias("ci_high"), F.least(F.lit(1.0), F.greatest(2 * F.least("lo", "hi"), F.lit(1.0 / reps))).alias("p"))


def fixed_effects(rows: DataFrame, x: str, y: str, unit: str, cluster: str, *, two_way: bool = False) -> DataFrame:
    """One row ``beta, se, z, p, n, n_clusters``: slope of ``y`` on ``x`` with fixed effects and clustered errors.

    Effects are those of ``unit`` and, with ``two_way``, of ``cluster`` too; they are swept out by
    demeaning. The variance sums the squared scores of the clusters, times G/(G-1) (n-1)/(n-k), where k
    counts the slope and all effects. p is that of a normal z. Rows with a null take no part; null
    results without two clusters or a varying ``x``.
    """
    kept = rows.where(" and ".join(f"`{c}` is not null" for c in (x, y, unit, cluster))).select(F.col(unit).alias("u"), F.col(cluster).alias("c"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    z = demean_two_way(kept, ["x", "y"], "u", "c") if two_way else demean(kept, ["x", "y"], "u")
    b = z.agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("beta"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("units"))
    score = z.crossJoin(F.broadcast(b)).groupBy("c").agg(F.sum(F.col("x") * (F.col("y") - F.col("beta") * F.col("x"))).alias("g"), *[F.first(v).alias(v) for v in ("beta", "sxx", "n", "units")])
    s = score.agg(*[F.first(v).alias(v) for v in ("beta", "sxx", "n", "units")], F.sum(F.col("g") * F.col("g")).alias("gg"), F.count(F.lit(1)).alias("n_clusters"))
    groups = F.col("n_clusters")
    k = F.col("units") + groups if two_way else F.col("units") + 1
    factor = F.try_divide(groups, groups - 1) * F.try_divide(F.col("n") - 1, F.col("n") - k)
    out = s.select("beta", F.try_divide(F.sqrt(F.col("gg") * factor), F.col("sxx")).alias("se"), "n", "n_clusters")
    out = out.withColumn("z", F.try_divide("beta", "se"))
    return out.select("beta", "se", "z", normal_p("z").alias("p"), "n", "n_clusters")
