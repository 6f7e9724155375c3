"""Weekly panels of labelled pairs, returns, and tests of association between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..schema import CELLS, EMOTIONS, HORIZONS

FEATURES = ["net_valence", "net_valence_mean", "mean_intensity", *[f"emo_{e}" for e in EMOTIONS], *[f"share_{e}" for e in EMOTIONS], *[f"cell_{e}__{c}" for e, c in CELLS]]


def dense_weeks(df: DataFrame, week: str = "week", *keys: str) -> DataFrame:
    """All weeks from the first to the last of ``df``, per group of ``keys``."""
    ends = df.groupBy(*keys).agg(F.min(week).alias("_a"), F.max(week).alias("_b")).where("_a is not null")
    return ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 7 days"))).alias(week))


def weekly_panel(pairs: DataFrame, *keys: str) -> DataFrame:
    """One row per week (named by its Friday) and group, weeks without pairs included with zeros.

    pairs: ``day, emotion, cause, intensity, valence``. All features come from one conditional
    aggregation. Rows without a day fall out.
    """
    rows = pairs.where("day is not null").withColumn("week", T.week_end("day"))
    emo = lambda e: F.count_if(F.col("emotion") == e)
    aggs = [F.count("intensity").alias("n_pairs"), F.sum("valence").alias("net_valence"), F.avg("valence").alias("net_valence_mean"), F.avg("intensity").alias("mean_intensity")]
    aggs += [emo(e).alias(f"emo_{e}") for e in EMOTIONS]
    aggs += [F.sum(F.when((F.col("emotion") == e) & (F.col("cause") == c), F.col("intensity"))).alias(f"cell_{e}__{c}") for e, c in CELLS]
    per = rows.groupBy(*keys, "week").agg(*aggs)
    per = per.withColumns({f"share_{e}": F.try_divide(F.col(f"emo_{e}"), F.col("n_pairs")) for e in EMOTIONS})
    full = dense_weeks(rows, "week", *keys).join(per, [*keys, "week"], "left")
    return full.select(*keys, "week", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ["n_pairs", *FEATURES]])


def to_long(panel: DataFrame, cols: list[str] = FEATURES, *keys: str) -> DataFrame:
    """``week, feature, x`` from a wide panel."""
    return panel.select(*keys, "week", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([*keys, "week"], cols, "feature", "x")


def differenced(long: DataFrame, *keys: str) -> DataFrame:
    """First differences along weeks; the first week has none."""
    w = Window.partitionBy(*keys, "feature").orderBy("week")
    return long.withColumn("x", F.col("x") - F.lag("x").over(w)).where("x is not null")


def weekly_close(prices: DataFrame) -> DataFrame:
    """The last close of each week that isn't null, on a dense weekly index per ticker."""
    rows = prices.withColumn("week", T.week_end("day"))
    last = rows.where("close is not null").groupBy("ticker", "week").agg(F.max_by("close", "day").alias("close"))
    return dense_weeks(rows, "week", "ticker").join(last, ["ticker", "week"], "left")


def forward_returns(weekly: DataFrame, horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """``week, ticker, horizon, y``: returns over so many weeks ahead; 0 means the past week.

    Give a dense weekly index, as rows are counted. Tickers have one row per week, so a window holds
    as many rows as there are weeks.
    """
    w = Window.partitionBy("ticker").orderBy("week")
    filled = F.last("close", ignorenulls=True).over(w)
    wide = weekly.withColumn("_f", filled)
    cols = {f"h_{n}": (F.try_divide(F.col("_f"), F.lag("_f").over(w)) if h == 0 else F.try_divide(F.lead("close", h).over(w), F.col("close"))) - 1 for n, h in horizons.items()}
    wide = wide.select("week", "ticker", *[c.alias(n) for n, c in cols.items()])
    return wide.unpivot(["week", "ticker"], list(cols), "horizon", "y").withColumn("horizon", F.substring("horizon", 3, 100)).where("y is not null")


def grid(long: DataFrame, returns: DataFrame, min_weeks: int = 60) -> DataFrame:
    """``feature, ticker, horizon, n, r``: correlation of every feature with every return.

    One join by week, one aggregation; combinations with few weeks or without variance fall out.
    """
    j = long.where("x is not null").join(returns, "week")
    out = j.groupBy("feature", "ticker", "horizon").agg(F.count(F.lit(1)).alias("n"), S.corr("x", "y").alias("r"))
    return out.where((F.col("n") >= min_weeks) & F.col("r").isNotNull())


def benjamini_hochberg(df: DataFrame, p: str, out: str, *keys: str) -> DataFrame:
    """Adjusted p-values within groups of ``keys``; null p stay null. Families are small by nature:
    one row per test."""
    fam = Window.partitionBy(*(keys or [F.lit(1)]))
    down = fam.orderBy(F.col(p).desc_nulls_last())
    # the greatest rank of equal p-values
    m = F.count(p).over(fam)
    rank = m - F.sum(F.when(F.col(p).isNotNull(), 1).otherwise(0)).over(down.rangeBetween(Window.unboundedPreceding, 0)) + F.count(F.lit(1)).over(Window.partitionBy(*(keys or [F.lit(1)]), p))
    ranked = df.withColumn("_q", F.when(F.col(p).isNotNull(), F.col(p) * m / rank))
    run = fam.orderBy(F.col(p).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_q").over(run)))).drop("_q")


def weighted_corr(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """Weighted Pearson correlation and Kish's effective size, from one pass of weighted moments."""
    sw = F.sum(w)
    mean = lambda c: F.sum(w * c) / sw
    cov = F.sum(w * x * y) / sw - mean(x) * mean(y)
    vx, vy = F.sum(w * x * x) / sw - mean(x) * mean(x), F.sum(w * y * y) / sw - mean(y) * mean(y)
    return {"r": F.try_divide(cov, F.nullif(F.sqrt(F.greatest(vx * vy, F.lit(0.0))), F.lit(0.0))), "n_eff": F.try_divide(sw * sw, F.sum(w * w))}


def demean(df: DataFrame, cols: list[str], *by: str) -> DataFrame:
    """Columns minus their group means."""
    w = Window.partitionBy(*by)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in cols})


def demean_two_way(df: DataFrame, cols: list[str], a: str, b: str, rounds: int = 12) -> DataFrame:
    """Alternating group means until both are gone, for unbalanced panels."""
    for _ in range(rounds):
        df = demean(demean(df, cols, a), cols, b)
    return df


def winsorise(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Values cut to the exact, linearly interpolated quantiles."""
    q = df.agg(F.percentile(col, F.array(F.lit(lo), F.lit(hi))).alias("_q"))
    return df.crossJoin(F.broadcast(q)).withColumn(col, F.least(F.greatest(F.col(col), F.get("_q", F.lit(0))), F.get("_q", F.lit(1)))).drop("_q")


def ticker_panel(labels: DataFrame, bodies: DataFrame, tickers: Column) -> DataFrame:
    """``week, ticker, net_val, n_fear, n_pairs, n_comments`` over comments that name one ticker.

    labels: ``comment_id, pairs``, any number per comment; bodies: ``id, body, day``. Labels without
    pairs fall out; a comment counts once, however many labels it has.
    """
    fold = lambda c, f: F.aggregate(c, F.lit(0.0), lambda acc, p: acc + f(p))
    lab = labels.where(F.size("pairs") > 0).select(
        "comment_id",
        fold("pairs", lambda p: T.valence(p["emotion"], p["intensity"])).alias("nv"),
        F.size(F.filter("pairs", lambda p: p["emotion"] == "fear_anxiety")).alias("nf"),
        F.size("pairs").alias("np"),
    )
    one = bodies.withColumn("t", tickers).where(F.size("t") == 1).select("id", F.get("t", F.lit(0)).alias("ticker"), T.week_start("day").alias("week"))
    return one.join(lab, F.col("id") == F.col("comment_id")).groupBy("week", "ticker").agg(F.sum("nv").alias("net_val"), F.sum("nf").alias("n_fear"), F.sum("np").alias("n_pairs"), F.count_distinct("id").alias("n_comments"))
