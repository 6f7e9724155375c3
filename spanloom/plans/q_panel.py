"""Queries of weekly panels, returns and tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..operators import panel as P
from ..operators import resample as FE
from ..operators.relational import range_label, sarcasm_treatments
from ..schema import CELLS, EMOTIONS, HORIZONS, VALENCE
from . import bindings as B
from .bindings import sql, week_sql
from .q_text import TICK_SQL, UNIVERSE
from .registry import Registry

PANEL = Registry()
SPLIT = "1999-01-01"
BASKET = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
GAUGE = "5-LOW"
REGIMES = [("r1", "1995-01-01", "1995-12-31"), ("r2", "1996-01-01", "1997-06-30"), ("r3", "1997-07-01", "1998-12-31"), ("r4", "1999-01-01", "1999-12-31"), ("r5", "2000-01-01", "2001-12-31")]


def q(name: str, body: str, *views: str):
    return PANEL.add(name, sql(body, *views))


def panel_ctes(src: str = "pr", tag: str = "", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    using = f"({keys}, week)" if keys else "(week)"
    emo = ", ".join(f"count(*) FILTER (emotion = '{e}') AS emo_{e}" for e in EMOTIONS)
    cells = ", ".join(f"sum(intensity) FILTER (emotion = '{e}' AND cause = '{c}') AS cell_{e}__{c}" for e, c in CELLS)
    out = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["n_pairs", "net_valence", "net_valence_mean", "mean_intensity", *[f"emo_{e}" for e in EMOTIONS], *[f"cell_{e}__{c}" for e, c in CELLS]])
    shares = ", ".join(f"coalesce(emo_{e}::DOUBLE / nullif(n_pairs, 0), 0) AS share_{e}" for e in EMOTIONS)
    return f"""pw{tag} AS (SELECT {k}{week_sql('day')} AS week, emotion, cause, intensity, valence FROM {src}),
    pa{tag} AS (SELECT {k}week, count(intensity) AS n_pairs, sum(valence) AS net_valence, avg(valence) AS net_valence_mean, avg(intensity) AS mean_intensity, {emo}, {cells} FROM pw{tag} GROUP BY ALL),
    dw{tag} AS (SELECT {k}unnest(generate_series(a, b, INTERVAL 7 DAY))::DATE AS week FROM (SELECT {k}min(week)::TIMESTAMP AS a, max(week)::TIMESTAMP AS b FROM pw{tag} {'GROUP BY ' + keys if keys else ''})),
    panel{tag} AS (SELECT {k}week, {out}, {shares} FROM dw{tag} LEFT JOIN pa{tag} USING {using})"""


def long_ctes(tag: str = "", keys: str = "", cols=P.FEATURES) -> str:
    k = f"{keys}, " if keys else ""
    rows = " UNION ALL ".join(f"SELECT {k}week, '{c}' AS feature, {c}::DOUBLE AS x FROM panel{tag}" for c in cols)
    return f"""long{tag} AS ({rows}), dif{tag} AS (SELECT {k}week, feature, x - lag(x) OVER (PARTITION BY {k}feature ORDER BY week) AS x FROM long{tag})"""


CLOSE = f"""cw AS (SELECT ticker, {week_sql('day')} AS week, day, close FROM px), cl AS (SELECT ticker, week, max_by(close, day) AS close FROM cw WHERE close IS NOT NULL GROUP BY ALL),
    cd AS (SELECT ticker, unnest(generate_series(a, b, INTERVAL 7 DAY))::DATE AS week FROM (SELECT ticker, min(week)::TIMESTAMP AS a, max(week)::TIMESTAMP AS b FROM cw GROUP BY 1)),
    wclose AS (SELECT ticker, week, close FROM cd LEFT JOIN cl USING (ticker, week))"""
RETS = CLOSE + ", ret AS (" + " UNION ALL ".join(f"SELECT week, ticker, '{n}' AS horizon, lead(close, {h}) OVER (PARTITION BY ticker ORDER BY week) / close - 1 AS y FROM wclose" for n, h in HORIZONS.items()) + ")"
R_SQL = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"

_panel = lambda s, d: P.weekly_panel(B.market_pairs(s, d))
_diff = lambda s, d, cols=P.FEATURES: P.differenced(P.to_long(_panel(s, d), cols))
_rets = lambda s, d: P.forward_returns(P.weekly_close(B.prices(s, d)))
BASK = "(" + ", ".join(f"'{b}'" for b in BASKET) + ")"


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _rounded(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


_WIDE = ["net_valence", "net_valence_mean", "mean_intensity"]
q("agg01_weekly_panel", f"WITH {panel_ctes()} SELECT week, n_pairs, {_rounded(_WIDE)} FROM panel", "pr")(lambda s, d: _r6(_panel(s, d).select("week", "n_pairs", *_WIDE), *_WIDE))
_E = [f"emo_{e}" for e in EMOTIONS]
_S = [f"share_{e}" for e in EMOTIONS]
_C = [f"cell_{e}__{c}" for e, c in CELLS]
q("agg02_emotion_shares", f"WITH {panel_ctes()} SELECT week, {', '.join(_E)}, {_rounded(_S)} FROM panel", "pr")(lambda s, d: _r6(_panel(s, d).select("week", *_E, *_S), *_S))
q("agg03_cells", f"WITH {panel_ctes()} SELECT week, {_rounded(_C)} FROM panel", "pr")(lambda s, d: _r6(_panel(s, d).select("week", *_C), *_C))
q("agg04_extra_cell", f"WITH {panel_ctes()} SELECT p.week, round(coalesce(x, 0), 6) AS cell FROM panel p LEFT JOIN (SELECT week, sum(intensity) AS x FROM pw WHERE emotion = 'fear_anxiety' AND cause = 'geopolitics' GROUP BY 1) g USING (week)", "pr")(
    lambda s, d: _panel(s, d)
    .select("week")
    .join(B.market_pairs(s, d).where("emotion = 'fear_anxiety' and cause = 'geopolitics'").groupBy(T.week_end("day").alias("week")).agg(F.sum("intensity").alias("x")), "week", "left")
    .select("week", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("cell"))
)
q("src17_prices_long", "SELECT day, ticker, round(close, 4) AS close FROM px", "px")(lambda s, d: B.prices(s, d).select("day", "ticker", F.round("close", 4).alias("close")))


@q("src18_daily_returns", "SELECT day, ticker, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1, 6) AS ret1d FROM px", "px")
def src18(s, d):
    return B.prices(s, d).select("day", "ticker", F.round(F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("day")) - 1, 6).alias("ret1d"))


q("src20_price_coverage", "SELECT ticker, count(close) AS n, count(close) < 100 AS is_short FROM px GROUP BY 1", "px")(lambda s, d: B.prices(s, d).groupBy("ticker").agg(F.count("close").alias("n")).withColumn("is_short", F.col("n") < 100))
q("win03_weekly_close", f"WITH {CLOSE} SELECT ticker, week, round(close, 4) AS close FROM wclose", "px")(lambda s, d: P.weekly_close(B.prices(s, d)).select("ticker", "week", F.round("close", 4).alias("close")))
q("win02_forward_returns", f"WITH {RETS} SELECT week, ticker, horizon, round(y, 6) AS y FROM ret WHERE y IS NOT NULL", "px")(lambda s, d: _r6(_rets(s, d), "y"))
q("src19_forward_returns_long", f"WITH {RETS} SELECT week - 6 AS week_start, ticker, round(y, 6) AS fwd FROM ret WHERE y IS NOT NULL AND horizon = '1w'", "px")(lambda s, d: _rets(s, d).where("horizon = '1w'").select(F.date_sub("week", 6).alias("week_start"), "ticker", F.round("y", 6).alias("fwd")))
q("agg05_basket_return", f"WITH {RETS} SELECT week, horizon, round(avg(y), 6) AS y FROM ret WHERE y IS NOT NULL AND ticker IN {BASK} GROUP BY 1, 2", "px")(lambda s, d: _rets(s, d).where(F.col("ticker").isin(*BASKET)).groupBy("week", "horizon").agg(F.round(F.avg("y"), 6).alias("y")))
q("misc05_gauge_weekly", f"WITH {CLOSE} SELECT week, round(close, 4) AS gauge FROM wclose WHERE ticker = '{GAUGE}'", "px")(lambda s, d: P.weekly_close(B.prices(s, d)).where(F.col("ticker") == GAUGE).select("week", F.round("close", 4).alias("gauge")))
q("win01_first_difference", f"WITH {panel_ctes()}, {long_ctes()} SELECT week, feature, round(x, 6) AS x FROM dif WHERE x IS NOT NULL", "pr")(lambda s, d: _r6(_diff(s, d), "x"))


@q("win04_returns_and_lags", f"""WITH {CLOSE}, f AS (SELECT ticker, week, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY week) AS c FROM wclose),
    r AS (SELECT ticker, week, c / lag(c) OVER (PARTITION BY ticker ORDER BY week) - 1 AS r FROM f)
    SELECT ticker, week, round(r, 6) AS r, {", ".join(f"round(lag(r, {k}) OVER (PARTITION BY ticker ORDER BY week), 6) AS lag{k}" for k in range(1, 5))} FROM r""", "px")  # fmt: skip
def win04(s, d):
    w = Window.partitionBy("ticker").orderBy("week")
    c = F.last("close", ignorenulls=True).over(w)
    r = P.weekly_close(B.prices(s, d)).withColumn("c", c).withColumn("r", F.try_divide(F.col("c"), F.lag("c").over(w)) - 1)
    return r.select("ticker", "week", F.round("r", 6).alias("r"), *[F.round(F.lag("r", k).over(w), 6).alias(f"lag{k}") for k in range(1, 5)])


q("joi10_panel_returns", f"WITH {panel_ctes()}, {RETS} SELECT week, ticker, horizon, n_pairs, round(y, 6) AS y FROM panel JOIN ret USING (week) WHERE y IS NOT NULL", "pr", "px")(lambda s, d: _r6(_panel(s, d).select("week", "n_pairs").join(_rets(s, d), "week"), "y").select("week", "ticker", "horizon", "n_pairs", "y"))
_XY = f"WITH {panel_ctes()}, {long_ctes()}, {RETS}, bk AS (SELECT week, avg(y) AS y FROM ret WHERE y IS NOT NULL AND horizon = '1w' AND ticker IN {BASK} GROUP BY 1), xy AS (SELECT week, feature, x, y FROM dif JOIN bk USING (week) WHERE x IS NOT NULL)"


def _basket(s, d):
    return _rets(s, d).where(F.col("ticker").isin(*BASKET) & (F.col("horizon") == "1w")).groupBy("week").agg(F.avg("y").alias("y"))


def _xy(s, d, cols=P.FEATURES):
    return _diff(s, d, cols).join(_basket(s, d), "week")


q("joi11_aligned", f"{_XY} SELECT feature, count(*) AS n FROM xy GROUP BY 1", "pr", "px")(lambda s, d: _xy(s, d).groupBy("feature").agg(F.count(F.lit(1)).alias("n")))
q("agg29_pearson", f"{_XY} SELECT feature, count(*) AS n, round({R_SQL}, 6) AS r FROM xy GROUP BY 1", "pr", "px")(lambda s, d: _xy(s, d).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(S.corr("x", "y"), 6).alias("r")))
_GRID = f"WITH {panel_ctes()}, {long_ctes()}, {RETS}, gr AS (SELECT feature, ticker, horizon, count(*) AS n, {R_SQL} AS r FROM (SELECT * FROM dif JOIN ret USING (week) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY ALL HAVING count(*) >= 60)"
_grid = lambda s, d: P.grid(_diff(s, d), _rets(s, d))
q("agg30_grid", f"{_GRID} SELECT feature, ticker, horizon, n, round(r, 6) AS r FROM gr WHERE r IS NOT NULL", "pr", "px")(lambda s, d: _r6(_grid(s, d), "r"))


@PANEL.add("agg30_grid_p")
def agg30p(s, d):
    """The grid with two-sided p-values and their adjustment over the whole family."""
    g = _grid(s, d).withColumn("p", S.pearson_p("r", "n"))
    return P.benjamini_hochberg(g, "p", "q")


# a stand-in p from r keeps the adjustment comparable in SQL
_PQ = "(1 - abs(r))"
q("agg32_benjamini_hochberg", f"""{_GRID}, pv AS (SELECT feature, ticker, horizon, round({_PQ}, 9) AS p FROM gr WHERE r IS NOT NULL), m AS (SELECT count(*) AS m FROM pv),
    rk AS (SELECT *, p * m / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS q0 FROM pv, m)
    SELECT feature, ticker, horizon, round(least(1.0, min(q0) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM rk""", "pr", "px")(  # fmt: skip
    lambda s, d: _r6(P.benjamini_hochberg(_grid(s, d).withColumn("p", F.round(1 - F.abs("r"), 9)), "p", "q").select("feature", "ticker", "horizon", "q"), "q")
)
q("top06_smallest_p", f"{_GRID} SELECT feature, ticker, horizon, round({_PQ}, 6) AS p FROM gr WHERE r IS NOT NULL ORDER BY p, feature, ticker, horizon LIMIT 12", "pr", "px")(lambda s, d: _grid(s, d).select("feature", "ticker", "horizon", F.round(1 - F.abs("r"), 6).alias("p")).orderBy("p", "feature", "ticker", "horizon").limit(12))


@PANEL.add("agg31_granger")
def agg31(s, d):
    """Least p over lags of whether a feature helps to predict a return; one small series per group."""

    def test(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("week")
        x, y = f["x"].to_numpy(float), f["y"].to_numpy(float)
        return pd.DataFrame({"feature": [f["feature"].iloc[0]], "ticker": [f["ticker"].iloc[0]], "horizon": [f["horizon"].iloc[0]], "p_min": [S.granger_min_p(y, x)]})

    return _diff(s, d).join(_rets(s, d), "week").groupBy("feature", "ticker", "horizon").applyInPandas(test, "feature string, ticker string, horizon string, p_min double")


_WXY = f"WITH {panel_ctes()}, {RETS}, wx AS (SELECT ticker, n_pairs AS w, net_valence AS x, y FROM panel JOIN ret USING (week) WHERE y IS NOT NULL AND horizon = '1w')"
_WR = "(sum(w*x*y)/sum(w) - sum(w*x)/sum(w)*sum(w*y)/sum(w)) / sqrt((sum(w*x*x)/sum(w) - (sum(w*x)/sum(w))**2) * (sum(w*y*y)/sum(w) - (sum(w*y)/sum(w))**2))"


def _wxy(s, d):
    return _panel(s, d).select("week", F.col("n_pairs").alias("w"), F.col("net_valence").alias("x")).join(_rets(s, d).where("horizon = '1w'"), "week")


q("agg33_weighted_pearson", f"{_WXY} SELECT ticker, round({_WR}, 5) AS r, round(sum(w)::DOUBLE * sum(w) / sum(w * w), 4) AS n_eff FROM wx GROUP BY 1", "pr", "px")(
    lambda s, d: _wxy(s, d).groupBy("ticker").agg(*[F.round(c, 5 if n == "r" else 4).alias(n) for n, c in P.weighted_corr(F.col("x"), F.col("y"), F.col("w")).items()])
)
q("agg34_weighted_pearson_only", f"{_WXY} SELECT ticker, round({_WR}, 5) AS r FROM wx GROUP BY 1", "pr", "px")(lambda s, d: _wxy(s, d).groupBy("ticker").agg(F.round(P.weighted_corr(F.col("x"), F.col("y"), F.col("w"))["r"], 5).alias("r")))

_RATE = f"WITH {panel_ctes()}, rr AS (SELECT {week_sql('day')} AS week, avg(sarcasm::INT) AS y FROM pr GROUP BY 1), lg AS ({' UNION ALL '.join([f'SELECT week, {chr(39)}{c}{chr(39)} AS feature, {c}::DOUBLE AS x FROM panel' for c in _S] + [f'SELECT week, {chr(39)}{c}{chr(39)}, {c} / nullif(n_pairs, 0) FROM panel' for c in _C])})"
q("agg35_composition", f"{_RATE} SELECT feature, count(*) AS n, round({R_SQL}, 6) AS r FROM lg JOIN rr USING (week) WHERE x IS NOT NULL GROUP BY 1", "pr")(
    lambda s, d: P.to_long(_panel(s, d).select("week", *_S, *[F.try_divide(F.col(c), F.col("n_pairs")).alias(c) for c in _C]), [*_S, *_C])
    .where("x is not null")
    .join(B.market_pairs(s, d).groupBy(T.week_end("day").alias("week")).agg(F.avg(F.col("sarcasm").cast("int")).alias("y")), "week")
    .groupBy("feature")
    .agg(F.count(F.lit(1)).alias("n"), F.round(S.corr("x", "y"), 6).alias("r"))
)
_HALF = f"hp AS (SELECT *, ('0x' || substr(md5(cid::VARCHAR), 32, 1))::INT % 2 AS half FROM pr), {panel_ctes('hp', 'h', 'half')}, {long_ctes('h', 'half', ['net_valence', 'share_fear_anxiety', _C[0]])}"


def _halves(s, d):
    rows = B.market_pairs(s, d).withColumn("half", T.half(F.col("cid").cast("string")))
    return P.to_long(P.weekly_panel(rows, "half"), ["net_valence", "share_fear_anxiety", _C[0]], "half")


q("src07_pairs_with_half", "SELECT ('0x' || substr(md5(cid::VARCHAR), 32, 1))::INT % 2 AS half, count(*) AS n, count(DISTINCT cid) AS n_ids FROM pr GROUP BY 1", "pr")(lambda s, d: B.market_pairs(s, d).groupBy(T.half(F.col("cid").cast("string")).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cid").alias("n_ids")))
q("misc06_half_panels", f"WITH {_HALF} SELECT half, week, feature, round(x, 6) AS x FROM longh", "pr")(lambda s, d: _r6(_halves(s, d), "x").select("half", "week", "feature", "x"))


def _reliability(s, d):
    wide = _halves(s, d).groupBy("week", "feature").pivot("half", [0, 1]).agg(F.sum("x")).select("week", "feature", F.coalesce("0", F.lit(0.0)).alias("a"), F.coalesce("1", F.lit(0.0)).alias("b"))
    w = Window.partitionBy("feature").orderBy("week")
    dif = wide.select("feature", (F.col("a") - F.lag("a").over(w)).alias("x"), (F.col("b") - F.lag("b").over(w)).alias("y")).where("x is not null")
    return dif.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), S.corr("x", "y").alias("r")).withColumn("rel", F.try_divide(2 * F.col("r"), 1 + F.col("r")))


_REL = f"WITH {_HALF}, wd AS (SELECT week, feature, coalesce(sum(x) FILTER (half = 0), 0) AS a, coalesce(sum(x) FILTER (half = 1), 0) AS b FROM longh GROUP BY ALL), dd AS (SELECT feature, a - lag(a) OVER (PARTITION BY feature ORDER BY week) AS x, b - lag(b) OVER (PARTITION BY feature ORDER BY week) AS y FROM wd), rl AS (SELECT feature, count(*) AS n, {R_SQL} AS r FROM dd WHERE x IS NOT NULL GROUP BY 1)"
q("agg36_split_half", f"{_REL} SELECT feature, n, round(r, 6) AS r, round(2 * r / (1 + r), 6) AS rel FROM rl", "pr")(lambda s, d: _r6(_reliability(s, d), "r", "rel"))
q("agg37_deattenuated", f"{_REL} SELECT feature, round(greatest(-0.999, least(0.999, 0.1 / sqrt(abs(2 * r / (1 + r))))), 6) AS r_true, round(1.96 / sqrt(n), 6) AS mde FROM rl", "pr")(
    lambda s, d: _reliability(s, d).select("feature", F.round(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), 0.1 / F.sqrt(F.abs("rel")))), 6).alias("r_true"), F.round(1.96 / F.sqrt("n"), 6).alias("mde"))
)


def _resampled(s, d, features, reps, per_task, fn, schema, until=None):
    """Resampling in parallel: the joined series is small (one row per week) and goes to every task by value."""
    xy = _xy(s, d, features)
    rows = (xy if until is None else xy.where(F.col("week") <= F.lit(until).cast("date"))).toPandas()
    wide = rows.pivot(index="week", columns="feature", values="x").join(rows.drop_duplicates("week").set_index("week")["y"]).sort_index()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block in f["id"]:
                yield fn(wide, np.random.default_rng(1000 + int(block)), per_task)

    tasks = reps // per_task
    return s.range(0, tasks, 1, tasks).mapInPandas(run, schema)


@PANEL.add("agg38_block_bootstrap")
def agg38(s, d):
    """Circular block bootstrap of the correlation of net valence with the basket: 8-week blocks of fixed length."""

    def fn(wide, rng, reps):
        x, y = wide["net_valence"].to_numpy(), wide["y"].to_numpy()
        return pd.DataFrame({"r": [np.corrcoef(x[i], y[i])[0, 1] for i in S.block_indices(len(x), 8, reps, rng)]})

    rs = _resampled(s, d, ["net_valence"], 4000, 500, fn, "r double")
    q = rs.agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.avg((F.col("r") <= 0).cast("int")).alias("lo"), F.avg((F.col("r") >= 0).cast("int")).alias("hi"), F.count(F.lit(1)).alias("b"))
    return q.select(F.get("ci", F.lit(0)).alias("ci_low"), F.get("ci", F.lit(1)).alias("ci_high"), F.greatest(2 * F.least("lo", "hi"), 1 / F.col("b")).alias("p"), "b")


@PANEL.add("agg39_reality_check")
def agg39(s, d):
    """Selection-adjusted p per emotion feature, in-sample: resampled returns against the best of the family."""
    feats = [*_E, *_S]
    reps = 5000

    def fn(wide, rng, n):
        seen, family, own = S.max_stat_counts(wide[feats].to_numpy(), wide["y"].to_numpy(), 8, n, rng)
        return pd.DataFrame({"feature": feats, "abs_r": seen, "family": family, "own": own})

    got = _resampled(s, d, feats, reps, 500, fn, "feature string, abs_r double, family long, own long", until=SPLIT)
    per = got.groupBy("feature").agg(F.first("abs_r").alias("abs_r"), ((F.sum("family") + 1) / (reps + 1)).alias("p_family"), ((F.sum("own") + 1) / (reps + 1)).alias("p_feature"))
    top = per.agg(F.max("abs_r").alias("family_max"))
    return per.crossJoin(F.broadcast(top)).select("feature", "abs_r", "family_max", "p_family", "p_feature")


q("agg39_family_max", f"{_XY} SELECT round(max(abs(r)), 6) AS family_max FROM (SELECT feature, {R_SQL} AS r FROM xy WHERE week <= DATE '{SPLIT}' AND feature IN ({', '.join(f"'{f}'" for f in [*_E, *_S])}) GROUP BY 1)", "pr", "px")(
    lambda s, d: agg39(s, d).select(F.round("family_max", 6).alias("family_max")).distinct()
)


_IS = f"{_XY}, sp AS (SELECT feature, week > DATE '{SPLIT}' AS oos, {R_SQL} AS r, count(*) AS n FROM xy GROUP BY 1, 2)"


def _split(s, d):
    return _xy(s, d).groupBy("feature", (F.col("week") > F.lit(SPLIT).cast("date")).alias("oos")).agg(S.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


q("agg41_split_samples", f"{_IS} SELECT feature, oos, n, round(r, 6) AS r FROM sp", "pr", "px")(lambda s, d: _r6(_split(s, d), "r"))
q("agg40_in_sample_rank", f"{_IS} SELECT feature, round(r, 6) AS r, rank() OVER (ORDER BY round(r, 9)) AS rank FROM sp WHERE NOT oos", "pr", "px")(lambda s, d: _split(s, d).where("not oos").select("feature", F.round("r", 6).alias("r"), F.rank().over(Window.orderBy(F.round("r", 9))).alias("rank")))
q("win11_feature_rank", f"{_IS} SELECT rank FROM (SELECT feature, rank() OVER (ORDER BY round(r, 9)) AS rank FROM sp WHERE NOT oos) WHERE feature = 'emo_excitement_euphoria'", "pr", "px")(lambda s, d: _split(s, d).where("not oos").select("feature", F.rank().over(Window.orderBy(F.round("r", 9))).alias("rank")).where("feature = 'emo_excitement_euphoria'").select("rank"))


@PANEL.add("agg40_one_sided_p")
def agg40p(s, d):
    """Out-of-sample p in the direction seen in-sample."""
    w = _split(s, d).groupBy("feature").pivot("oos", [False, True]).agg(F.first("r").alias("r"), F.first("n").alias("n"))
    p2 = S.pearson_p("true_r", "true_n")
    out = w.withColumn("p2", p2)
    return out.select("feature", F.col("false_r").alias("r_is"), F.col("true_r").alias("r_oos"), F.when(F.signum("true_r") == F.signum("false_r"), F.col("p2") / 2).otherwise(1 - F.col("p2") / 2).alias("p1"))


_V4 = f"{_XY}, base AS (SELECT xy.week, x, y, n_pairs AS w FROM xy JOIN panel USING (week) WHERE feature = 'net_valence'), va AS (SELECT drop96, week > DATE '{SPLIT}' AS oos, x, y, w FROM base, (VALUES (FALSE), (TRUE)) v(drop96) WHERE NOT (drop96 AND year(week) = 1996))"
q("agg42_robust_variants", f"{_V4} SELECT drop96, weighted, oos, count(*) AS n, round(CASE WHEN weighted THEN ({_WR}) ELSE {R_SQL} END, 5) AS r FROM va, (VALUES (FALSE), (TRUE)) t(weighted) GROUP BY 1, 2, 3", "pr", "px")(
    lambda s, d: _xy(s, d, ["net_valence"])
    .join(_panel(s, d).select("week", F.col("n_pairs").alias("w")), "week")
    .withColumn("drop96", F.explode(F.when(F.year("week") == 1996, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    .withColumn("weighted", F.explode(F.array(F.lit(False), F.lit(True))))
    .groupBy("drop96", "weighted", (F.col("week") > F.lit(SPLIT).cast("date")).alias("oos"))
    .agg(F.count(F.lit(1)).alias("n"), S.corr("x", "y").alias("ru"), P.weighted_corr(F.col("x"), F.col("y"), F.col("w"))["r"].alias("rw"))
    .select("drop96", "weighted", "oos", "n", F.round(F.when(F.col("weighted"), F.col("rw")).otherwise(F.col("ru")), 5).alias("r"))
)
q("win13_year", f"WITH {panel_ctes()} SELECT year(week)::INT AS year, count(*) AS n_weeks FROM panel GROUP BY 1", "pr")(lambda s, d: _panel(s, d).groupBy(F.year("week").alias("year")).agg(F.count(F.lit(1)).alias("n_weeks")))
q("src23_censoring", f"SELECT {week_sql('CAST(make_timestamp(created_utc * 1000000) AS DATE)')} AS week, count(*) AS n, count(*) FILTER (body IN ('[removed]', '[deleted]')) AS removed, round(avg((body IN ('[removed]', '[deleted]'))::INT), 6) AS removed_rate FROM c WHERE created_utc IS NOT NULL GROUP BY 1", "c")(
    lambda s, d: B.comments(s, d)
    .where("created_utc is not null")
    .withColumn("gone", F.col("body").isin("[removed]", "[deleted]"))
    .groupBy(T.week_end(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_utc") / 86400).cast("int"))).alias("week"))
    .agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("removed"), F.round(F.avg(F.col("gone").cast("int")), 6).alias("removed_rate"))
)

# gauge and regimes
_GZ = f"WITH {panel_ctes()}, {long_ctes(cols=['net_valence', 'share_fear_anxiety'])}, {CLOSE}, gz AS (SELECT week, close - lag(close) OVER (ORDER BY week) AS y FROM wclose WHERE ticker = '{GAUGE}'), gx AS (SELECT week, feature, x, y FROM dif JOIN gz USING (week) WHERE x IS NOT NULL AND y IS NOT NULL)"
_CASE = "CASE " + " ".join(f"WHEN week BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, a, b in REGIMES) + " END"


def _gauge(s, d):
    return P.weekly_close(B.prices(s, d)).where(F.col("ticker") == GAUGE).select("week", (F.col("close") - F.lag("close").over(Window.orderBy("week"))).alias("y")).where("y is not null")


def _gx(s, d):
    return _diff(s, d, ["net_valence", "share_fear_anxiety"]).join(_gauge(s, d), "week").withColumn("regime", range_label(F.col("week"), REGIMES))


q("joi14_regimes", f"{_GZ} SELECT regime, count(*) AS n FROM (SELECT {_CASE} AS regime FROM gx) WHERE regime IS NOT NULL GROUP BY 1", "pr", "px")(lambda s, d: _gx(s, d).where("regime is not null").groupBy("regime").agg(F.count(F.lit(1)).alias("n")))
q("win09_regime_corr", f"{_GZ} SELECT regime, feature, count(*) AS n, round({R_SQL}, 6) AS r FROM (SELECT *, {_CASE} AS regime FROM gx) WHERE regime IS NOT NULL GROUP BY 1, 2", "pr", "px")(lambda s, d: _gx(s, d).where("regime is not null").groupBy("regime", "feature").agg(F.count(F.lit(1)).alias("n"), F.round(S.corr("x", "y"), 6).alias("r")))
q("misc07_guarded_corr", f"{_GZ} SELECT regime, feature, CASE WHEN count(*) >= 12 THEN round({R_SQL}, 6) END AS r FROM (SELECT *, {_CASE} AS regime FROM gx) WHERE regime IS NOT NULL GROUP BY 1, 2", "pr", "px")(
    lambda s, d: _gx(s, d).where("regime is not null").groupBy("regime", "feature").agg(F.count(F.lit(1)).alias("n"), S.corr("x", "y").alias("r")).select("regime", "feature", F.when(F.col("n") >= 12, F.round("r", 6)).alias("r"))
)
q("win08_regime_demeaned", f"{_GZ}, dm AS (SELECT feature, x - avg(x) OVER (PARTITION BY feature, regime) AS x, y - avg(y) OVER (PARTITION BY feature, regime) AS y FROM (SELECT *, {_CASE} AS regime FROM gx) WHERE regime IS NOT NULL) SELECT feature, round({R_SQL}, 6) AS r FROM dm GROUP BY 1", "pr", "px")(
    lambda s, d: P.demean(_gx(s, d).where("regime is not null"), ["x", "y"], "feature", "regime").groupBy("feature").agg(F.round(S.corr("x", "y"), 6).alias("r"))
)

# sarcasm treatments
_TR = "tr AS (SELECT treatment, day, emotion, cause, intensity, CASE WHEN treatment = 'flip' AND sarcasm THEN -valence ELSE valence END AS valence FROM pr, (VALUES ('baseline'), ('drop'), ('flip')) t(treatment) WHERE NOT (treatment = 'drop' AND sarcasm))"
_TF = ["net_valence", "share_fear_anxiety", "emo_surprise", "mean_intensity"]
_TG = f"WITH {_TR}, {panel_ctes('tr', 't', 'treatment')}, {long_ctes('t', 'treatment', _TF)}, {CLOSE}, gz AS (SELECT week, close - lag(close) OVER (ORDER BY week) AS y FROM wclose WHERE ticker = '{GAUGE}'), tg AS (SELECT treatment, feature, {R_SQL} AS r, count(*) AS n FROM dift JOIN gz USING (week) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)"


def _treated(s, d):
    rows = sarcasm_treatments(B.market_pairs(s, d))
    long = P.differenced(P.to_long(P.weekly_panel(rows, "treatment"), _TF, "treatment"), "treatment")
    return long.join(_gauge(s, d), "week").groupBy("treatment", "feature").agg(S.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


q("agg57_construct_validity", f"{_TG} SELECT treatment, feature, n, round(r, 6) AS r FROM tg", "pr", "px")(lambda s, d: _r6(_treated(s, d), "r").select("treatment", "feature", "n", "r"))
q("set02_treatment_union", f"{_TG} SELECT treatment, count(*) AS n FROM tg GROUP BY 1", "pr", "px")(lambda s, d: _treated(s, d).groupBy("treatment").agg(F.count(F.lit(1)).alias("n")))
q("agg49_treatment_pivot", f"{_TG} SELECT feature, {', '.join(f'round(avg(r) FILTER (treatment = {chr(39)}{t}{chr(39)}), 6) AS {t}' for t in ('baseline', 'drop', 'flip'))} FROM tg GROUP BY 1".replace(" AS drop", ' AS "drop"'), "pr", "px")(
    lambda s, d: _r6(_treated(s, d).groupBy("feature").pivot("treatment", ["baseline", "drop", "flip"]).agg(F.avg("r")), "baseline", "drop", "flip")
)
_CH = f"{_TG}, ch AS (SELECT t.treatment, t.feature, t.r - b.r AS dr, sign(t.r) <> sign(b.r) AND greatest(abs(t.r), abs(b.r)) >= 0.05 AS flipped FROM tg t JOIN tg b ON b.feature = t.feature AND b.treatment = 'baseline' WHERE t.treatment <> 'baseline')"


def _changes(s, d):
    t = _treated(s, d)
    b = t.where("treatment = 'baseline'").select(F.col("feature").alias("bf"), F.col("r").alias("b"))
    return t.where("treatment <> 'baseline'").join(b, F.col("feature") == F.col("bf")).select("treatment", "feature", (F.col("r") - F.col("b")).alias("dr"), ((F.signum("r") != F.signum("b")) & (F.greatest(F.abs("r"), F.abs("b")) >= 0.05)).alias("flipped"))


q("agg50_change_detection", f"{_CH} SELECT treatment, count(*) FILTER (abs(dr) > 1e-9) AS moved, count(*) FILTER (abs(dr) <= 1e-9) AS untouched, count(*) FILTER (flipped) AS flipped FROM ch GROUP BY 1", "pr", "px")(
    lambda s, d: _changes(s, d).groupBy("treatment").agg(F.count_if(F.abs("dr") > 1e-9).alias("moved"), F.count_if(F.abs("dr") <= 1e-9).alias("untouched"), F.count_if("flipped").alias("flipped"))
)
q("top08_largest_change", f"{_CH} SELECT treatment, feature, round(dr, 6) AS dr FROM ch ORDER BY abs(round(dr, 6)) DESC, treatment, feature LIMIT 5", "pr", "px")(lambda s, d: _changes(s, d).select("treatment", "feature", F.round("dr", 6).alias("dr")).orderBy(F.desc(F.abs("dr")), "treatment", "feature").limit(5))
q("agg06_sarcasm_incidence", "SELECT coalesce(emotion, 'all') AS emotion, count(*) AS n, count(*) FILTER (sarcasm) AS sarcastic, round(avg(sarcasm::INT), 6) AS rate FROM pr GROUP BY ROLLUP (emotion)", "pr")(
    lambda s, d: B.market_pairs(s, d).rollup("emotion").agg(F.count(F.lit(1)).alias("n"), F.count_if("sarcasm").alias("sarcastic"), F.round(F.avg(F.col("sarcasm").cast("int")), 6).alias("rate")).withColumn("emotion", F.coalesce("emotion", F.lit("all")))
)

# tickers
_SIGN = " ".join(f"WHEN '{e}' THEN {v}" for e, v in VALENCE.items())
_TP = f"""WITH la AS (SELECT comment_id, list_sum(list_transform(pairs, lambda p: CASE p.emotion {_SIGN} ELSE 0 END * coalesce(p.intensity, 0))) AS nv, len(list_filter(pairs, lambda p: p.emotion = 'fear_anxiety')) AS nf, len(pairs) AS np, annotator FROM lab WHERE len(pairs) > 0),
    tb AS (SELECT id, list_extract(t, 1) AS ticker, {week_sql('CAST(make_timestamp(created_utc * 1000000) AS DATE)')} - 6 AS week FROM (SELECT id, created_utc, {TICK_SQL} AS t FROM c) WHERE len(t) = 1),
    tp AS (SELECT week, ticker, sum(nv) AS net_val, sum(nf)::BIGINT AS n_fear, sum(np)::BIGINT AS n_pairs, count(DISTINCT comment_id) AS n_comments FROM tb JOIN la ON la.comment_id = tb.id GROUP BY 1, 2)"""


def _ticker_panel(s, d):
    lab = B.labels(s, d).select("comment_id", "pairs")
    body = B.comments(s, d).select("id", "body", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_utc") / 86400).cast("int")).alias("day"))
    return P.ticker_panel(lab, body, T.tickers("body", UNIVERSE))


q("agg43_ticker_panel", f"{_TP} SELECT week, ticker, round(net_val, 6) AS net_val, n_fear, n_pairs, n_comments FROM tp", "lab", "c")(lambda s, d: _r6(_ticker_panel(s, d), "net_val"))
q("joi13_labels_in_stream", f"{_TP} SELECT ticker, count(DISTINCT id) AS n FROM tb JOIN la ON la.comment_id = tb.id GROUP BY 1", "lab", "c")(lambda s, d: _ticker_panel(s, d).groupBy("ticker").agg(F.sum("n_comments").alias("n")))
q("agg44_comment_emotion", f"{_TP} SELECT comment_id, annotator, round(nv, 6) AS nv, nf::INT AS nf, np::INT AS np FROM la", "lab", "c")(
    lambda s, d: B.labels(s, d)
    .where("size(pairs) > 0")
    .select("comment_id", "annotator", F.round(F.aggregate("pairs", F.lit(0.0), lambda a, p: a + T.valence(p["emotion"], p["intensity"])), 6).alias("nv"), F.size(F.filter("pairs", lambda p: p["emotion"] == "fear_anxiety")).alias("nf"), F.size("pairs").alias("np"))
)
# cells per priority: a ticker panel with enough rows
_OT = f"ot AS (SELECT ticker, {week_sql('day')} AS week, sum(v) AS net_val, count(*) AS n_pairs FROM (SELECT o_orderdate::DATE AS day, o_orderpriority AS ticker, (o_orderkey % 5 - 2) AS v FROM orders) GROUP BY 1, 2)"
_OM = f"WITH {RETS}, {_OT}, om AS (SELECT o.ticker, o.week, o.net_val::DOUBLE / n_pairs AS x, y FROM ot o JOIN ret r ON r.ticker = o.ticker AND r.week = o.week AND horizon = '1w' WHERE y IS NOT NULL AND n_pairs >= 3 AND o.ticker <> '{GAUGE}')"


def _ot(s, d):
    o = B.table(s, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), T.week_end(F.to_date("o_orderdate")).alias("week")).agg(F.sum(F.col("o_orderkey") % 5 - 2).alias("net_val"), F.count(F.lit(1)).alias("n_pairs"))


def _om(s, d):
    thin = _ot(s, d).where((F.col("n_pairs") >= 3) & (F.col("ticker") != GAUGE)).select("ticker", "week", (F.col("net_val") / F.col("n_pairs")).alias("x"))
    return thin.join(_rets(s, d).where("horizon = '1w'").select("ticker", "week", "y"), ["ticker", "week"])


q("flt09_thin_cells", f"WITH {_OT} SELECT ticker, week, n_pairs FROM ot WHERE n_pairs >= 3 AND ticker <> '{GAUGE}'")(lambda s, d: _ot(s, d).where((F.col("n_pairs") >= 3) & (F.col("ticker") != GAUGE)).select("ticker", "week", "n_pairs"))
q("joi12_ticker_returns", f"{_OM} SELECT ticker, week, round(x, 6) AS x, round(y, 6) AS y FROM om", "px")(lambda s, d: _r6(_om(s, d), "x", "y"))
_WZ = f"{_OM}, qz AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM om), wz AS (SELECT ticker, week, x, least(greatest(y, lo), hi) AS y FROM om, qz)"
q("agg45_winsorised", f"{_WZ} SELECT ticker, week, round(y, 6) AS y FROM wz", "px")(lambda s, d: _r6(P.winsorise(_om(s, d), "y").select("ticker", "week", "y"), "y"))
q("agg46_fixed_effects", f"{_WZ}, dm AS (SELECT x - avg(x) OVER (PARTITION BY ticker) AS x, y - avg(y) OVER (PARTITION BY ticker) AS y FROM wz) SELECT round(regr_slope(y, x), 6) AS beta, count(*) AS n FROM dm", "px")(
    lambda s, d: P.demean(P.winsorise(_om(s, d), "y"), ["x", "y"], "ticker").agg(F.round(F.regr_slope("y", "x"), 6).alias("beta"), F.count(F.lit(1)).alias("n"))
)


def _ot_features(s, d):
    """Ticker-week cells with two features and the winsorised return."""
    o = B.table(s, d, "orders")
    v = F.col("o_orderkey") % 5
    cells = o.groupBy(F.col("o_orderpriority").alias("ticker"), T.week_end(F.to_date("o_orderdate")).alias("week")).agg(F.avg(v - 2).alias("net_val_mean"), F.avg((v == 0).cast("int")).alias("share_low"), F.count(F.lit(1)).alias("n_pairs"))
    kept = cells.where((F.col("n_pairs") >= 3) & (F.col("ticker") != GAUGE))
    return P.winsorise(kept.join(_rets(s, d).where("horizon = '1w' and y is not null").select("ticker", "week", "y"), ["ticker", "week"]), "y")


@PANEL.add("agg46_clustered")
def agg46(s, d):
    """Slopes with effects of tickers, and of weeks too; errors clustered by week."""
    m = _ot_features(s, d)
    out = None
    for feature in ("net_val_mean", "share_low"):
        for effects in ("ticker", "ticker_week"):
            r = FE.fixed_effects(m, feature, "y", "ticker", "week", two_way=effects == "ticker_week").select(F.lit(feature).alias("feature"), F.lit(effects).alias("effects"), "*")
            out = r if out is None else out.unionByName(r)
    return out


q("agg46_ticker_effects", f"""{_WZ}, dm AS (SELECT ticker, week, x - avg(x) OVER (PARTITION BY ticker) AS x, y - avg(y) OVER (PARTITION BY ticker) AS y FROM wz),
    bt AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT ticker) AS u FROM dm),
    sc AS (SELECT week, sum(x * (y - beta * x)) AS g FROM dm, bt GROUP BY 1), gg AS (SELECT sum(g * g) AS gg, count(*) AS k FROM sc)
    SELECT round(beta, 6) AS beta, round(sqrt(gg * k / (k - 1) * (n - 1) / (n - u - 1)) / sxx, 6) AS se, round(beta / (sqrt(gg * k / (k - 1) * (n - 1) / (n - u - 1)) / sxx), 4) AS z, n, k AS n_clusters FROM bt, gg""", "px")(  # fmt: skip
    lambda s, d: FE.fixed_effects(_ot_features(s, d), "net_val_mean", "y", "ticker", "week").select(F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), F.round("z", 4).alias("z"), "n", "n_clusters")
)


SETS = {"s1": ["net_valence"], "s2": ["net_valence", *_E], "s3": ["net_valence", *_E, *_S], "s4": ["net_valence", *_E, *_S, *_C]}


def _ladder(s, d, sets, horizons):
    """Walk-forward ridge per feature set and horizon: one small weekly table per group."""
    panel = _panel(s, d).select("week", *[F.col(c).cast("double").alias(c) for c in SETS["s4"]])
    rets = _rets(s, d).where(F.col("ticker").isin(*BASKET)).groupBy("week", "horizon").agg(F.avg("y").alias("y"))
    j = panel.join(rets.where(F.col("horizon").isin(*horizons)), "week").withColumn("set", F.explode(F.array(*[F.lit(x) for x in sets])))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("week")
        name, h = f["set"].iloc[0], f["horizon"].iloc[0]
        ic, n = S.ridge_walk(f[SETS[name]].to_numpy(float), f["y"].to_numpy(float), HORIZONS[h])
        return pd.DataFrame({"set": [name], "horizon": [h], "ic": [ic], "n": [n]})

    return j.groupBy("set", "horizon").applyInPandas(run, "set string, horizon string, ic double, n long")


PANEL.add("agg47_walk_forward")(lambda s, d: _ladder(s, d, ["s2"], ["1w"]))
PANEL.add("agg48_feature_ladder")(lambda s, d: _ladder(s, d, list(SETS), list(HORIZONS)))
q("win12_training_window", f"WITH {RETS}, w AS (SELECT week, row_number() OVER (ORDER BY week) AS i FROM (SELECT DISTINCT week FROM ret WHERE y IS NOT NULL AND horizon = '1w')) SELECT week, greatest(i - 1, 0) AS n_train FROM w", "px")(
    lambda s, d: _rets(s, d).where("horizon = '1w'").select("week").distinct().select("week", (F.row_number().over(Window.orderBy("week")) - 1).cast("bigint").alias("n_train"))
)
