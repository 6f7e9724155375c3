"""Greedy one-to-one matching of span pairs, and what is scored on top of it.

All of it is column expressions over arrays: the candidates of a row are sorted by score and taken in
order, so nothing is exploded or shuffled to match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def token_lists(pairs: str | Column, field: str = "emotion_span") -> Column:
    """The token array of each pair's span."""
    c = F.col(pairs) if isinstance(pairs, str) else pairs
    return F.transform(c, lambda p: T.tokens(p[field]))


def greedy_match(ta: Column, tb: Column, thr: float = 0.5, *, relaxed: bool = False, lowest_first: bool = False) -> Column:
    """Matches ``array<struct<s, i, j>>`` between two arrays of token arrays.

    Candidates are taken by falling score; of equal scores the greatest i, then j, comes first, or
    with ``lowest_first`` the smallest. Scores below ``thr`` are no candidates. Each side's pair is
    matched once at most.
    """
    score = T.token_containment if relaxed else T.token_iou
    sign = -1 if lowest_first else 1
    cand = F.flatten(F.transform(ta, lambda x, i: F.transform(tb, lambda y, j: F.struct(score(x, y).alias("s"), (sign * i).cast("int").alias("i"), (sign * j).cast("int").alias("j")))))
    cand = F.sort_array(F.filter(cand, lambda c: c["s"] >= thr), asc=False)
    none = F.array().cast("array<struct<s:double,i:int,j:int>>")
    taken = F.aggregate(
        cand,
        none,
        lambda acc, c: F.when(F.exists(acc, lambda m: (m["i"] == c["i"]) | (m["j"] == c["j"])), acc).otherwise(F.concat(acc, F.array(F.struct(c["s"].cast("double").alias("s"), c["i"].alias("i"), c["j"].alias("j"))))),
    )
    return F.transform(taken, lambda m: F.struct(m["s"].alias("s"), (sign * m["i"]).cast("int").alias("i"), (sign * m["j"]).cast("int").alias("j")))


def with_matches(df: DataFrame, a: str = "pa", b: str = "pb", thr: float = 0.5, *, relaxed: bool = False, out: str = "m", lowest_first: bool = False) -> DataFrame:
    """Append the matches of two pair arrays; null arrays match nothing."""
    none = F.array().cast("array<array<string>>")
    tok = df.withColumns({"_ta": F.coalesce(token_lists(a), none), "_tb": F.coalesce(token_lists(b), none)})
    return tok.withColumn(out, greedy_match(F.col("_ta"), F.col("_tb"), thr, relaxed=relaxed, lowest_first=lowest_first)).drop("_ta", "_tb")


def matched_pairs(df: DataFrame, a: str = "pa", b: str = "pb", m: str = "m") -> DataFrame:
    """One row per match, with the two pairs as ``x`` and ``y``."""
    return df.withColumn("_m", F.explode(m)).withColumn("x", F.get(a, F.col("_m.i"))).withColumn("y", F.get(b, F.col("_m.j"))).drop("_m")


def tallies(df: DataFrame, a: str = "pa", b: str = "pb", m: str = "m") -> DataFrame:
    """Per row: pairs on both sides and matches by span, also by emotion, also by cause."""
    x, y = lambda t: F.get(a, t["i"]), lambda t: F.get(b, t["j"])
    typed = F.filter(m, lambda t: x(t)["emotion"] == y(t)["emotion"])
    full = F.filter(typed, lambda t: x(t)["cause_category"] == y(t)["cause_category"])
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return df.withColumns({"n_a": F.greatest(size(F.col(a)), F.lit(0)), "n_b": F.greatest(size(F.col(b)), F.lit(0)), "n_span": F.size(m), "n_typed": F.size(typed), "n_full": F.size(full)})


def micro_f1(tallied: DataFrame, *keys: str) -> DataFrame:
    """Micro F1 in percent of span, typed and full matches; 0 without pairs."""
    total = F.sum(F.col("n_a") + F.col("n_b"))
    f1 = lambda c: F.round(F.coalesce(F.try_divide(200.0 * F.sum(c), total), F.lit(0.0)), 6)
    return tallied.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), f1("n_span").alias("pair_f1"), f1("n_typed").alias("typed_f1"), f1("n_full").alias("full_f1"))


def kappa(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Cohen's kappa of two label columns, per group of ``keys``.

    ``n, po, pe, kappa``; 1 where agreement by chance is certain. Rows with a null label count as
    having the label null. Groups without rows don't appear.
    """
    per = rows.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("c"))
    n = per.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("c")).otherwise(0)).alias("same"))
    ma = per.groupBy(*keys, F.col("_a").alias("_v")).agg(F.sum("c").alias("ca"))
    mb = per.groupBy(*keys, F.col("_b").alias("_v")).agg(F.sum("c").alias("cb"))
    prod = ma.alias("l").join(mb.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_v"]]).select(*[F.col(f"l.{k}").alias(k) for k in keys], (F.col("ca") * F.col("cb")).alias("p"))
    chance = prod.groupBy(*keys).agg(F.sum("p").alias("p"))
    j = n.join(chance, list(keys), "left") if keys else n.crossJoin(chance)
    po = F.try_divide("same", "n")
    pe = F.coalesce(F.try_divide("p", F.col("n") * F.col("n")), F.lit(0.0))
    k = F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))
    return j.where("n > 0").select(*keys, "n", F.round(po, 6).alias("po"), F.round(pe, 6).alias("pe"), F.round(k, 6).alias("kappa"))


def fleiss(counts: DataFrame, cols: list[str]) -> DataFrame:
    """Fleiss' kappa of items with category counts in ``cols``; items with one rating or none are left out.

    Items may have different numbers of ratings; a category's share is that of all ratings."""
    n_i = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    rows = counts.withColumn("_n", n_i).where("_n > 1")
    sq = sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0]))
    tot = rows.agg(F.count(F.lit(1)).alias("items"), F.sum("_n").alias("r"), F.avg((sq - F.col("_n")) / (F.col("_n") * (F.col("_n") - 1))).alias("p_bar"), *[F.sum(c).alias(f"s_{c}") for c in cols])
    share = [F.try_divide(F.col(f"s_{c}"), F.col("r")) for c in cols]
    pe = sum((s * s for s in share[1:]), share[0] * share[0])
    return tot.withColumn("pe", pe).select("items", F.round(F.when(F.col("pe") >= 1, 1.0).otherwise(F.try_divide(F.col("p_bar") - F.col("pe"), 1 - F.col("pe"))), 6).alias("kappa"))


def disagreement(df: DataFrame, m: str = "m") -> Column:
    """Whether two labels differ: in neutrality, in unmatched pairs, or in a matched pair's emotion or cause."""
    x, y = lambda t: F.get("pa", t["i"]), lambda t: F.get("pb", t["j"])
    field = F.exists(m, lambda t: ~(x(t)["emotion"].eqNullSafe(y(t)["emotion"]) & x(t)["cause_category"].eqNullSafe(y(t)["cause_category"])))
    return (F.col("na") != F.col("nb")) | (F.size(m) != F.size("pa")) | (F.size(m) != F.size("pb")) | field
