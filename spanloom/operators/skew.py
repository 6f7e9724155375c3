"""Per-key processing without the imbalance of a few dominant keys (problem 2).

Heavy keys are found with a frequent-items sketch (``approx_top_k``), which is bounded by the
requested share: at most ``1 / share`` keys can hold ``share`` of the rows, so the list of heavy
keys is small at any input size and may be broadcast. Heavy rows go through a broadcast join and
salted partial results, the other rows through one ordinary shuffle, and both are united.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of all rows from which a key counts as heavy for physical planning.
HEAVY_SHARE = 0.02
#: Counters of the sketch per key of the result; the estimate's error is below share / 8.
TRACK_FACTOR = 64


def sketch(col: str, share: float = HEAVY_SHARE) -> Column:
    """Aggregate: the most frequent non-null values of ``col`` with estimated counts."""
    k = math.ceil(1 / share) * 2
    return F.expr(f"approx_top_k({col}, {min(k, 2000)}, {min(1_000_000, max(1024, k * TRACK_FACTOR))})")


def heavy_keys(df: DataFrame, col: str, share: float = HEAVY_SHARE, slack: float = 0.75) -> list:
    """Keys that may hold ``share`` of the rows of ``df``: a superset, of at most 1/(share*slack) keys.

    Null keys are never heavy. An empty table has no heavy keys.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), sketch(col, share).alias("top")).first()
    return pick_heavy(row["n"], row["top"], share, slack)


def pick_heavy(n: int, top, share: float = HEAVY_SHARE, slack: float = 0.75) -> list:
    """The heavy keys of a finished sketch over ``n`` rows."""
    return [r["item"] for r in (top or []) if r["item"] is not None and r["count"] >= max(2, share * slack * n)]


def skew_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, heavy: Sequence, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, whose ``right_key`` is unique, in two ways by the left key.

    Rows of heavy keys meet a broadcast of those keys' right rows: ``len(heavy)`` rows at most, as
    the right key is unique. All other rows are joined by an ordinary shuffle.
    ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``; null keys match nothing.
    """
    cond = left[left_key] == right[right_key]
    if not heavy:
        return left.join(right, cond, how)
    hot = left[left_key].isin(list(heavy))
    hot_left = left.where(hot)
    cold_left = left.where(left[left_key].isNull() | ~hot)
    hot_right = F.broadcast(right.where(right[right_key].isin(list(heavy))))
    cold_right = right.where(~right[right_key].isin(list(heavy)))
    return hot_left.join(hot_right, hot_left[left_key] == hot_right[right_key], how).unionByName(
        cold_left.join(cold_right, cold_left[left_key] == cold_right[right_key], how)
    )


def split_join(left: DataFrame, right: DataFrame, on: str, hot: Sequence, *, salt_on: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join on column ``on`` where neither side is unique: rows of heavy keys are spread over ``salts`` tasks.

    The left rows of a heavy key get a salt from ``salt_on``, its right rows are repeated for every
    salt. Null keys match nothing.
    """
    if not hot:
        return left.join(right, on)
    is_hot = F.col(on).isin(list(hot))
    one = left.withColumn("_salt", F.when(is_hot, salted(salts, *salt_on)).otherwise(0))
    other = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return one.join(other, [on, "_salt"]).drop("_salt")


def salted(n: int, *cols: str) -> Column:
    """A deterministic salt in [0, n) from the row's own content, the same in every task attempt."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(n)).cast("int")


def keyed_aggregate(
    df: DataFrame,
    key: str,
    partial: dict[str, Column],
    final: dict[str, Column],
    *,
    salt_on: Sequence[str],
    share: float = HEAVY_SHARE,
    salts: int = 64,
    heavy: Sequence | None = None,
) -> DataFrame:
    """Aggregate per key; heavy keys in two salted steps, the rest in one shuffle, then united.

    ``partial`` and ``final`` name the same outputs; ``final`` aggregates the partial columns. Rows
    with a null key form no group. The result has columns key, ``is_heavy`` and those outputs.
    """
    heavy = heavy_keys(df, key, share) if heavy is None else list(heavy)
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull())
    combine = [c.alias(n) for n, c in final.items()]
    first = [c.alias(n) for n, c in partial.items()]
    light = rows
    parts = []
    if heavy:
        keys = F.broadcast(spark.createDataFrame([(k,) for k in heavy], rows.select(key).schema))
        light = rows.join(keys, key, "left_anti")
        parts.append(
            rows.join(keys, key, "inner")
            .groupBy(key, salted(salts, *salt_on).alias("_salt"))
            .agg(*first)
            .groupBy(key)
            .agg(*combine)
            .withColumn("is_heavy", F.lit(True))
        )
    out = light.groupBy(key).agg(*first).groupBy(key).agg(*combine).withColumn("is_heavy", F.lit(False))
    for p in parts:
        out = p.unionByName(out)
    return out.select(key, "is_heavy", *final)


def keyed_top(df: DataFrame, key: str, order: Sequence[Column], k: int, *, salt_on: Sequence[str], share: float = HEAVY_SHARE, salts: int = 64, heavy: Sequence | None = None) -> DataFrame:
    """The ``k`` first rows of each key in ``order`` (make it total), with their ``rank``.

    Heavy keys are ranked within salted groups first, so no task sorts a whole heavy key; at most
    ``salts * k`` rows of it remain for the second ranking.
    """
    heavy = heavy_keys(df, key, share) if heavy is None else list(heavy)
    rows = df.where(F.col(key).isNotNull())
    if heavy:
        hot = F.col(key).isin(list(heavy))
        w = Window.partitionBy(key, "_salt").orderBy(*order)
        hot_rows = rows.where(hot).withColumn("_salt", salted(salts, *salt_on)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "_salt")
        rows = rows.where(~hot).unionByName(hot_rows)
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
