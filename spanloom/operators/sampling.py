"""Seeded stratified samples: hash order, quotas, splits and the first-fit scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.scratch import Scratch

# Fixed values of the reproducible order.
MULTIPLIER, MODULUS = 2654435761, 2147483647
YEAR_SECONDS = 31556952


def hash_order(pos: str | Column, seed: int) -> Column:
    """The reproducible pseudo-random order of row positions (not negative), reduced first so it can't overflow."""
    p = F.col(pos) if isinstance(pos, str) else pos
    return ((p % F.lit(MODULUS)) * F.lit(MULTIPLIER % MODULUS) + F.lit(seed)) % F.lit(MODULUS)


def approx_year(ts: str = "created_utc") -> Column:
    """Year by mean year length, as volumes are counted; differs from the calendar near New Year."""
    return F.floor(F.col(ts) / F.lit(YEAR_SECONDS)).cast("int") + 1970


def calendar_year(ts: str = "created_utc") -> Column:
    return F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts) / 86400).cast("int")))


def year_quotas(volumes: DataFrame, n: int, floor: int) -> DataFrame:
    """``year, quota``: shares of ``n`` by volume ``v``, not below ``floor``, scaled back once; may exceed n."""
    whole = Window.partitionBy(F.lit(1))
    first = F.greatest(F.lit(floor), F.bround(F.lit(float(n)) * F.col("v") / F.sum("v").over(whole)).cast("int"))
    q = volumes.withColumn("q", first)
    return q.withColumn("quota", F.greatest(F.lit(floor), F.bround(F.col("q") * (F.lit(float(n)) / F.sum("q").over(whole))).cast("int"))).select("year", "v", "quota")


def priority_strata(strata: Sequence[tuple[str, DataFrame, int]], order: Column) -> DataFrame:
    """``id, stratum``: the first ``2 * quota`` rows of each stratum in order, without ids that an
    earlier stratum took, cut to its quota."""
    fetched = None
    for k, (_, rows, quota) in enumerate(strata):
        part = rows.select("id", order.alias("h"), F.lit(k).alias("k")).orderBy("h", "id").limit(2 * quota)
        fetched = part if fetched is None else fetched.unionByName(part)
    # the strata's rows are read once; what is left to do is on twice the quotas
    fetched = Scratch(fetched.sparkSession, "strata").table(fetched, "fetched")
    picked = None
    for k, (name, _, quota) in enumerate(strata):
        own = fetched.where(F.col("k") == k)
        if picked is not None:
            own = own.join(picked.select(F.col("id").alias("seen")), F.col("id") == F.col("seen"), "left_anti")
        part = own.orderBy("h", "id").limit(quota).select("id", F.lit(name).alias("stratum"))
        picked = part if picked is None else picked.unionByName(part)
    return picked


def seeded(key: str, seed: int) -> Column:
    """A seeded order of keys that any engine can repeat."""
    return F.md5(F.concat(F.col(key), F.lit(f":{seed}")))


def quota_sample(df: DataFrame, by: Sequence[str], quota: Column, key: str, seed: int) -> DataFrame:
    """The first ``quota`` rows of each group in seeded hash order."""
    w = Window.partitionBy(*by).orderBy(seeded(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r")


def stratified_dev(df: DataFrame, stratum: str, key: str, dev: int, seed: int) -> DataFrame:
    """``df`` with ``split``: dev gets its rounded share of every stratum, chosen by seeded hash."""
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    q = n.crossJoin(F.broadcast(total)).select(F.col(stratum).alias("_s"), F.bround(F.lit(float(dev)) * F.col("_n") / F.col("_t")).cast("int").alias("_q"))
    w = Window.partitionBy(stratum).orderBy(seeded(key, seed), key)
    j = df.withColumn("_r", F.row_number().over(w)).join(q, F.col(stratum).eqNullSafe(F.col("_s")))
    return j.withColumn("split", F.when(F.col("_r") <= F.col("_q"), "dev").otherwise("train")).drop("_r", "_s", "_q")


def first_fit(rows: DataFrame, caps: DataFrame, needs: dict[str, int]) -> DataFrame:
    """First-fit scan in order ``h, id``, without a scan: ``id, stratum, bucket, year``.

    rows: ``id, h, opts`` - the options of each row in its order of preference, as
    ``struct<stratum, bucket, year>``. caps: ``stratum, bucket, year, cap, bucket_cap`` - places per
    bucket and year, and per bucket. ``needs``: places per stratum. A scan would give each row, in
    order, its first option with free places on all three levels. The places nest, and all rank
    rows alike, so deferred acceptance gives the same result: every row proposes to its first
    option, each level holds the first rows in order up to its places, and refused rows go on to
    their next option until none is refused.
    """
    scratch = Scratch(rows.sparkSession, "first-fit")
    state = scratch.table(rows.where(F.size("opts") > 0).select("id", "h", "opts", F.lit(0).alias("k")), "state")
    caps = scratch.table(caps, "caps")
    need = F.create_map(*[F.lit(x) for kv in needs.items() for x in kv])
    top = max(needs.values(), default=0)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))
    while True:
        at = state.withColumn("o", F.get("opts", F.col("k"))).select("*", "o.stratum", "o.bucket", "o.year")
        held = at.withColumn("r1", rank("stratum", "bucket", "year")).where(F.col("r1") <= top)
        held = held.join(caps, ["stratum", "bucket", "year"]).where(F.col("r1") <= F.col("cap"))
        held = held.withColumn("r2", rank("stratum", "bucket")).where((F.col("r2") <= top) & (F.col("r2") <= F.col("bucket_cap")))
        held = held.withColumn("r3", rank("stratum")).where((F.col("r3") <= top) & (F.col("r3") <= need[F.col("stratum")]))
        held = scratch.table(held.select(F.col("id").alias("h_id"), F.col("stratum").alias("h_stratum"), F.col("bucket").alias("h_bucket"), F.col("year").alias("h_year")), "held")
        nxt = state.join(held, F.col("id") == F.col("h_id"), "left").withColumn("k", F.col("k") + F.col("h_id").isNull().cast("int"))
        new, n = scratch.counted(nxt.where(F.col("k") < F.size("opts")).select("id", "h", "opts", "k", F.col("h_id").isNull().alias("moved")), "state")
        if n == 0 or not new.where("moved").limit(1).count():
            return held.select(F.col("h_id").alias("id"), F.col("h_stratum").alias("stratum"), F.col("h_bucket").alias("bucket"), F.col("h_year").alias("year"))
        scratch.drop(state)
        state = new.drop("moved")
        state._spanloom_path = new._spanloom_path


def scan_options(comments: DataFrame, seed: int) -> DataFrame:
    """``id, h, opts`` of comments fit for labelling: random, then its topics, then emotive."""
    y = calendar_year()
    opt = lambda s, b: F.struct(F.lit(s).alias("stratum"), b.alias("bucket"), F.col("y").alias("year"))
    c = comments.withColumn("y", y).where("y is not null")
    topics = F.transform(T.topics("body"), lambda t: F.struct(F.lit("topic").alias("stratum"), t.alias("bucket"), F.col("y").alias("year")))
    emo = F.when(T.emotive_score("body") >= 2, F.array(opt("emotive", F.lit("")))).otherwise(F.array().cast("array<struct<stratum:string,bucket:string,year:int>>"))
    return c.select("id", hash_order("pos", seed).alias("h"), F.concat(F.array(opt("random", F.lit(""))), topics, emo).alias("opts"))
