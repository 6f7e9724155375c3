from pyspark.sql import functions as F

from spanloom.operators.skew import heavy_keys, keyed_aggregate, keyed_top, skew_join


def _data(spark):
    # one key with a third of all rows, nulls, many small keys
    return spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"), "id", (F.col("id") % 7).alias("v"), F.lit("x").alias("is_heavy_"))


def test_heavy_keys_are_found_and_bounded(spark):
    assert heavy_keys(_data(spark), "k") == ["hot"]
    assert heavy_keys(_data(spark).limit(0), "k") == []
    assert heavy_keys(spark.range(5).select(F.lit(None).cast("string").alias("k")), "k") == []


def test_aggregate_matches_plain_group_by(spark):
    df = _data(spark)
    got = keyed_aggregate(df, "k", {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, salt_on=["id"])
    want = df.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert sorted(map(tuple, got.select("k", "n", "s").collect())) == sorted(map(tuple, want.collect()))
    assert [r["k"] for r in got.where("is_heavy").collect()] == ["hot"]
    assert keyed_aggregate(df.limit(0), "k", {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, salt_on=["id"]).count() == 0


def test_top_with_ties(spark):
    df = _data(spark)
    got = {(r["k"], r["rank"]): r["id"] for r in keyed_top(df, "k", [F.desc("v"), F.col("id")], 3, salt_on=["id"]).collect()}
    rows = [r for r in df.collect() if r["k"]]
    for k in {r["k"] for r in rows}:
        best = sorted((r for r in rows if r["k"] == k), key=lambda r: (-r["v"], r["id"]))[:3]
        assert [got[k, i + 1] for i in range(len(best))] == [r["id"] for r in best]


def test_skew_join_all_ways(spark):
    left = _data(spark).select("k", "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "rk string, x int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = skew_join(left, right, "k", "rk", ["hot"], how)
        b = left.join(right, left.k == right.rk, how)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
