import random

from pyspark.sql import functions as F

from spanloom.operators import sampling as S


def test_first_fit_equals_a_sequential_scan(spark):
    rng = random.Random(5)
    for trial in range(3):
        rows = []
        for i in range(300):
            y = rng.choice([2020, 2021])
            opts = [("random", "", y)] + [("topic", t, y) for t in sorted(rng.sample("pqr", rng.randint(0, 3)))] + ([("emotive", "", y)] if rng.random() < 0.4 else [])
            rows.append((f"i{i}", rng.randrange(100), opts))  # hash ties
        caps = {("random", "", y): rng.randint(5, 20) for y in (2020, 2021)} | {("topic", t, y): rng.randint(3, 12) for t in "pqr" for y in (2020, 2021)} | {("emotive", "", y): rng.randint(3, 9) for y in (2020, 2021)}
        bucket = {("random", ""): 100, ("topic", "p"): 11, ("topic", "q"): 9, ("topic", "r"): 14, ("emotive", ""): 100}
        needs = {"random": 25, "topic": 28, "emotive": 10}
        used, want = {}, {}
        for i, h, opts in sorted(rows, key=lambda r: (r[1], r[0])):
            for o in opts:
                keys = [o, o[:2], o[0]]
                if used.get(keys[0], 0) < caps[o] and used.get(keys[1], 0) < bucket[o[:2]] and used.get(keys[2], 0) < needs[o[0]]:
                    for k in keys:
                        used[k] = used.get(k, 0) + 1
                    want[i] = o
                    break
        df = spark.createDataFrame(rows, "id string, h int, opts array<struct<stratum:string,bucket:string,year:int>>")
        cdf = spark.createDataFrame([(*k, v, bucket[k[:2]]) for k, v in caps.items()], "stratum string, bucket string, year int, cap int, bucket_cap int")
        got = {r["id"]: (r["stratum"], r["bucket"], r["year"]) for r in S.first_fit(df, cdf, needs).collect()}
        assert got == want


def test_two_year_formulas_differ_near_new_year(spark):
    ts = [1609459200 - 7200, 1609459200 + 7200, 1704067200 - 50000, 1704067200 + 50000]
    df = spark.createDataFrame([(t,) for t in ts], "created_utc bigint")
    got = [tuple(r) for r in df.select(S.approx_year(), S.calendar_year()).collect()]
    assert [g[1] for g in got] == [2020, 2021, 2023, 2024]
    assert any(a != b for a, b in got)


def test_hash_order_does_not_overflow(spark):
    df = spark.createDataFrame([(2**31 - 1,), (0,), (12345678901,)], "pos bigint")
    got = [r[0] for r in df.select(S.hash_order("pos", 7)).collect()]
    assert got == [((p * 2654435761) + 7) % 2147483647 for p in (2**31 - 1, 0, 12345678901)]


def test_strata_share_no_id(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.col("id").alias("pos"))
    got = S.priority_strata([("a", df, 10), ("b", df, 10), ("c", df, 5)], S.hash_order("pos", 7)).collect()
    assert len({r["id"] for r in got}) == len(got) and sum(r["stratum"] == "a" for r in got) == 10
