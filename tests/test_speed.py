"""Long texts and long lists of spans in bounded time: the bounds leave room for slow machines, but none for needless repeats."""

import time

from pyspark.sql import functions as F

from spanloom.functions import codec as C
from spanloom.functions import text as T
from spanloom.operators import validate as V
from spanloom.operators import voting as O
from spanloom.plans import bindings as B
from spanloom.schema import PAIRS
from spanloom.streaming import mock as K


def took(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_normal_form_of_long_texts(spark):
    df = spark.range(400, numPartitions=1).select(F.repeat(F.lit("Rates & prices – "), 600).alias("t"))
    df.select(T.normalize("t")).limit(1).collect()
    assert took(df.select(T.casefold("t").alias("n"))) < 10


def test_class_of_folded_letters():
    import re

    assert [c for c in map(chr, range(0x20000)) if re.match(T._FOLD_CLASS, c)] == list(T._FOLDS)
    assert all(re.match(T._FOLD_RANGE, c) for c in T._FOLDS)


def test_mock_names_the_first_words(spark):
    df = spark.range(60).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("a title of more words than five").alias("title"), F.lit("  one two\tthree four five  six seven").alias("body"))
    pairs = [p for r in df.select(K.parse_output(K.mock_output("id", "title", "body")).alias("p")).collect() for p in r["p"] if p["emotion_span"] != K.BAD_SPAN]
    assert pairs and {(p["emotion_span"], p["cause_span"]) for p in pairs} == {("one two three four five six", "a title of more words")}


def test_items_of_given_comments(spark):
    d = "/root/testdata/sf0.001"
    every = {r["id"]: r for r in B.items(spark, d).collect()}
    some = sorted(every)[::7]
    got = {r["id"]: r for r in B.items(spark, d, spark.createDataFrame([(i,) for i in some] + [("no such id",)], "id string")).collect()}
    assert got == {i: every[i] for i in some}


def test_texts_without_spans_are_left_alone(spark):
    """Texts that no pair has a span to look for in aren't normalised; those of other rows are."""
    pair = ("surprise", "wow", None, None, "unclear", "none", 0.5, False)
    rows = spark.range(100, numPartitions=1).select(F.lit("wow").alias("body"), *[F.repeat(F.lit("A&B &gt; é ß "), 20_000).alias(c) for c in ("parent_body", "post_text")])
    rows = rows.withColumn("pairs", F.array(F.struct(*[F.lit(v).alias(n) for n, v in zip(("emotion", "emotion_span", "cause_span", "cause_source", "cause_category", "target_asset", "intensity", "sarcasm"), pair)])).cast(PAIRS))
    assert took(V.validate(rows).select("valid", "errors", "fixes", "pairs")) < 10
    named = V.validate(rows.limit(1).withColumn("pairs", F.transform("pairs", lambda p: p.withField("cause_span", F.lit("a&b > É")).withField("cause_source", F.lit("comment")).withField("cause_category", F.lit("other"))))).first()
    assert named["valid"] and named["fixes"] == 1 and named["pairs"][0]["cause_source"] == "parent"


def test_first_object_counts_no_braces_of_a_whole_object():
    text = '{"pairs": [], "x": "' + "{" * 3_000_000 + '"}'
    began = time.process_time()
    assert C.first_object(text) == text and C.first_object(f"so: {{}} {text}") == "{}"
    assert C.first_object('x {"a": "}"} y') == '{"a": "}"}' and C.first_object("{cut") is None and C.first_object(None) is None
    assert time.process_time() - began < 0.5


def test_medoid_of_many_spans(spark):
    spans = [f"span {i % 7} of {i} long &amp; longer words" for i in range(60)]
    df = spark.range(1).select(F.array(*[F.lit(x) for x in spans]).alias("s"), "id").withColumn("s", F.transform("s", lambda x: F.concat(x, F.lit(" "), F.col("id").cast("string"))))
    assert took(df.select(O.medoid(F.col("s")).alias("m"))) < 10
    toks = [set(f"{x} 0".replace("&amp;", "&").split()) for x in spans]
    sums = [sum(len(a & b) / len(a | b) for j, b in enumerate(toks) if i != j) for i, a in enumerate(toks)]
    row = df.select(O.medoid(F.col("s")).alias("m"), O.overlaps(F.transform("s", lambda x: T.tokens(x))).alias("o")).first()
    assert max(abs(x - y) for x, y in zip(row["o"], sums)) < 1e-9 and sums[spans.index(row["m"][:-2])] >= max(sums) - 1e-9
