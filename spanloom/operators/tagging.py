"""Token tags and training examples from located spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_tokens(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys, i, a, b``: the words of a text with their character ranges."""
    words = F.split(F.col(text), " ")
    ends = F.transform(words, lambda w, i: F.aggregate(F.slice(words, 1, i + 1), F.lit(0), lambda acc, x: acc + F.length(x) + 1) - 1)
    z = df.select(*keys, F.posexplode(F.arrays_zip(words.alias("w"), ends.alias("e"))).alias("i", "t"))
    return z.select(*keys, "i", (F.col("t.e") - F.length("t.w")).alias("a"), F.col("t.e").alias("b"))


def bio_tags(tokens: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """``keys, i, tag, value``: B on the first token that a span overlaps, I on its others, O elsewhere.

    spans: ``keys, k, s, e, label, value``; of spans that overlap a token, the last (greatest ``k``) wins.
    The value stands on B only. Empty tokens have no tag.
    """
    t = tokens.where("a < b")
    on = [F.col(f"t.{x}") == F.col(f"s.{x}") for x in keys]
    hit = t.alias("t").join(spans.alias("s"), [*on, F.col("t.a") < F.col("s.e"), F.col("t.b") > F.col("s.s")]).select(*[F.col(f"t.{x}").alias(x) for x in keys], "t.i", "s.k", "s.label", "s.value")
    hit = hit.withColumn("first", F.min("i").over(Window.partitionBy(*keys, "k")))
    tag = F.concat(F.when(F.col("i") == F.col("first"), "B-").otherwise("I-"), "label")
    last = hit.withColumn("tag", tag).groupBy(*keys, "i").agg(F.max_by("tag", "k").alias("tag"), F.max_by(F.when(F.col("i") == F.col("first"), F.col("value")), F.col("k")).alias("value"))
    return t.select(*keys, "i").join(last, [*keys, "i"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def tag_runs(tokens: DataFrame, *keys: str) -> DataFrame:
    """Maximal runs of tokens of one category: ``keys, run, category, s, e, n, mean_p``.

    tokens: ``keys, i, a, b, category, p``; a null category or an empty token ends a run.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    c = F.when(F.col("a") < F.col("b"), F.col("category"))
    t = tokens.withColumn("c", c).withColumn("brk", (~F.col("c").eqNullSafe(F.lag("c").over(w)) | (F.col("i") == F.min("i").over(Window.partitionBy(*keys)))).cast("int"))
    t = t.withColumn("run", F.sum("brk").over(w)).where("c is not null")
    return t.groupBy(*keys, "run").agg(F.first("c").alias("category"), F.min("a").alias("s"), F.max("b").alias("e"), F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"))


def nearest(spans: Column, s: Column, e: Column) -> Column:
    """The struct of ``spans`` (fields s, e) with the least gap to [s, e); the first of equals."""
    scored = F.transform(spans, lambda x, i: F.struct(F.greatest(F.lit(0), x["s"] - e, s - x["e"]).alias("g"), i.alias("i"), x.alias("x")))
    return F.array_min(scored)["x"]
