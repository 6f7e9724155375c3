"""Rules for labels: the scheme's fields and values, and spans copied verbatim from their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import ASSETS, CAUSES, EMOTIONS, MAX_PAIRS, SOURCES


def _at(i: Column, text: str) -> Column:
    return F.concat(F.lit("pairs["), i.cast("string"), F.lit(f"].{text}"))


def scheme_errors(pairs: Column) -> Column:
    """Messages for each broken rule of the scheme; null pairs break the one that pairs must be there."""

    def one(p: Column, i: Column) -> Column:
        no_span = p["cause_span"].isNull()
        bad = lambda c, vals: c.isNull() | ~c.isin(*vals)
        rules = [
            (bad(p["emotion"], EMOTIONS), "emotion: not in the list"),
            (F.coalesce(p["emotion_span"], F.lit("")) == "", "emotion_span: empty"),
            (F.coalesce(p["cause_span"] == "", F.lit(False)), "cause_span: empty"),
            (p["cause_source"].isNotNull() & ~p["cause_source"].isin(*SOURCES), "cause_source: not in the list"),
            (bad(p["cause_category"], CAUSES), "cause_category: not in the list"),
            (bad(p["target_asset"], ASSETS), "target_asset: not in the list"),
            (p["intensity"].isNull() | ~p["intensity"].between(0, 1), "intensity: not within 0 and 1"),
            (p["sarcasm"].isNull(), "sarcasm: missing"),
            (no_span & ~(p["cause_category"].eqNullSafe(F.lit("unclear")) & p["cause_source"].isNull()), "cause: no span, but a category or source"),
            (~no_span & (p["cause_category"].eqNullSafe(F.lit("unclear")) | p["cause_source"].isNull()), "cause: a span, but no category or source"),
        ]
        return F.array_compact(F.array(*[F.when(cond, _at(i, msg)) for cond, msg in rules]))

    per = F.flatten(F.transform(pairs, one))
    many = F.when(F.size(pairs) > MAX_PAIRS, F.array(F.lit("pairs: too many"))).otherwise(F.array().cast("array<string>"))
    return F.when(pairs.isNull(), F.array(F.lit("pairs: missing"))).otherwise(F.concat(many, per))


def validate(df: DataFrame, pairs: str = "pairs", comment: str = "body", parent: str = "parent_body", post: str = "post_text", *, drop_invalid: bool = False) -> DataFrame:
    """Append ``errors``, ``fixes`` and ``valid``; correct wrong cause sources in ``pairs``.

    The source of a cause span is derived from the texts; a stated source that differs is replaced
    and counted, which is no error. Spans in no text are errors; such pairs stay unless
    ``drop_invalid``. Null texts hold no span.
    """
    p0 = F.col(pairs)
    # a row's texts are normalised once, not once per pair, and only where a pair has a span to look for in them
    texts = {"_comment": comment, "_parent": parent, "_post": post}
    caused = F.exists(p0, lambda p: F.coalesce(p["cause_span"], F.lit("")) != "")
    df = df.withColumns({k: F.when(F.size(p0) > 0 if k == "_comment" else caused, T.normalize(v)) for k, v in texts.items()})
    holds = lambda norm, span, folded: (F.coalesce(F.col(texts[norm]), F.lit("")) != "") & (F.coalesce(span, F.lit("")) != "") & F.contains(F.col(norm), folded)
    source = lambda x: F.when(holds("_comment", x["c"], x["nc"]), "comment").when(holds("_parent", x["c"], x["nc"]), "parent").when(holds("_post", x["c"], x["nc"]), "post")
    spans = F.transform(p0, lambda p: F.struct(p["emotion_span"].alias("e"), T.normalize(p["emotion_span"]).alias("ne"), p["cause_span"].alias("c"), T.normalize(p["cause_span"]).alias("nc")))
    df = df.withColumn("_found", F.transform(spans, lambda x: F.struct(source(x).alias("src"), (holds("_comment", x["e"], x["ne"]) | x["e"].isNull()).alias("ok"))))
    src, ok = lambda i: F.get("_found", i)["src"], lambda i: F.get("_found", i)["ok"]
    span = lambda p, i: F.array_compact(
        F.array(
            F.when(~ok(i), _at(i, "emotion_span: not in the comment")),
            F.when(p["cause_span"].isNotNull() & src(i).isNull(), _at(i, "cause_span: in no source")),
        )
    )
    errors = F.concat(scheme_errors(p0), F.coalesce(F.flatten(F.transform(p0, span)), F.array().cast("array<string>")))
    wrong = lambda p, i: p["cause_span"].isNotNull() & src(i).isNotNull() & ~p["cause_source"].eqNullSafe(src(i))
    fixes = F.aggregate(F.coalesce(F.transform(p0, lambda p, i: wrong(p, i).cast("int")), F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)
    fixed = F.transform(p0, lambda p, i: p.withField("cause_source", F.when(wrong(p, i), src(i)).otherwise(p["cause_source"])))
    out = df.withColumns({"errors": errors, "fixes": fixes}).withColumn("valid", F.size("errors") == 0)
    if drop_invalid:
        fixed = F.filter(fixed, lambda p, i: ok(i) & (p["cause_span"].isNull() | src(i).isNotNull()))
    return out.withColumn(pairs, fixed).drop("_found", *texts)


def repaired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Labels after one repair turn: a second try wins only if it is valid; costs and fixes add up.

    Both have ``comment_id, pairs, errors, fixes, valid, cost``.
    """
    s = second.where("valid").select(F.col("comment_id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in ("pairs", "errors", "fixes", "cost")])
    j = first.join(s, (F.col("comment_id") == F.col("r_id")) & ~F.col("valid"), "left")
    won = F.col("r_id").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("comment_id", F.when(won, F.col("r_pairs")).otherwise(F.col("pairs")).alias("pairs"), F.when(won, F.col("r_errors")).otherwise(F.col("errors")).alias("errors"), (F.col("fixes") + zero("r_fixes")).alias("fixes"), (F.col("valid") | won).alias("valid"), won.alias("repaired"), F.when(won, zero("cost") + zero("r_cost")).otherwise(F.col("cost")).alias("cost"))
