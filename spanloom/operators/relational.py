"""Filters and joins of the labelling pipeline as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import PAIR_FIELDS

GONE = ("[removed]", "[deleted]")
MODS = "[contact the mods]("


def hygiene(body: str = "body", author: str = "author", *, like_sql: bool) -> Column:
    """Texts fit for labelling. ``like_sql`` compares the rule and moderator marks in any ASCII case,
    as SQL's LIKE does in an embedded database; otherwise their case counts. Nulls are unfit."""
    b, a = F.col(body), F.col(author)
    rule = b.ilike("Rule %") | b.ilike(f"%{MODS}%") if like_sql else b.startswith("Rule ") | F.contains(b, F.lit(MODS))
    ok = F.length(b).between(60, 1500) & ~b.isin(*GONE) & ~a.isin("AutoModerator", "[deleted]") & ~F.lower(a).endswith("bot") & ~rule
    return F.coalesce(ok, F.lit(False))


def is_dead(body: str = "body") -> Column:
    return F.col(body).isNull() | F.col(body).isin("", *GONE)


def cap_texts(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Texts cut to so many characters; nulls stay."""
    return df.withColumns({c: F.left(F.col(c), F.lit(n)) for c, n in limits.items()})


def clean_pairs(pairs: str | Column) -> Column:
    """Pairs with exactly the scheme's fields, in order."""
    c = F.col(pairs) if isinstance(pairs, str) else pairs
    return F.transform(c, lambda p: F.struct(*[p[f].alias(f) for f in PAIR_FIELDS]))


def keep_included(pairs: Column, included: str = "included") -> Column:
    """If any pair says whether it is included, only those that are; else all."""
    return F.when(F.exists(pairs, lambda p: p[included].isNotNull()), F.filter(pairs, lambda p: F.coalesce(p[included], F.lit(False)))).otherwise(pairs)


def keep_supported(pairs: Column, least: int | None) -> Column:
    """Pairs that are included or, given ``least``, have that support."""
    if least is None:
        return F.filter(pairs, lambda p: F.coalesce(p["included"], F.lit(False)))
    return F.filter(pairs, lambda p: F.coalesce(p["support"], F.lit(0)) >= least)


def sarcasm_treatments(pairs: DataFrame) -> DataFrame:
    """The pair rows under each treatment: as they are, without sarcastic ones, with their valence reversed."""
    s = F.coalesce(F.col("sarcasm"), F.lit(False))
    names = F.when(s, F.array(F.lit("baseline"), F.lit("flip"))).otherwise(F.array(F.lit("baseline"), F.lit("drop"), F.lit("flip")))
    out = pairs.withColumn("treatment", F.explode(names))
    return out.withColumn("valence", F.when((F.col("treatment") == "flip") & s, -F.col("valence")).otherwise(F.col("valence")))


def on_link_posts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments that answer a link post directly."""
    p = posts.where("is_self = 0").select(F.col("id").alias("post_id"))
    c = comments.where(F.col("parent_id").startswith("t3_"))
    return c.join(p, F.substring("link_id", 4, 1_000_000) == F.col("post_id"), "left_semi")


def addressing_replies(comments: DataFrame) -> DataFrame:
    """Replies to a present comment that address somebody."""
    parents = comments.select(F.col("id").alias("par_id"))
    c = comments.where(F.col("parent_id").startswith("t1_") & F.contains(F.concat(F.lit(" "), F.lower("body"), F.lit(" ")), F.lit(" you ")))
    return c.join(parents, F.substring("parent_id", 4, 1_000_000) == F.col("par_id"), "left_semi")


def leaked(kept: DataFrame, excluded: DataFrame, key: str = "comment_id") -> DataFrame:
    """``n_leaked``: the distinct ids that are kept although they are excluded."""
    return kept.select(key).intersect(excluded.select(key)).agg(F.count(F.lit(1)).alias("n_leaked"))


def checksum_status(manifest: DataFrame, local: DataFrame, fields: tuple[str, ...] = ("comment", "parent", "post")) -> DataFrame:
    """Each manifest row's status against local texts: unavailable, mismatch or ok. Two nulls are equal."""
    mine = local.select(F.col("comment_id").alias("l_id"), *[T.sha(f"{f}_text").alias(f"l_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"sha256_{f}").eqNullSafe(F.col(f"l_{f}"))
    j = manifest.join(mine, F.col("comment_id") == F.col("l_id"), "left")
    return j.withColumn("status", F.when(F.col("l_id").isNull(), "unavailable").when(same, "ok").otherwise("mismatch")).drop("l_id", *[f"l_{f}" for f in fields])


def range_label(day: Column, ranges: list[tuple[str, str, str]]) -> Column:
    """The first range (name, first day, last day) that holds a day; null if none does."""
    out = F.lit(None).cast("string")
    for name, a, b in reversed(ranges):
        out = F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(out)
    return out
