"""Current rows and first captures of archive tables that hold several captures of an id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link_key(col: str | Column) -> Column:
    """``link_id`` with blanks trimmed and the kind prefix removed; null where nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.trim(c)
    return F.nullif(F.when(t.startswith("t3_"), F.substring(t, 4, 1_000_000)).otherwise(t), F.lit(""))


def parent_ref(col: str | Column) -> Column:
    """``parent_id`` with blanks trimmed; null where nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.trim(c), F.lit(""))


def author_key(col: str | Column) -> Column:
    """Trimmed lower-case author; null for nobody (null, empty, ``[deleted]``)."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.lower(F.trim(c))
    return F.when(~t.isin("", "[deleted]"), t)


def month_of(epoch: str | Column) -> Column:
    """``yyyy-MM`` of epoch seconds in UTC, independent of the session's time zone; null stays null."""
    c = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / 86400).cast("int")), "yyyy-MM")


def current_rows(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """One row per id: ``fields`` of the current row (greatest ``retrieved_on``) and ``first_seen``.

    ``fields`` must not use the names ``id`` and ``first_seen``. Rows with a null id name no record
    and are left out. A null ``retrieved_on`` counts as older than any other. Rows that tie are
    expected to be identical; if they are not, the greatest values win, so the result is still
    deterministic. The aggregation combines on the map side, so a record with very many captures
    costs no single task more than its own distinct partials.
    """
    rows = df.where(F.col("id").isNotNull()).select(F.col("id"), F.col("retrieved_on").alias("_r"), *[c.alias(n) for n, c in fields.items()])
    best = F.max(F.struct(F.coalesce(F.col("_r"), F.lit(-(2**62))).alias("_r"), *[F.col(n) for n in fields]))
    g = rows.groupBy("id").agg(best.alias("_b"), F.min("_r").alias("first_seen"))
    return g.select("id", *[F.col(f"_b.{n}").alias(n) for n in fields], "first_seen")
