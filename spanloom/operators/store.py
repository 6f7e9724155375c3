"""Requests that change stored labels: validation first, then keyed upserts and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.jsonl import latest, numbered
from .validate import validate

VERDICTS = ("A", "B", "NEUTRAL", "CUSTOM")


def _none(df: DataFrame, pairs: str):
    return F.array().cast(df.schema[pairs].dataType)


def judge_labels(requests: DataFrame, items: DataFrame, annotators: list[str]) -> DataFrame:
    """``requests`` with ``errors`` and ``accepted``; pairs come with their sources corrected.

    requests: ``comment_id, annotator, neutral, pairs, updated_at``; items: ``id, body, parent_body,
    post_text``. A neutral label has no pairs, whatever was sent; another one needs a pair, and all its
    pairs must be valid. Unknown comments and annotators are refused. A null ``neutral`` is false.
    """
    neutral = F.coalesce("neutral", F.lit(False))
    sent = requests.withColumn("neutral", neutral).withColumn("pairs", F.when(neutral, _none(requests, "pairs")).otherwise(F.coalesce("pairs", _none(requests, "pairs"))))
    v = validate(sent.join(items, F.col("comment_id") == F.col("id"), "left"))
    more = F.array_compact(
        F.array(
            F.when(F.col("id").isNull(), "comment: unknown"),
            F.when(~F.coalesce(F.col("annotator").isin(annotators), F.lit(False)), "annotator: unknown"),
            F.when(~F.col("neutral") & (F.size("pairs") == 0), "pairs: none, and not neutral"),
        )
    )
    errors = F.concat(more, "errors")
    return v.select("comment_id", "annotator", "neutral", "pairs", "updated_at", errors.alias("errors"), (F.size(errors) == 0).alias("accepted"))


def put_labels(stored: DataFrame, judged: DataFrame) -> DataFrame:
    """The label store after the accepted requests: the newest per comment and annotator, of equal times the request."""
    cols = ["comment_id", "annotator", "neutral", "pairs", "updated_at"]
    both = stored.select(*cols).withColumn("rank", F.lit(0)).unionByName(judged.where("accepted").select(*cols).withColumn("rank", F.lit(1)))
    return latest(both, ["comment_id", "annotator"], ["updated_at", "rank"]).drop("rank")


def judge_adjudications(requests: DataFrame, labels: DataFrame, items: DataFrame) -> DataFrame:
    """``requests`` with what they would store: ``final, neutral, pairs, errors, accepted``.

    requests: ``comment_id, final, pairs, resolved_by, updated_at``; labels: ``comment_id, annotator,
    neutral, pairs``. A and B copy that annotator's label and need one, NEUTRAL has no pairs, CUSTOM brings
    its own valid ones (without any it is neutral). Other verdicts, nobody's ones and unknown comments
    are refused.
    """
    final = F.upper(F.trim("final"))
    side = labels.where(F.col("annotator").isin("A", "B")).select(F.col("comment_id").alias("l_id"), "annotator", F.col("neutral").alias("l_neutral"), F.col("pairs").alias("l_pairs"))
    j = requests.withColumn("final", final).join(side, (F.col("comment_id") == F.col("l_id")) & (F.col("final") == F.col("annotator")), "left")
    custom, none = F.col("final") == "CUSTOM", _none(requests, "pairs")
    pairs = F.when(F.col("final").isin("A", "B"), F.coalesce("l_pairs", none)).when(custom, F.coalesce("pairs", none)).otherwise(none)
    v = validate(j.withColumn("pairs", pairs).join(items, F.col("comment_id") == F.col("id"), "left"))
    more = F.array_compact(
        F.array(
            F.when(F.col("id").isNull(), "comment: unknown"),
            F.when(~F.coalesce(F.col("final").isin(*VERDICTS), F.lit(False)), "final: not in the list"),
            F.when(F.col("final").isin("A", "B") & F.col("l_id").isNull(), "final: no label to copy"),
            F.when(F.coalesce(F.trim("resolved_by"), F.lit("")) == "", "resolved_by: missing"),
        )
    )
    # copied labels were checked when they were stored
    errors = F.concat(more, F.when(custom, F.col("errors")).otherwise(F.array().cast("array<string>")))
    neutral = F.when(F.col("final").isin("A", "B"), F.coalesce("l_neutral", F.size("pairs") == 0)).otherwise(F.size("pairs") == 0)
    return v.select("comment_id", "final", neutral.alias("neutral"), "pairs", "resolved_by", "updated_at", errors.alias("errors"), (F.size(errors) == 0).alias("accepted"))


def put_adjudications(stored: DataFrame, judged: DataFrame) -> DataFrame:
    """The store of adjudications after the accepted requests: the newest per comment, of equal times the request."""
    cols = ["comment_id", "final", "neutral", "pairs", "resolved_by", "updated_at"]
    both = stored.select(*cols).withColumn("rank", F.lit(0)).unionByName(judged.where("accepted").select(*cols).withColumn("rank", F.lit(1)))
    return latest(both, ["comment_id"], ["updated_at", "rank"]).drop("rank")


def append_messages(log: DataFrame, messages: DataFrame, order: list[str], scratch) -> DataFrame:
    """The log ``id, comment_id, author, body`` with the messages behind it; ids go on from the greatest.

    Bodies are trimmed; messages without one or without an author are refused. ``order`` makes the
    messages' order total. Ids are given out without one task that sees all messages.
    """
    said = messages.withColumn("body", F.trim("body")).where("body <> '' and author is not null")
    last = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    new = numbered(said, order, "n", scratch).crossJoin(F.broadcast(last)).select((F.col("last") + F.col("n")).alias("id"), "comment_id", "author", "body")
    return log.select("id", "comment_id", "author", "body").unionByName(new)
