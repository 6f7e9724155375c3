"""A stand-in for an annotating model: its answers depend on the item alone, so any order of calls gives the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions import text as T
from ..schema import PAIRS

BAD_SPAN = "words that stand nowhere"


def _words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def mock_output(key: str, title: str, body: str) -> Column:
    """Raw output: every tenth item gets a span that isn't in its text, every fourth a valid pair, the others none.

    A pair names the first words of the comment as its emotion span and, where there is a title, the title's
    first words as cause, with a source that is wrong on purpose. Some outputs are wrapped in prose and a fence.
    Comments without words have no pair.
    """
    h = T.text_pos(key)
    span, cause = _words(F.coalesce(F.col(body), F.lit("")), 6), _words(F.coalesce(F.col(title), F.lit("")), 5)
    text = lambda c: F.coalesce(c, F.lit(None).cast("string"))
    with_cause = (cause != "") & (h % 10 != 0)
    pair = F.struct(
        F.lit("pessimism_despair").alias("emotion"), F.when(h % 10 == 0, BAD_SPAN).otherwise(span).alias("emotion_span"), text(F.when(with_cause, cause)).alias("cause_span"),
        text(F.when(with_cause, "comment")).alias("cause_source"), F.when(with_cause, "other").otherwise("unclear").alias("cause_category"), F.lit("none").alias("target_asset"), F.lit(0.5).alias("intensity"), F.lit(False).alias("sarcasm"),
    )
    has = (h % 10 == 0) | ((h % 4 == 0) & (span != ""))
    js = F.to_json(F.struct(F.when(has, F.array(pair)).otherwise(F.array().cast(PAIRS)).alias("pairs")), {"ignoreNullFields": "false"})
    return F.when(h % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), js, F.lit("\n```\n"))).otherwise(js)


def parse_output(raw: str) -> Column:
    """The pairs of the first JSON object in a raw output; none where it can't be parsed."""
    parsed = F.from_json(C.first_object_udf(raw), f"pairs {PAIRS}")
    return F.coalesce(parsed["pairs"], F.array().cast(PAIRS))
