"""Markdown worklists: rendering, and parsing the verdicts that people filled in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import PAIR_FIELDS, PAIRS

VERDICTS = ("A", "B", "NEUTRAL", "CUSTOM")
NULLABLE = ("cause_span", "cause_source")
NOTHING = ("null", "none", "")


def parse_block(lines: list[str]) -> list[dict]:
    """Pairs of a custom block: ``- emotion:`` opens one, the other fields follow as ``key: value``.

    Unknown fields are left out; the words for null only count for the cause's span and source.
    """
    pairs: list[dict] = []
    for line in lines:
        text = line.strip()
        if text.startswith("- emotion:"):
            pairs.append(dict.fromkeys(PAIR_FIELDS))
            text = text[2:]
        key, colon, value = text.partition(":")
        key, value = key.strip(), value.strip().strip("\"'")
        if not (colon and pairs and key in PAIR_FIELDS):
            continue
        if key in NULLABLE and value.lower() in NOTHING:
            value = None
        elif key == "intensity":
            value = float(value)
        elif key == "sarcasm":
            value = value.lower() in ("true", "yes", "1")
        pairs[-1][key] = value
    return pairs


@F.pandas_udf(StringType())
def parse_block_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import json

    for texts in batches:
        yield texts.map(lambda t: json.dumps(parse_block((t or "").splitlines())))


def parse_worklist(sections: DataFrame) -> DataFrame:
    """``comment_id, final, pairs`` from worklist sections (column ``value``).

    A section has ``### `id` `` and ``FINAL: verdict``; fails on an open or unknown verdict.
    """
    cid = F.regexp_extract("value", r"###\s+`([^`]+)`", 1)
    final = F.upper(F.trim(F.regexp_extract("value", r"(?m)^FINAL:\s*(\S+)", 1)))
    rows = sections.select(cid.alias("comment_id"), final.alias("final"), "value").where("comment_id <> ''")
    checked = F.when(F.col("final").isin(*VERDICTS), F.col("final")).otherwise(F.raise_error(F.concat(F.lit("unresolved: "), "comment_id")).cast("string"))
    pairs = F.from_json(parse_block_udf("value"), PAIRS)
    return rows.select("comment_id", checked.alias("final"), F.when(F.col("final") == "CUSTOM", pairs).otherwise(F.array().cast(PAIRS)).alias("pairs"))


def render_worklist(rows: DataFrame) -> DataFrame:
    """One section per row of ``comment_id, body, final, block``."""
    return rows.select(F.concat(F.lit("### `"), "comment_id", F.lit("`\n\n"), "body", F.lit("\n\nFINAL: "), "final", F.lit("\n"), F.coalesce("block", F.lit("")), F.lit("\n")).alias("value"))
