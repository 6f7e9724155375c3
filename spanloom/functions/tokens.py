"""Token counts with a rank file of a public byte-level vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Where the rank file lies on the driver; its content is sent to the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_count(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text; null for null, and where it can't be tokenized."""
    with open(path, "rb") as f:
        # a vocabulary doesn't grow with the data
        ranks = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(ranks.value)

        def one(t):
            try:
                return len(enc.encode_ordinary(t))
            except Exception:
                return None

        return texts.map(one, na_action="ignore").astype("Int64")

    return count(text)


def within_budget(spark: SparkSession, text: Column, budget: int, path: str = VOCABULARY) -> Column:
    """Whether a text has at most ``budget`` tokens; one that can't be tokenized counts as over it, a null too."""
    return F.coalesce(token_count(spark, text, path) <= budget, F.lit(False))
