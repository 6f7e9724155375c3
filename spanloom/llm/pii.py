"""Personal information inside free text (problem 4): findings and typed placeholders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .arrow_text import slices
from .pii_kernel import KINDS, common_words, mask, scan

#: A rank file of a public byte-level vocabulary: which words a large corpus writes in small letters.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FINDINGS = "rec_field string, rec_id string, kind string, begin int, end int, found string"


def _common(df: DataFrame, vocabulary: str | None):
    """The common words for the tasks; their number doesn't grow with the data."""
    if vocabulary is None:
        return lambda: None
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(common_words(f.read()))
    return lambda: sent.value


def findings(df: DataFrame, key: str, fields: Sequence[str], vocabulary: str | None = VOCABULARY) -> DataFrame:
    """``rec_field, rec_id, kind, begin, end, found``: every identifier in every text of every row.

    Offsets count code points of the original text, ``found`` is that piece of it. Null and empty
    texts have none; a repeated row repeats its findings. Texts of any length are scanned whole.
    Rows with a null key are scanned too and keep the null. Without a ``vocabulary`` names are only
    found by the list of given names and by cues.
    """
    common = _common(df, vocabulary)
    kept = df.select(F.col(key).cast("string").alias("k"), *[F.col(f).alias(f"t_{i}") for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, field in enumerate(fields):
                for part in slices(batch, f"t_{i}"):
                    texts = part.column(f"t_{i}")
                    row, kind, begin, end = scan(texts, common())
                    if not len(row):
                        continue
                    at = pa.array(row)
                    hits = texts.take(at).to_pylist()
                    found = [t[a:b] for t, a, b in zip(hits, begin.tolist(), end.tolist())]
                    cols = [pa.array([field] * len(row)), part.column("k").take(at), pa.array([KINDS[k] for k in kind.tolist()]), pa.array(begin.astype("int32")), pa.array(end.astype("int32")), pa.array(found, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["rec_field", "rec_id", "kind", "begin", "end", "found"])

    return kept.mapInArrow(run, FINDINGS)


def masked(df: DataFrame, fields: Sequence[str], vocabulary: str | None = VOCABULARY) -> DataFrame:
    """``df`` with every identifier in ``fields`` replaced by its typed placeholder.

    ``<field>_found`` counts the replacements. All other text and all other columns are unchanged;
    null texts stay null. Fails if a count's name clashes with a column.
    """
    common = _common(df, vocabulary)
    extra = [f"{f}_found" for f in fields]
    if clash := set(extra) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    names = df.columns
    schema = StructType([*df.schema.fields, *[StructField(x, IntegerType()) for x in extra]])
    for f in fields:
        schema[f].dataType = StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, fields[0]):
                cols = list(part.columns)
                counts = []
                for f in fields:
                    i = names.index(f)
                    cols[i], n = mask(part.column(i), common())
                    counts.append(pa.array(n, pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols, *counts], [*names, *extra])

    return df.mapInArrow(run, schema)
