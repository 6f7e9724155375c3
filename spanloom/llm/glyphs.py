"""One consistent form for texts that look the same (problem 10).

Arrow text is copied once to a numpy code-point array. Lookup-table gathers replace full-width
forms, special spaces and hyphens and look-alike letters; a table of replacement lengths gives
expansion offsets, by which invisible characters vanish and ligatures and accented letters come
apart; combining marks are then put in canonical order and composed for all rows at once. No step
calls a string function per row. Letter case, accents, quotes and all other visible marks stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.skew import heavy_keys, skew_join, split_join
from ..plans.scratch import Scratch
from .arrow_text import from_code_points, slices, to_code_points
from .glyph_tables import tables


def fold(cps: np.ndarray, off: np.ndarray, with_source: bool = False):
    """Canonical code points and row offsets; with ``with_source`` also each one's source position.

    The form is idempotent. Marks never join a base of another row.
    """
    source = np.arange(cps.size) if with_source else None
    high = np.flatnonzero(cps >= 0x80)
    if not high.size:
        return (cps, off, source) if with_source else (cps, off)
    t = tables()
    c = cps[high]
    n_high, to = t.length[c].astype(np.int64), t.one[c]
    if not t.rank[c].any():
        # no mark can join a composed letter here, so those need not come apart
        n_high, to = np.where(t.solid[c] > 0, 1, n_high), np.where(t.solid[c] > 0, t.solid[c], to)
    if (n_high == 1).all():
        out = cps.copy()
        out[high] = to
    else:
        n = np.ones(cps.size, np.int64)
        n[high] = n_high
        at = np.concatenate([[0], np.cumsum(n)])
        idx = np.repeat(np.arange(cps.size), n)
        out = cps[idx]
        single, multi = n_high == 1, n_high > 1
        out[at[high[single]]] = to[single]
        lens = n_high[multi]
        k = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(at[high[multi]], lens) + k] = t.flat[np.repeat(t.start[c[multi]], lens) + k]
        off = at[off]
        source = idx if with_source else None
    rank = np.zeros(out.size, np.uint8)
    high = np.flatnonzero(out >= 0x80)
    rank[high] = t.rank[out[high]]
    mark = rank > 0
    if mark.any():
        out, keep = _compose(out, off, rank, mark, t)
        if not keep.all():
            at = np.concatenate([[0], np.cumsum(keep)])
            out, off = out[keep], at[off]
            source = source[keep] if with_source else None
    return (out, off, source) if with_source else (out, off)


def _compose(out: np.ndarray, off: np.ndarray, rank: np.ndarray, mark: np.ndarray, t) -> tuple[np.ndarray, np.ndarray]:
    out = out.copy()
    begins = ~mark
    begins[off[:-1][off[:-1] < out.size]] = True
    run = np.cumsum(begins)
    pos = np.flatnonzero(mark)
    order = np.lexsort((pos, rank[pos], run[pos]))
    out[pos], rank = out[pos[order]], rank.copy()
    rank[pos] = rank[pos[order]]
    keep = np.ones(out.size, bool)
    # marks of a run, one rank in the run after the other; a run of marks at a row's start has no base
    first = np.flatnonzero(begins)
    base_of = first[run[pos] - 1]
    has_base = ~mark[base_of]
    pos, base_of = pos[has_base], base_of[has_base]
    nth = pos - base_of
    last = np.zeros(out.size, np.uint8)  # class of the last mark that stayed, by base
    for r in range(1, int(nth.max()) + 1 if nth.size else 0):
        here = nth == r
        p, b = pos[here], base_of[here]
        key = out[b].astype(np.uint64) << np.uint64(21) | out[p].astype(np.uint64)
        i = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
        ok = (t.pair_key[i] == key) & (last[b] < rank[p])
        out[b[ok]] = t.pair_to[i[ok]]
        keep[p[ok]] = False
        last[b[~ok]] = rank[p[~ok]]
    return out, keep


def fold_text(texts: pa.Array) -> pa.Array:
    """The canonical form of every text; nulls stay null."""
    return from_code_points(*fold(*to_code_points(texts)), texts)


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """Append the canonical form of column ``text``; other columns pass through unchanged.

    Null texts stay null, empty ones empty. Fails on a clash of ``out`` with a column of ``df``.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, fold_text(part.column(text)).cast(pa.string())], [*part.schema.names, out])

    fields = StructType([*df.schema.fields, StructField(out, StringType())])
    return df.mapInArrow(run, fields)


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, canon, raw`` of every row with a text: digests of its canonical form and its bytes."""
    kept = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return with_canonical(kept, "t", "c").select(F.col("k").alias(key), F.sha2("c", 256).alias("canon"), F.sha2("t", 256).alias("raw"))


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of different texts that look the same: ``<key>_a < <key>_b``.

    Exact copies are no pair, but each copy is paired with each different look-alike, so the result
    grows with the product of their numbers; ``look_alike_classes`` has one row per document. Classes
    with one text only leave after a map-side combined aggregation; the join then runs over pairs of
    different texts of a class, so no pair is formed that isn't in the result. Classes and texts of
    very many documents are split over tasks.
    """
    scratch = Scratch(df.sparkSession, "glyphs")
    rows = scratch.table(look_alike_classes(df, key, text), "digests")
    mixed = rows.groupBy("canon").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("canon")
    mixed = mixed.withColumnRenamed("canon", "m_canon")
    rows = scratch.table(skew_join(rows, mixed, "canon", "m_canon", heavy_keys(rows, "canon"), "left_semi"), "mixed")
    hot = heavy_keys(rows, "raw")
    texts = rows.select("canon", "raw").distinct()
    other = texts.select(F.col("canon").alias("c2"), F.col("raw").alias("raw_b"))
    pairs = texts.join(other, (F.col("canon") == F.col("c2")) & (F.col("raw") != F.col("raw_b"))).select(F.col("raw").alias("raw_a"), "raw_b")
    a, b = f"{key}_a", f"{key}_b"
    left = rows.select(F.col(key).alias(a), F.col("raw").alias("raw_a"))
    right = rows.select(F.col(key).alias(b), F.col("raw").alias("raw_b"))
    half = split_join(left, pairs, "raw_a", hot, salt_on=[a])
    return split_join(half, right, "raw_b", hot, salt_on=[a]).where(F.col(a) < F.col(b)).select(a, b)
