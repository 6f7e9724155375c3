"""Span offsets into normalised text, with a map back to the raw characters.

A batch's texts are one array of code points. References are decoded where there are any; lookup
tables of code points then fold, drop, expand and case-fold all texts at once, and every step carries
the raw position along. No step loops over characters, and a text that occurs several times in a
batch - such as the post of many spans - is indexed once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .text import FOLD_FROM, FOLD_TO

# What an entity may look like, terminated or not.
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_FOLD = dict(zip(FOLD_FROM, FOLD_TO)) | {"…": "...", "\\": ""}

OFFSET = StructType([StructField("src", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("occurrence", IntegerType())])
INDEXED = StructType([StructField("norm", StringType()), StructField("idx", ArrayType(IntegerType()))])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Rewrite:
    """A table that replaces code points by none, one or several."""

    def __init__(self, changes: dict[int, str]):
        self.length = np.ones(0x110000, np.uint8)
        self.one = np.arange(0x110000, dtype=np.uint32)
        self.start = np.zeros(0x110000, np.int32)
        flat: list[int] = []
        for cp, new in changes.items():
            self.length[cp] = len(new)
            if len(new) == 1:
                self.one[cp] = ord(new)
            else:
                self.start[cp] = len(flat)
                flat += map(ord, new)
        self.flat = np.array(flat or [0], np.uint32)

    def __call__(self, cps: np.ndarray, *along: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.length[cps]
        if (n == 1).all():
            return (self.one[cps], *along)
        at = np.repeat(np.arange(cps.size), n)
        nth = np.arange(at.size) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
        source = cps[at]
        out = np.where(n[at] == 1, self.one[source], self.flat[np.minimum(self.start[source] + nth, self.flat.size - 1)])
        return (out, *[x[at] for x in along])


@lru_cache(maxsize=1)
def _tables() -> tuple[_Rewrite, np.ndarray, _Rewrite]:
    """Folding of signs, which code points are blanks, and case folding."""
    chars = [chr(i) for i in range(0x110000)]
    blank = np.array([c.isspace() for c in chars])
    return _Rewrite({ord(k): v for k, v in _FOLD.items()}), blank, _Rewrite({i: f for i, c in enumerate(chars) if (f := c.casefold()) != c})


def _decoded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points with references replaced, and the raw position of each; a replaced one stands where it began."""
    cps, at = [], []
    done = 0
    for m in REFERENCE.finditer(text):
        new = html.unescape(m[0])
        if new == m[0]:
            continue
        cps += [_points(text[done : m.start()]), _points(new)]
        at += [np.arange(done, m.start()), np.full(len(new), m.start())]
        done = m.end()
    return np.concatenate([*cps, _points(text[done:])]), np.concatenate([*at, np.arange(done, len(text))])


def index_all(texts: Iterable[str | None]) -> list[tuple[str, np.ndarray]]:
    """The normal form of every text and, for each of its characters, the raw position it came from."""
    texts = [t or "" for t in texts]
    if not texts:
        return []
    parts = [_decoded(t) if "&" in t else (_points(t), np.arange(len(t))) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(c) for c, _ in parts])
    cps, at = np.concatenate([c for c, _ in parts]), np.concatenate([a for _, a in parts])
    folds, is_blank, cases = _tables()
    cps, at, row = folds(cps, at, row)
    blank = is_blank[cps]
    # of a run of blanks the first stays, and none at a text's beginning
    first = np.concatenate([[True], row[1:] != row[:-1]]) if row.size else np.zeros(0, bool)
    keep = ~blank | ~(first | np.concatenate([[True], blank[:-1]])) if row.size else blank
    cps, at, row, blank = np.where(blank, 32, cps)[keep], at[keep], row[keep], blank[keep]
    if row.size:
        last = np.concatenate([row[1:] != row[:-1], [True]])
        keep = ~(blank & last)
        cps, at, row = cps[keep], at[keep], row[keep]
    cps, at, row = cases(cps, at, row)
    end = np.searchsorted(row, np.arange(len(texts)), "right")
    begin = np.concatenate([[0], end[:-1]])
    norm = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [(norm[b:e], at[b:e]) for b, e in zip(begin.tolist(), end.tolist())]


def indexed(text: str | None) -> tuple[str, list[int]]:
    """The normal form of one text and the raw positions."""
    norm, at = index_all([text])[0]
    return norm, at.tolist()


class Index:
    """The texts of a batch, each indexed once."""

    def __init__(self, *columns: Iterable[str | None]):
        distinct = dict.fromkeys(t for c in columns for t in c if isinstance(t, str))
        self.of = dict(zip(distinct, index_all(distinct)))

    def __getitem__(self, text: str | None) -> tuple[str, np.ndarray]:
        return self.of[text] if isinstance(text, str) else ("", np.zeros(0, np.int64))

    def encode(self, span: str | None, sources: list[tuple[str, str | None]]) -> tuple | None:
        """``(src, start, end, occurrence)`` in the first source that holds the span; None if none does.

        ``occurrence`` is the number of further occurrences, not an ordinal.
        """
        needle = self[span][0]
        if not needle:
            return None
        for name, raw in sources:
            norm = self[raw][0]
            at = norm.find(needle)
            if at >= 0:
                return name, at, at + len(needle), max(0, norm.count(needle) - 1)
        return None

    def decode(self, offset, sources: dict[str, str | None]) -> str | None:
        """The raw text of an offset; None if it runs past its source's text."""
        raw = sources.get(offset["src"])
        at = self[raw][1]
        if offset["end"] > len(at) or offset["end"] <= offset["start"]:
            return None
        return raw[at[offset["start"]] : at[offset["end"] - 1] + 1]


def encode(span: str | None, sources: list[tuple[str, str | None]]) -> tuple | None:
    return Index([span], [t for _, t in sources]).encode(span, sources)


def decode(offset, sources: dict[str, str | None]) -> str | None:
    return Index(sources.values()).decode(offset, sources)


@F.pandas_udf(INDEXED)
def indexed_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame(index_all(texts), columns=["norm", "idx"])


@F.pandas_udf(StringType())
def normalize_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([n for n, _ in index_all(texts)], index=texts.index, dtype=object)


@F.pandas_udf(OFFSET)
def encode_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for span, comment, parent, post in batches:
        index = Index(span, comment, parent, post)
        rows = [index.encode(s, [("comment", c), ("parent", p), ("post", t)]) or (None, None, None, None) for s, c, p, t in zip(span, comment, parent, post)]
        yield pd.DataFrame(rows, columns=["src", "start", "end", "occurrence"]).astype({"start": "Int32", "end": "Int32", "occurrence": "Int32"})


@F.pandas_udf(StringType())
def decode_udf(batches: Iterator[tuple[pd.DataFrame, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for off, comment, parent, post in batches:
        index = Index(comment, parent, post)
        out = []
        for o, c, p, t in zip(off.to_dict("records"), comment, parent, post):
            out.append(index.decode(o, {"comment": c, "parent": p, "post": t}) if isinstance(o.get("src"), str) else None)
        yield pd.Series(out, dtype=object)


def first_object(text: str | None) -> str | None:
    """The first JSON object in a model's output: the whole, a fenced block, or the first balanced braces."""
    import json

    def objects() -> Iterator[str]:
        yield t
        yield from re.findall(r"```(?:json)?\s*(.*?)```", t, re.S)
        depth, begin, quoted, escaped = 0, -1, False, False
        for i, ch in enumerate(t):
            if quoted:
                quoted = escaped or ch != '"'
                escaped = ch == "\\" and not escaped
            elif ch == '"' and depth:
                quoted = True
            elif ch == "{":
                begin = i if depth == 0 else begin
                depth += 1
            elif ch == "}" and depth:
                depth -= 1
                if depth == 0:
                    yield t[begin : i + 1]
                    return

    t = (text or "").strip()
    # braces are only counted where neither the whole nor a block is an object
    for x in objects():
        try:
            if isinstance(json.loads(x), dict):
                return x.strip()
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def first_object_udf(texts: pd.Series) -> pd.Series:
    return texts.map(first_object)
