"""Evaluation texts leaking into training text (problem 8): MinHash containment search, verified.

Queries. A passage counts from ``WINDOW`` consecutive words, so the query domains of an item are its
windows: each is the set of its ``QUERY`` shingles of ``SHINGLE`` words. A document leaks if it contains
such a domain wholly (containment 1).

Partitions by size. A long document has so many shingles that its Jaccard similarity with a window is
next to nothing, and no signature of bounded length would find it. Documents are therefore cut into
overlapping domains of at most ``DOMAIN`` shingles so that every window lies in one of them, and the
domains are partitioned by their size u (QUERY to DOMAIN; what is shorter cannot hold a passage).
Containment t of a query of q shingles means a Jaccard similarity of t q / (u + q - t q) at least:
that is each partition's threshold, ``q / u`` here. Its MinHash signature has as many functions, each a
band of its own, as let a pair at the threshold pass with a probability of ``1 - MISS``
(``bands``). Window by window the search may thus miss one in a million; a passage of more words has
more windows.

Search. The items' signatures go into a bit table of bounded size, which every task gets; a domain is
a candidate if one of its bands hits. A second bit table, of the items' windows, tells which windows of a
candidate are worth verifying. Both tables only save work: a crowded table lets more through.

Verification. The windows that are left are joined with the items' by their exact sequence of
shingles, as 128-bit digests of the words, so texts are never shuffled; a digest that many documents
hold is salted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, split_join
from ..plans.scratch import Scratch
from .arrow_text import from_code_points, slices, to_code_points
from .glyphs import fold

WINDOW = 12
SHINGLE = 5
#: Shingles of a window, and of the largest domain.
QUERY = WINDOW - SHINGLE + 1
DOMAIN = 2 * QUERY
#: Windows that one domain answers for; the next domain begins behind their first words.
STRIDE = DOMAIN - QUERY + 1
#: Probability that the signature of a domain at its threshold hits nothing.
MISS = 1e-6
#: Bits of each bit table: about 512 per entry, at most this power of two (16 MB).
TABLE_BITS = 27

_ENTITY = re.compile(r"&(?:[a-z][a-z0-9]{1,31}|#[0-9]{1,7}|#x[0-9a-f]{1,6});")
_WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(texts: pa.Array) -> Iterator[list[str]]:
    """Lower-case words of each text: look-alikes folded, entities, markup and punctuation left out."""
    folded = from_code_points(*fold(*to_code_points(texts)))
    lower = pa.compute.utf8_lower(folded)
    again = from_code_points(*fold(*to_code_points(lower)))
    for t in again.to_pylist():
        yield _WORD.findall(_ENTITY.sub(" ", t) if "&" in t else t)


class Hasher:
    """64-bit hashes of words, kept for the words seen so far (cleared when there are many)."""

    def __init__(self, most: int = 500_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def bands(size: int, query: int = QUERY) -> int:
    """MinHash functions for domains of ``size`` shingles: enough for containment 1 of a query."""
    threshold = query / size
    return 1 if threshold >= 1 else math.ceil(math.log(MISS) / math.log(1 - threshold))


_BANDS = np.array([0] * QUERY + [bands(u) for u in range(QUERY, DOMAIN + 1)])


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """The values under hash function number ``salt``."""
    y = (x ^ np.uint64((salt + 1) * 0xD6E8FEB86659FD93 % 2**64)) * _MIX
    y ^= y >> np.uint64(32)
    return y * _MULT


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``SHINGLE`` words."""
    m = max(h.size - SHINGLE + 1, 0)
    s = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        s = (s ^ h[k : k + m]) * _MULT
        s ^= s >> np.uint64(29)
    return s


class Shingled:
    """The shingles of a batch of texts, all windows and all domains over them."""

    def __init__(self, texts: pa.Array, hasher: Hasher):
        self.words = list(words_of(texts))
        n = np.array([len(w) if len(w) >= WINDOW else 0 for w in self.words], np.int64)
        parts = [hasher(w) for w, k in zip(self.words, n) if k]
        # shingles of all texts at once, less those that run from one text into the next
        run_on = shingles(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        size = np.where(n > 0, n - SHINGLE + 1, 0)
        first = np.cumsum(n) - n
        self.begin = np.cumsum(size) - size
        self.s = run_on[np.repeat(first - self.begin, size) + np.arange(size.sum())]
        self.size = size
        self.n_windows = np.maximum(size - QUERY + 1, 0)

    def _at(self, count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and first shingle of ``count`` positions per text, ``step`` apart."""
        row = np.repeat(np.arange(count.size), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return row, self.begin[row] + nth * step

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return self._at(self.n_windows, 1)

    def domains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first shingle and size of every domain."""
        row, at = self._at(-(-self.n_windows // STRIDE), STRIDE)
        return row, at, np.minimum(DOMAIN, self.begin[row] + self.size[row] - at)

    def signatures(self, at: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """One MinHash after the other of the shingle sets that begin at ``at``."""
        # a set of QUERY to 2 QUERY shingles is two runs of QUERY that may overlap, and those minima come by doubling
        for f in range(most):
            x, width = _mix(self.s, f), 1
            while width < QUERY:
                step = min(width, QUERY - width)
                x = np.minimum(x[:-step], x[step:])
                width += step
            yield _mix(np.minimum(x[at], x[at + size - QUERY]), f)

    def code(self, at: np.ndarray) -> np.ndarray:
        """A hash of each window: of three shingles that hold all its words."""
        s = self.s
        return _mix(_mix(_mix(s[at], 101) ^ s[at + SHINGLE], 102) ^ s[at + QUERY - 1], 103)

    def digest(self, row: int, at: int) -> bytes:
        p = at - self.begin[row]
        return xxhash.xxh3_128_digest(" ".join(self.words[row][p : p + WINDOW]))


class BitTable:
    """A set of 64-bit hashes as bits; may hold others, never misses its own."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def of(hashes: DataFrame, col: str, most: int) -> "BitTable":
        """From a column of hashes: what comes to the driver is at most the table itself."""
        n = hashes.count()
        bits = min(most, max(6, math.ceil(math.log2(512 * n + 1))))
        place = F.shiftrightunsigned(col, 64 - bits)
        rows = hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
        return BitTable(words, bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        p = h >> np.uint64(64 - self.bits)
        return (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


DIGEST = "d1 bigint, d2 bigint"


def _digests(values: list[bytes]) -> list[pa.Array]:
    flat = np.frombuffer(b"".join(values), np.int64).reshape(-1, 2)
    return [pa.array(flat[:, 0]), pa.array(flat[:, 1])]


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """``k, d1, d2, code, sig``: every window of every item with its digest, its code and its signature."""
    kept = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    most = int(_BANDS.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, "t"):
                b = Shingled(part.column("t"), hasher)
                row, at = b.windows()
                if not row.size:
                    continue
                sig = np.stack(list(b.signatures(at, np.full(at.size, QUERY), most)), axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(at.size + 1, dtype=np.int32) * most), pa.array(sig.reshape(-1).view(np.int64)))
                d = _digests([b.digest(r, p) for r, p in zip(row.tolist(), at.tolist())])
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(row)), *d, pa.array(b.code(at).view(np.int64)), lists], ["k", "d1", "d2", "code", "sig"])

    return kept.mapInArrow(run, f"k {kept.schema['k'].dataType.simpleString()}, {DIGEST}, code bigint, sig array<bigint>")


def candidates(docs: DataFrame, key: str, text: str, signatures: BitTable, codes: BitTable) -> DataFrame:
    """``k, d1, d2``: windows of the documents' candidate domains that may be an item's. Null texts have none."""
    kept = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    sent = docs.sparkSession.sparkContext.broadcast((signatures, codes))
    most = int(_BANDS.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        signatures, codes = sent.value
        for batch in batches:
            for part in slices(batch, "t"):
                b = Shingled(part.column("t"), hasher)
                row, at, size = b.domains()
                if not row.size:
                    continue
                hit, n = np.zeros(row.size, bool), _BANDS[size]
                for f, sig in enumerate(b.signatures(at, size, most)):
                    hit |= (f < n) & signatures.holds(sig)
                found = np.flatnonzero(hit)
                # the windows of the candidates, less those that run over the end of their text
                row = np.repeat(row[found], STRIDE)
                at = (at[found, None] + np.arange(STRIDE)).reshape(-1)
                inside = at + QUERY <= b.begin[row] + b.size[row]
                row, at = row[inside], at[inside]
                keep = codes.holds(b.code(at)) if at.size else np.zeros(0, bool)
                row, at = row[keep], at[keep]
                if row.size:
                    d = _digests([b.digest(r, p) for r, p in zip(row.tolist(), at.tolist())])
                    yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(row)), *d], ["k", "d1", "d2"])

    return kept.mapInArrow(run, f"k {kept.schema['k'].dataType.simpleString()}, {DIGEST}")


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", table_bits: int = TABLE_BITS) -> DataFrame:
    """``doc_key, item_key, n_shared, n_item, coverage``: documents holding a passage of an item.

    A passage is ``WINDOW`` or more consecutive words, whatever the case, punctuation, markup, line
    breaks and look-alike characters. ``coverage`` is the share of the item's distinct windows that
    the document holds. Items or documents with null or shorter texts appear in no row; repeated rows
    count once. ``table_bits`` bounds the bit tables that every task gets; it changes no row.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    own = scratch.table(item_windows(items, item_key, text), "items")
    signatures = BitTable.of(own.select(F.explode("sig").alias("h")), "h", table_bits)
    codes = BitTable.of(own.select("code").distinct(), "code", table_bits)
    near = scratch.table(candidates(docs, doc_key, text, signatures, codes), "near")
    own = own.select(F.col("k").alias(item_key), "d1", "d2").distinct()
    sizes = own.groupBy(F.col(item_key).alias("s_key")).agg(F.count(F.lit(1)).alias("n_item"))
    # a window that many documents hold is spread over tasks
    both = split_join(near.withColumnRenamed("k", doc_key).withColumnRenamed("d2", "e2"), own, "d1", heavy_keys(near, "d1"), salt_on=[doc_key])
    shared = both.where("d2 = e2").select(doc_key, item_key, "d1", "d2").distinct().groupBy(doc_key, item_key).agg(F.count(F.lit(1)).alias("n_shared"))
    return shared.join(sizes, F.col(item_key) == F.col("s_key")).select(doc_key, item_key, "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("coverage"))
