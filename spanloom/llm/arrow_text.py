"""Arrow string arrays as flat numpy code-point arrays, and back, without per-row string calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds at most, unless a single text is longer.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice's text stays near ``most`` bytes: very long texts stand alone."""
    arr = batch.column(column).cast(pa.large_string())
    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    start = 0
    while start < len(arr):
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def to_code_points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the row offsets into them. Nulls have no code points."""
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    if not raw.size:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    if raw.max() < 128:
        return raw.astype(np.uint32), off - off[0]
    starts = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(starts)])
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return cps, at[off - off[0]]


def from_code_points(cps: np.ndarray, off: np.ndarray, nulls: pa.Array | None = None) -> pa.Array:
    """The inverse of ``to_code_points``; rows flagged in ``nulls`` come back null."""
    if cps.size and cps.max() >= 128:
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        data, boff = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), at[off]
    else:
        data, boff = cps.astype(np.uint8).tobytes(), off
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(boff, np.int64)), pa.py_buffer(data))
    if nulls is not None and nulls.null_count:
        out = pa.compute.if_else(nulls.is_null(), pa.scalar(None, pa.large_string()), out)
    return out
