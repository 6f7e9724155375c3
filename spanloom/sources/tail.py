"""Incremental reading of line files that grow: only bytes behind a stored offset, in ranges over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from .jsonl import latest, parse_tolerant
from .state import file_sizes, read_state, write_state

#: Bytes that one task reads; the line that it ends in is read to its end.
RANGE = 64_000_000


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for r in batch.to_pylist():
            system, path = fs.FileSystem.from_uri(r["file"] if "://" in r["file"] else r["file"].replace("file:", "file://", 1))
            with system.open_input_file(path) as f:
                # a line belongs to the range that it begins in: what comes before the first break is another's
                begin = r["begin"] - (0 if r["first"] else 1)
                f.seek(begin)
                data = f.read(r["end"] - begin)
                while not data.endswith(b"\n") and (more := f.read(1_000_000)):
                    stop = more.find(b"\n") + 1
                    data += more[:stop] if stop else more
                    if stop:
                        break
            at = 0 if r["first"] else data.find(b"\n") + 1 or len(data)
            value, ats, ends = [], [], []
            # what follows the last break isn't finished: it is read when it is
            while (stop := data.find(b"\n", at)) >= 0 and begin + at < r["end"]:
                value.append(data[at:stop].decode("utf-8", "replace"))
                ats.append(begin + at)
                at = stop + 1
                ends.append(begin + at)
                if len(value) == 10_000:
                    yield _batch(r["file"], value, ats, ends)
                    value, ats, ends = [], [], []
            if value:
                yield _batch(r["file"], value, ats, ends)


def _batch(file: str, value: list[str], begin: list[int], end: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(value)), pa.array(value, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["file", "value", "at", "until"])


def tail(spark: SparkSession, path: str, offsets: dict[str, int], scratch: Scratch) -> tuple[DataFrame, dict[str, int]]:
    """Finished lines behind the offsets as ``file, value, at, until``, and the offsets behind them.

    ``path`` is a file or a folder of files; a file without an offset is read from its beginning. A
    last line without its line break is left for the next time. A file that has become shorter than
    its offset was replaced and is read anew. The file system must be one that pyarrow opens.
    """
    ranges = []
    kept = dict(offsets)
    for file, size in sorted(file_sizes(spark, path).items()):
        start = offsets.get(file, 0)
        if size < start:
            start = kept[file] = 0
        ranges += [(file, a, min(a + RANGE, size), a == start) for a in range(start, size, RANGE)]
    todo = spark.createDataFrame(ranges, "file string, begin bigint, end bigint, first boolean").repartition(max(1, len(ranges)))
    lines = scratch.table(todo.mapInArrow(_lines, "file string, value string, at bigint, until bigint"), "tail")
    for r in lines.groupBy("file").agg(F.max("until").alias("until")).collect():
        kept[r["file"]] = r["until"]
    return lines, kept


def ingest_tail(spark: SparkSession, path: str, schema: str, keys: list[str], out: str, state_path: str) -> int:
    """Take what was appended since the last time as one batch; returns its number of records.

    The newest record per key of the batch is written below the batch's number, then offsets and
    number are stored together: a run that dies in between repeats the batch and replaces its output.
    Broken lines are skipped; ``upserted`` reads the result.
    """
    state = read_state(spark, state_path)
    scratch = Scratch(spark, "tail")
    lines, offsets = tail(spark, path, state.get("offsets", {}), scratch)
    rows = parse_tolerant(lines.select("value", "file", "at"), schema).where("not _bad")
    batch = state.get("batch", 0)
    target = f"{out}/batch={batch}"
    latest(rows, keys, ["file", "at"]).drop("_bad").write.mode("overwrite").parquet(target)
    n = spark.read.parquet(target).count()
    write_state(spark, state_path, {"offsets": offsets, "batch": batch + 1})
    return n


def upserted(spark: SparkSession, out: str, schema: str, keys: list[str]) -> DataFrame:
    """The newest record per key over all batches."""
    rows = spark.read.schema(f"file string, at bigint, {schema}, batch int").option("basePath", out).parquet(f"{out}/batch=*")
    return latest(rows, keys, ["batch", "file", "at"]).drop("batch", "file", "at")
