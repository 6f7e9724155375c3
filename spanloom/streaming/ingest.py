"""Resumable ingest with Structured Streaming: replay of an archive, keyed upserts, batched labelling.

File positions, seen identifiers and finished batches live in the stream's checkpoint; sinks are keyed
by batch id, so a batch that is run again overwrites its own output and nothing appears twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import Scratch


def run_to_end(writer, checkpoint: str) -> None:
    """Process everything that is there and stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def replay(spark: SparkSession, path: str, schema, id_col: str) -> DataFrame:
    """Each id of an archive once, however late or often it comes: pages that overlap at a boundary second repeat ids.

    No watermark, so no late row is lost and no state of ids is held: every micro-batch leaves out the
    ids that earlier batches wrote, read from their one column. Rows with a null id are left out.
    """
    scratch = Scratch(spark, "replay")
    stream = spark.readStream.schema(schema).parquet(path)
    out = f"{scratch.base}/out"
    written = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = batch.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        if batch_id:
            seen = spark.read.schema(written).parquet(out).where(F.col("batch") < batch_id).select(F.col(id_col).alias("_seen"))
            new = new.join(seen, F.col(id_col) == F.col("_seen"), "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_to_end(stream.writeStream.foreachBatch(sink), f"{scratch.base}/checkpoint")
    return spark.read.schema(written).parquet(out).drop("batch")


def upsert(spark: SparkSession, stream: DataFrame, keys: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """The newest row per key of a stream.

    Every micro-batch writes its own newest rows below its batch id; reading takes the newest over
    all batches. Repeating a batch after a failure replaces what it wrote.
    """
    out = f"{scratch.base}/upserts"

    def newest(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
        return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def sink(batch: DataFrame, batch_id: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_to_end(stream.writeStream.foreachBatch(sink), f"{scratch.base}/upserts-checkpoint")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return newest(spark.read.schema(f"{schema}, batch bigint").parquet(out)).drop("batch")


def bisect(rows: list, call: Callable[[list], list]) -> list:
    """Results of a batch call; a batch that fails is halved until single rows fail, which give None."""
    try:
        return call(rows)
    except Exception:
        if len(rows) == 1:
            return [None]
        mid = len(rows) // 2
        return bisect(rows[:mid], call) + bisect(rows[mid:], call)


def label_batches(df: DataFrame, call: Callable[[list[str]], list[str]], key: str, text: str, size: int = 256) -> DataFrame:
    """``key, output, error``: a model called on batches of texts; a bad text costs only itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), size):
                part = f.iloc[at : at + size]
                out = bisect(part[text].tolist(), call)
                yield pd.DataFrame({key: part[key].to_numpy(), "output": out, "error": [None if o is not None else "failed" for o in out]})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, output string, error string")


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result without an error yet."""
    ok = done.where("error is null").select(F.col(key).alias("_k")).distinct()
    return df.join(ok, F.col(key) == F.col("_k"), "left_anti")
