"""Line-delimited JSON: tolerant readers, latest records, writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CORPUS_LABEL, DROP_CAUSE


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``value, file, at``: lines with their file and a position that rises within each file."""
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``value, file, line``: lines with their physical number, from 0 over all files in order of their names.

    Files are read in blocks in any order: the blocks' line counts, one row each, are added up, and a
    line's place in its block gives the rest, so nothing is sorted or brought into one task.
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # one row per block of all files
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("file").alias("b_file"), F.col("block").alias("b_block"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    j = rows.join(starts, (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    return j.select("value", "file", (F.col("before") + F.col("at") - F.col("first")).alias("line"))


def numbered(df: DataFrame, order: Sequence[str], name: str, scratch) -> DataFrame:
    """``df`` with ``name``: its row numbers from 1 in ``order`` (make it total), without one task that sees all rows."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = scratch.table(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(counts.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before")))  # one row per task
    j = rows.join(starts, part == F.col("_p"))
    return j.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_p", 33) + 1).drop("_at", "_p", "_before")


def parse_tolerant(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed records with ``_bad``: NUL characters are dropped, blank lines skipped, broken ones flagged."""
    clean = F.trim(F.replace("value", F.lit("\0"), F.lit("")))
    rows = lines.withColumn("value", clean).where("value <> ''")
    parsed = rows.withColumn("_j", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    return parsed.select("file", "at", "_j.*").withColumn("_bad", F.col("_corrupt").isNotNull()).drop("_corrupt")


def load_pairs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Flat pair rows of corpus label files: ``comment_id, ts, emotion, cause, intensity, sarcasm``.

    Broken lines, a cut last line and records without time are left out; interpersonal causes too,
    a null cause stays. A null intensity is 0, a null sarcasm false. Repeated records stay.
    """
    return flat_pairs(parse_tolerant(read_lines(spark, paths), CORPUS_LABEL))


def flat_pairs(records: DataFrame) -> DataFrame:
    """The pair rows of parsed label records."""
    rows = records.where("not _bad and created_utc is not null")
    p = rows.select("comment_id", F.col("created_utc").alias("ts"), F.explode("pairs").alias("p"))
    p = p.where(F.coalesce("p.cause_category", F.lit("")) != DROP_CAUSE)
    return p.select("comment_id", "ts", "p.emotion", F.col("p.cause_category").alias("cause"), F.coalesce("p.intensity", F.lit(0.0)).alias("intensity"), F.coalesce("p.sarcasm", F.lit(False)).alias("sarcasm"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in ``order``; make the order total."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; nulls are written too, so readers see every field."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
