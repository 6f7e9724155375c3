"""Lineage cuts: tables written to the shared checkpoint folder.

Iterative operators write every round to a Parquet table below the folder named by
``spark.checkpoint.dir`` and read it back. The files live on storage that all executors share,
so a lost executor costs nothing that was finished, and the reader gets column pruning and real
sizes (AQE and the planner then choose broadcast or shuffle from facts, not guesses).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; where it is unset, a local one is set in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spanloom-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        return checkpoint_root(spark)
    return root


_ALL: list["Scratch"] = []


def clear() -> int:
    """Remove the tables of all operators run so far; call it once their results are written.

    Results are lazy and read these tables, so a result that is still needed must be written first.
    What is not cleared goes when the process ends.
    """
    n = len(_ALL)
    while _ALL:
        s = _ALL.pop()
        s._remove(s.base)
    return n


class Scratch:
    """A private folder of intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark).rstrip('/')}/spanloom/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _ALL.append(self)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Run ``df`` once, keep its rows as a table, return a reader of that table."""
        self._n += 1
        path = f"{self.base}/{name}-{self._n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._spanloom_path = path
        return out

    def counted(self, df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
        """``table`` and its number of rows, observed while it is written."""
        seen = Observation()
        out = self.table(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"]

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that no later step reads."""
        path = getattr(df, "_spanloom_path", None)
        if path:
            self._remove(path)

    def remove(self, name: str) -> None:
        """Remove what was written below the folder under a name of its own."""
        self._remove(f"{self.base}/{name}")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            hpath = jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
        except Exception:
            pass


atexit.register(clear)
