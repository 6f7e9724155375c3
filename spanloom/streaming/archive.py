"""Resumable ingest of an archive that is read in order of time, with a cursor of seconds.

A page holds what the archive shows from the cursor's second on. That second is read again on purpose,
since it may have been cut at the end of the page before; the ids already taken at it (the boundary
ids) are left out. The cursor moves to the newest second of the page, and a page without anything new
ends the ingest. A page is one job over the rows behind the cursor, whose filter reaches the scan.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.state import read_state, write_state


@dataclass(frozen=True)
class Cursor:
    """Where an ingest stands; ``boundary`` are the ids taken at second ``after``."""

    after: int = 0
    boundary: tuple = ()
    total: int = 0
    pages: int = 0
    complete: bool = False


def load_cursor(spark: SparkSession, path: str, start: int = 0) -> Cursor:
    """The stored cursor, or a new one; it begins at ``start`` at least."""
    state = read_state(spark, path)
    state["boundary"] = tuple(state.get("boundary", ()))
    c = Cursor(**state)
    return Cursor(start) if c.after < start else c


def next_page(archive: DataFrame, cursor: Cursor, out: str, id_col: str, ts_col: str, most: int | None = None) -> Cursor:
    """Write what is new behind ``cursor`` below the page's number and return the cursor behind it.

    Rows without id or time, and rows older than the cursor, are left out. With ``most`` a page has at
    most that many rows, the oldest ones. A page that is repeated after a failure replaces itself.
    """
    spark = archive.sparkSession
    rows = archive.where(F.col(id_col).isNotNull() & (F.col(ts_col) >= cursor.after))
    if cursor.boundary:
        rows = rows.where((F.col(ts_col) > cursor.after) | ~F.col(id_col).isin(list(cursor.boundary)))
    if most is not None:
        rows = rows.orderBy(ts_col, id_col).limit(most)
    path = f"{out}/page={cursor.pages}"
    rows.write.mode("overwrite").parquet(path)
    page = spark.read.schema(rows.schema).parquet(path)
    seen = page.agg(F.count(F.lit(1)).alias("n"), F.max(ts_col).alias("last")).first()
    if not seen["n"]:
        return Cursor(cursor.after, cursor.boundary, cursor.total, cursor.pages, True)
    last = seen["last"]
    # the ids of one second
    ids = [r[0] for r in page.where(F.col(ts_col) == last).select(id_col).distinct().collect()]
    boundary = sorted({*cursor.boundary, *ids} if last == cursor.after else ids)
    return Cursor(last, tuple(boundary), cursor.total + seen["n"], cursor.pages + 1)


def ingest(archive: DataFrame, state_path: str, out: str, id_col: str, ts_col: str, *, start: int = 0, most: int | None = None, pages: int | None = None) -> Cursor:
    """Take pages until one brings nothing new, or ``pages`` of them; the cursor is stored after each.

    A complete ingest is left alone; remove its state to begin again.
    """
    spark = archive.sparkSession
    cursor = load_cursor(spark, state_path, start)
    done = 0
    while not cursor.complete and (pages is None or done < pages):
        cursor = next_page(archive, cursor, out, id_col, ts_col, most)
        write_state(spark, state_path, asdict(cursor))
        done += 1
    return cursor


def ingested(spark: SparkSession, out: str, schema) -> DataFrame:
    """All pages taken so far."""
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/page=*")
