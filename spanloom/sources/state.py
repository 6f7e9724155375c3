"""Small states of resumable readers: one JSON file each, replaced as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hpath, spark.sparkContext._jsc.hadoopConfiguration()


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """Replace the state at ``path``: written beside it first, then renamed over it, so a reader sees the old or the new one."""
    jvm, target, conf = _path(spark, path)
    fs = target.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(target.getParent())
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    gateway = spark.sparkContext._gateway
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
    context.rename(fs.makeQualified(aside), fs.makeQualified(target), how)


def read_state(spark: SparkSession, path: str) -> dict:
    """The state at ``path``; empty if there is none."""
    _, target, conf = _path(spark, path)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        return {}
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0][0]) if rows else {}


def file_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Files at or directly below ``path`` with their sizes; hidden ones and markers are left out."""
    jvm, target, conf = _path(spark, path)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        return {}
    found = [(s.getPath(), s) for s in fs.listStatus(target)]
    return {p.toString(): s.getLen() for p, s in found if s.isFile() and not p.getName().startswith(("_", "."))}
