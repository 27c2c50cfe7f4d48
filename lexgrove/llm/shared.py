"""Cutting lineage so that a lost executor costs a re-read, never the job."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a folder of our own is made if all run on this machine
    (tests); on a cluster that is an error, as executors don't share local folders."""
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if not have and now.isDefined():
        have = now.get()
    if not have:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="lexgrove-")
    if not now.isDefined():
        sc.setCheckpointDir(have)
    return have


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was made with fresh_path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df as rows in reliable storage: plans built on it start there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: folders of this session that hold what results are still to be read from
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder. The folder stays until sweep() or whoever owns the shared folder removes it."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def sweep(spark: SparkSession, since: int, keep: str) -> None:
    """Remove the folders that were made after the first `since`, except `keep`; nothing may be read from them any more."""
    for path in [p for p in _made[since:] if p != keep]:
        remove(spark, path)
        _made.remove(path)


def made() -> int:
    return len(_made)


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of an address or local path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def bounded(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` of rows(doc_id, .., text), chosen by a hash of id and text; what it sorts is bounded in each task."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", F.xxhash64("text"), "text").limit(most)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
