"""Getting the library to the executors, and ending lineage in storage that they share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library's modules to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="lexgrove-zip-"), "lexgrove.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, Path("lexgrove") / p.relative_to(root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """df as rows in the folder of spark.checkpoint.dir."""
    shared(df.sparkSession)
    return df.checkpoint()


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset one of our own if all run on this machine (tests); on a
    cluster that is an error."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    have = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="lexgrove-")
    sc.setCheckpointDir(have)
    return have


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was made with fresh."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def exists(path: str) -> bool:
    fs, at = _located(path)
    return fs.get_file_info(at).type != pyarrow.fs.FileType.NotFound


def opened(path: str) -> pyarrow.NativeFile:
    """A file of the shared folder to read in a task."""
    fs, at = _located(path)
    return fs.open_input_file(at)


@contextmanager
def written(path: str) -> Iterator[pyarrow.NativeFile]:
    """A file of the shared folder to write in a task. It gets its name when it is whole; of attempts that write the same any may be the last."""
    fs, at = _located(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as f:
        yield f
    try:
        fs.move(own, at)
    except OSError:  # file systems that replace nothing
        if not exists(path):
            raise
        fs.delete_file(own)


def ranked(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with the place of each row in the given order, from `start`; rows that tie have places next to one another.

    Rows are sorted by ranges; a place is the one in its range plus the rows in earlier ranges, so that no task has them all."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the row below
    placed = parts.withColumn("__part", F.shiftright(at, 33)).withColumn("__row", at.bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = placed.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    both = placed.join(F.broadcast(starts), "__part")  # a row for each partition
    return both.withColumn(name, F.col("__start") + F.col("__row") + start).drop("__part", "__row", "__start")


def cut_plan(df: DataFrame) -> DataFrame:
    """As cut, and without the plan's size estimates, which multiply at each join of a loop until they fill the driver."""
    spark, jdf = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)
