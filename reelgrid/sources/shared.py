"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_kept: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; in local mode, where it is unset, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="reelgrid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, written when it is first asked for and again when the files in sources have changed."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [fs(p) for p in sources]
    changed = tuple((str(p), p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()) for p in found)
    key = (spark.sparkContext.applicationId, name, changed)
    if key not in _kept:
        df = make()
        path = fresh(spark, name)
        df.write.parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders, as far as they are there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in map(path, paths):
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete what has been written, or what has been since there were so many tables: for when the results that read it have been stored."""
    gone = set(_made[since:])
    remove(spark, *gone)
    del _made[since:]
    for key in [k for k, p in _kept.items() if p in gone]:
        del _kept[key]
