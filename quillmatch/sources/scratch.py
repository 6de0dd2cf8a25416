"""Tables that a plan is cut at: written to the folder that driver and executors share, and removed when the application ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster session an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed at the end of the application."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once, as a Parquet table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(spark: SparkSession, path: str) -> tuple:
    """A path of whatever store, with the file system that has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    place, store = _placed(spark, path)
    store.delete(place, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """Makes a folder if it is not there."""
    place, store = _placed(spark, path)
    store.mkdirs(place)


@atexit.register
def _sweep() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except (Py4JError, OSError):  # the engine has ended before
            return
