"""Paths on the file system Spark writes to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, also set as the checkpoint folder.

    In local mode a temporary folder stands in when the setting is absent;
    on a cluster that is an error, because executors could not see it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not named and not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        named = tempfile.mkdtemp(prefix="civicspark-")
    if not current:
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_BRIEF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go when each write ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_BRIEF, None)
    spark.conf.set(_BRIEF, "true")
    try:
        yield
    finally:
        spark.conf.unset(_BRIEF) if before is None else spark.conf.set(_BRIEF, before)


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def complete(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values V of the complete ``key=V`` folders below ``path``, ascending."""
    hadoop_path, fs = _path(spark, path)
    if not fs.exists(hadoop_path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
    found = [n.split("=", 1)[1] for n in names if n.startswith(f"{key}=")]
    return sorted(v for v in found if exists(spark, f"{path}/{key}={v}/_SUCCESS"))


def versions(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers N of the complete ``key=N`` folders below ``path``, ascending."""
    return sorted(map(int, complete(spark, path, key)))


def folders(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers N of the ``key=N`` folders below ``path``, ascending, complete or not."""
    hadoop_path, fs = _path(spark, path)
    if not fs.exists(hadoop_path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{key}="))


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more, such as one of :func:`run_dir`."""
    hadoop_path, fs = _path(spark, path)
    fs.delete(hadoop_path, True)


def make(spark: SparkSession, path: str) -> None:
    """A folder, if it is not there."""
    hadoop_path, fs = _path(spark, path)
    fs.mkdirs(hadoop_path)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file; one of the target's name goes."""
    hadoop_path, fs = _path(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.delete(to, False)
    if not fs.rename(hadoop_path, to):
        raise OSError(f"cannot rename {source} to {target}")
