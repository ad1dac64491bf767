"""Where intermediate tables go, and how they are cut from their lineage."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    # Reached only where the session names no shared folder, as in a bare local run.
    return tempfile.mkdtemp(prefix="moltable-")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
    return _own_folder()


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, below the shared folder, in one folder per application."""
    return f"{shared_folder(spark)}/moltable/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as ``open`` takes it, if it lies on a disk that Spark reaches by files; None in any other store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toUri().getPath() if system.getUri().getScheme() == "file" else None


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the scan of it.

    Used where a result is read several times or must not change between reads: the rows on
    disk survive the loss of an executor, and later scans still prune columns and push filters.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def committed(spark: SparkSession, path: str) -> Iterator[str]:
    """A new path beside ``path`` to write to; it becomes ``path`` by one rename when the block ends.

    Until then ``path`` does not exist, so no reader sees a part of a result. If the block fails, what it has written is
    removed. An existing ``path`` is an error.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, draft = files.Path(path), f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    try:
        yield draft
        if not system.rename(files.Path(draft), target):
            raise OSError(f"cannot rename {draft!r} to {path!r}")
    except BaseException:
        system.delete(files.Path(draft), True)
        raise
