"""Tables as folders of a file system that Spark reads, put in place by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quietwire.sources.staging import delete

__all__ = ["append", "delete", "listed", "replace"]


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def listed(spark: SparkSession, path: str) -> list[str]:
    """Folders in a folder, by name; none if it is not there."""
    files, folder = _path(spark, path)
    if not files.exists(folder):
        return []
    return sorted(str(x.getPath().toString()) for x in files.listStatus(folder) if x.isDirectory())


def _put(spark: SparkSession, df: DataFrame, path: str, instead: bool = False) -> None:
    parent, name = path.rsplit("/", 1)
    hidden = f"{parent}/.{name}-{uuid.uuid4().hex}"  # readers pass over names that begin with a dot
    df.write.parquet(hidden)
    if instead:
        delete(spark, path)
    files, source = _path(spark, hidden)
    if not files.rename(source, _path(spark, path)[1]):
        delete(spark, hidden)
        raise OSError(f"{path} could not be put in place")


def replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write ``df`` as the folder ``path``; what was there goes once the new one has been written beside it."""
    _put(spark, df, path, instead=True)


def append(spark: SparkSession, df: DataFrame, path: str) -> str:
    """Add the rows of ``df`` to the table of folders ``path`` as one more folder: all of them, or after a failure none. Returns the folder."""
    added = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}"
    _put(spark, df, added)
    return added
