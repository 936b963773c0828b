"""Intermediate tables in the folder that the driver and all executors share.

``stage`` cuts lineage: a lost executor rereads the written table instead of recomputing what led to it, several branches read it
without working it out again, and what follows is planned on its own. The folder is
the session's ``spark.checkpoint.dir``, or that of ``setCheckpointDir``; only a session on one machine may do without, and gets a temporary one.

A result may read its staged tables for as long as anybody holds it, so an operator deletes none but those that no result
of its own reads. Whoever has written a result out can delete what was staged for it: ``staged_tables`` collects the tables staged
in its block, and no others.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_collecting: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Raises where none is set and the session has more than this machine."""
    global _own_dir
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        own = tempfile.mkdtemp(prefix="quietwire-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dir = "file://" + own
    return _own_dir


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quietwire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for tables in _collecting:
        tables.append(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._quietwire_path = path
    return staged


@contextmanager
def staged_tables() -> Iterator[list[str]]:
    """Paths of the tables that are staged inside the block."""
    tables: list[str] = []
    _collecting.append(tables)
    try:
        yield tables
    finally:
        _collecting[:] = [x for x in _collecting if x is not tables]


def stage_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """Stage what ``make`` returns, and delete the tables that were staged on the way to it: the result reads none of them."""
    with staged_tables() as tables:
        df = make()
        on_the_way = list(tables)
        staged = stage(df)
    for path in on_the_way:
        delete(df.sparkSession, path)
    return staged


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        delete(df.sparkSession, df._quietwire_path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder; one that is gone already is no error."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
