"""Written tables that cut lineage: a lost executor then costs no recomputation of what came before."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: spark.checkpoint.dir where it is set.

    Where it is unset, a local session uses a folder under the temp folder and any other session its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return f"file://{os.path.join(tempfile.gettempdir(), 'helixframe')}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_helixframe"


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; Spark's driver deletes it when the application ends."""
    path = f"{shared_dir(spark)}/helixframe-{kind}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


class _Written(threading.local):
    """The tables that a thread has stashed, in their order."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread stashed inside the block when it ends without an error. What is to last must have been
    written elsewhere by then: nothing that is still to be computed may read them."""
    start = len(_written.paths)
    yield
    jvm = spark.sparkContext._jvm
    for path in _written.paths[start:]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _written.paths[start:]


def unstash(df: DataFrame) -> None:
    """Delete the table that df, as stash() returned it, reads; nothing may be computed from it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, kind: str = "stash") -> DataFrame:
    """Write df to the shared folder and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    _written.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
