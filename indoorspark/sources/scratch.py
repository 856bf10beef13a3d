"""Folders that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of the steps that are under way, the innermost last.
_steps: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("steps", default=())


@contextlib.contextmanager
def steps(spark: SparkSession, label: str):
    """What is kept inside lies in a folder of its own, which goes at the end: only results (`kept` with result) stay."""
    own = scratch(spark, label)
    token = _steps.set((*_steps.get(), own))
    try:
        yield
    finally:
        _steps.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession, label: str, result: bool = False) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, which must be set on a cluster, or in that of the steps under way (a
    result: in the one around them)."""
    inside = _steps.get()[: -1 if result else None]
    if inside:
        return f"{inside[-1]}/{label}-{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by columns for helpers in Python: by a stated number of tasks, as Spark would merge those of few bytes, however
    long each of their rows takes. Groups by these columns need no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def kept(df: DataFrame, label: str, result: bool = False) -> DataFrame:
    """df written as a table and read again: what several steps use is worked out once, and survives lost executors."""
    path = scratch(df.sparkSession, label, result)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
