"""The latest save of each project, kept current from a stream of save events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from indoorspark.operators.projects import latest_projects


def stream_latest(saves: DataFrame, snapshot: str, checkpoint: str, available_now: bool = True, buckets: int = 32) -> StreamingQuery:
    """Projects are dealt into buckets by hash. Each batch unites its rows with the last version of the buckets they fall in and
    writes those anew, as `{snapshot}/batch=N/_bucket=B`; the others stay as they are.

    Late saves lose by their time, so there is no watermark. A batch that runs again writes the same folder from the
    versions before it, which are kept until the next batch, so a lost executor or driver repeats no work wrongly.
    """
    spark = saves.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        bucket = F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        if not touched:
            return
        before = read_snapshot(spark, snapshot, n, touched)
        both = batch if before is None else batch.unionByName(before)
        latest_projects(both).withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{snapshot}/batch={n}")
        for old in _versions(spark, snapshot).values():
            for past in sorted(x for x in old if x < n)[:-1]:
                _path(spark, snapshot).getFileSystem(spark._jsc.hadoopConfiguration()).delete(_path(spark, old[past]), True)

    writer = saves.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _versions(spark: SparkSession, snapshot: str) -> dict[int, dict[int, str]]:
    """bucket -> batch -> folder, of batches that ended."""
    files, found = _path(spark, snapshot).getFileSystem(spark._jsc.hadoopConfiguration()), {}
    names = lambda folder: [s.getPath().getName() for s in files.listStatus(_path(spark, folder))] if files.exists(_path(spark, folder)) else []
    for batch in (x for x in names(snapshot) if x.startswith("batch=")):
        inside = names(f"{snapshot}/{batch}")
        if "_SUCCESS" in inside:
            for b in (x for x in inside if x.startswith("_bucket=")):
                found.setdefault(int(b.split("=")[1]), {})[int(batch.split("=")[1])] = f"{snapshot}/{batch}/{b}"
    return found


def read_snapshot(spark: SparkSession, snapshot: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest version of each bucket (of these, of earlier batches); None if there is none."""
    newest = []
    for bucket, versions in _versions(spark, snapshot).items():
        done = [n for n in versions if before is None or n < before]
        if done and (buckets is None or bucket in buckets):
            newest.append(versions[max(done)])
    return spark.read.parquet(*newest) if newest else None
