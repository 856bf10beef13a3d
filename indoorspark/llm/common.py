"""Shared folder, tables written between steps, ranks without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the session is local (tests) is a new folder made; a cluster without
    the setting is an error, as a machine-local folder would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: The folder of a `finished` table's steps while it is made.
_steps: ContextVar[str | None] = ContextVar("steps", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_steps.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make() stored; the tables that it stored on the way lie in a folder of their own, which goes once the result is written."""
    own = new_path(spark, f"{label}-steps")
    path, outer = new_path(spark, label), _steps.set(own)
    try:
        df = make()
        df.write.option("compression", "zstd").parquet(path)
    finally:
        _steps.reset(outer)
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to Python at once.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python in Arrow batches of about BATCH bytes, if it has no bound of its own.

    Spark's 10,000 rows or 64 MB are held several times over, off heap by the executor and in each of its workers; no
    result depends on where batches end.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[str], out: str, label: str) -> DataFrame:
    """Add `out`, the 0-based position of each row by `order` (nulls last), with no single-task sort.

    Rows are dealt by range; one count for each range (as many as shuffle partitions) goes to the
    driver. Ties get positions in an arbitrary order, so `order` should be unique.
    """
    spark = df.sparkSession
    by = [c for k in order for c in (F.col(k).isNull(), F.col(k))]
    dealt = stored(df.repartitionByRange(parts(spark), *by).withColumn("_range", F.spark_partition_id()), label)
    start, starts = 0, []
    for r in sorted(dealt.groupBy("_range").count().collect()):
        starts += [F.lit(r[0]), F.lit(start)]
        start += r[1]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by)).cast("long") - 1
    before = F.create_map(*starts)[F.col("_range")].cast("long") if starts else F.lit(0).cast("long")
    return dealt.withColumn(out, place + before).drop("_range")


def slots(df: DataFrame, group: str, order: list[Column], out: str, rows_each: int = 50_000) -> DataFrame:
    """Add `out`, a gapless 0-based number within `group`; a group is cut by the hash of the first of `order` into chunks.

    Only counts by (group, chunk) meet; no task sorts a whole group. `group` has no nulls; df must be deterministic.
    """
    spread = max(1, -(-df.count() // rows_each))
    cut = df.withColumn("_chunk", F.pmod(F.xxhash64(order[0]), F.lit(spread)).cast("int"))
    by = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(group, "_chunk", F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(*order)).cast("long") - 1
    left, right = cut.withColumn(out, inside), before.withColumnsRenamed({group: "_g", "_chunk": "_c"})
    on = (left[group] == right["_g"]) & (left["_chunk"] == right["_c"])
    return left.join(right, on).withColumn(out, F.col(out) + F.col("_before")).drop("_g", "_c", "_chunk", "_before")


def lookup(df: DataFrame, small: DataFrame, key: str, bound: int = 20_000) -> DataFrame:
    """Inner join on `key` (null equals null). `small` has one row a key.

    Up to `bound` keys it is broadcast; beyond, it is copied eight times and df is salted, so that
    a key with a third of the rows is dealt to eight tasks at least (and skewed joins are split).
    """
    right = small.withColumnRenamed(key, "_key")
    if small.count() <= bound:
        return df.join(F.broadcast(right), df[key].eqNullSafe(right["_key"])).drop("_key")
    n = 8
    left = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(n)))
    right = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_s"])).drop("_key", "_s", "_salt")


def components(edges: DataFrame, label: str, rounds: int | None = None) -> DataFrame:
    """Connected components of edges(a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star: each round hangs nodes below the least neighbour of their neighbours, so
    rounds grow with the logarithm of the longest path; they end when only stars are left. With `rounds`, no more are
    done, and a component may still be in some parts (each with a root of its own). Nodes come only from edges; the
    table is written after each step.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, done = stored(e, label), 0
    while True:
        low = stored(e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), label)
        below, tops = low.select(F.col("a").alias("b"), "m"), low.select(F.col("m").alias("b"))
        stars = low.where("n > 1").isEmpty() and tops.join(below.select("b"), "b", "left_semi").isEmpty()
        if stars or done == rounds:
            tops = tops.distinct().join(below.select("b"), "b", "left_anti")
            return low.select(F.col("a").alias("node"), F.col("m").alias("root")).unionByName(tops.select(F.col("b").alias("node"), F.col("b").alias("root")))
        large = e.join(below, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        pairs = F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))
        e = stored(small.select(F.explode(pairs).alias("p")).select("p.a", F.col("p.m").alias("b")).where("a <> b").distinct(), label)
        done += 1
