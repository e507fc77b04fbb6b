"""Small helpers that every operator shares: size-checked broadcasts and shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A corpus collection may have this many (domain, split) groups before per-group tables are
# joined by shuffle and no longer by broadcast. One group row is well below 1 KB.
MAX_BROADCAST_GROUPS = 10_000
# The same for tables of corpus pairs, whose rows are below 500 bytes.
MAX_BROADCAST_PAIRS = 100_000


def few_groups(df: DataFrame, keys: list[str], limit: int = MAX_BROADCAST_GROUPS) -> bool:
    """True when df has at most `limit` distinct keys; reads the key columns only."""
    return df.select(*keys).distinct().limit(limit + 1).count() <= limit


def few_rows(df: DataFrame, limit: int = MAX_BROADCAST_PAIRS) -> bool:
    """True when df has at most `limit` rows. Meant for pinned tables, where counting is cheap."""
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, is_small: bool) -> DataFrame:
    """Broadcast a per-group table whose size was checked; leave the join to Spark otherwise."""
    return F.broadcast(df) if is_small else df


def use_all_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that has fewer splits than cores. Large inputs pass through unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def sized_for_fitting(df: DataFrame, rows: int, rows_per_task: int = 50_000) -> DataFrame:
    """Merge partitions that hold few rows. Iterative fits run many short jobs over the same
    rows, and a task per handful of rows only adds overhead; long tables keep their partitions."""
    return df.coalesce(-(-max(rows, 1) // rows_per_task))


def at_once(session: SparkSession, run: Callable, items: Iterable, threads: int = 8) -> list:
    """Results of run(item) in order, with several Spark jobs submitted at the same time."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(inheritable_thread_target(session)(run), items))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root.rstrip("/") if root else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pinned"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Everything later starts from that table: it is computed once however many readers it has,
    all of them see the same rows, and a lost executor does not bring its sources back.
    """
    path = shared_folder(df.sparkSession, "pinned")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
