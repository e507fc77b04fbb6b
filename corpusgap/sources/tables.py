"""Reading and writing of score sheets, feature tables, result tables and corpora."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpusgap.functions import fixed_values as fixed
from corpusgap.runtime import file_system


def score_schema(metrics: list[str] = fixed.METRICS) -> T.StructType:
    keys = [T.StructField(k, T.StringType()) for k in ("ds", "split", "model")]
    return T.StructType(keys + [T.StructField(m, T.DoubleType()) for m in metrics])


def read_scores(spark: SparkSession, path: str, file_format: str = "csv",
                metrics: list[str] = fixed.METRICS) -> DataFrame:
    """Score sheet with declared types: ds, split, model and one double per metric.

    Columns are matched by header name, not by position.
    """
    if file_format == "csv":
        raw = spark.read.option("header", True).csv(path)
        return raw.select(*[raw[f.name].cast(f.dataType) for f in score_schema(metrics)])
    return spark.read.format(file_format).schema(score_schema(metrics)).load(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    (
        df.write.mode(mode).option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: tuple[str, ...] = ()) -> str:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return path


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Publish a corpus with one folder per split."""
    return write_parquet(df, path, mode, ("split",))


def run_folder(root: str, run_id: str, name: str) -> str:
    """Output folder of one run; the caller names the run, for example by its start time."""
    return f"{root.rstrip('/')}/{run_id}/{name}"


def read_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored table, or the computed one after it was stored.

    Only a finished table counts as stored: it is written beside `path` and renamed, and a folder
    without the writer's success mark is taken for the remains of an interrupted write.
    """
    fs, where = file_system(spark, path)
    done = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not fs.exists(done):
        beside = path.rstrip("/") + f".{uuid.uuid4().hex}"
        write_parquet(compute(), beside)
        if fs.exists(where):
            fs.delete(where, True)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), where):
            raise OSError(f"could not rename {beside} to {path}")
    return spark.read.parquet(path)
