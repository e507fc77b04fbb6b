"""Corpus scans: Parquet or another format by spec, or CSV files by split."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgap.operators import ingest
from corpusgap.sources.specs import CORPORA, CorpusSpec, corpus_spec

MAX_FILES = 1_000_000

CANONICAL = ["domain", "split", "doc_id", "text", "summary"]


def scan(spark: SparkSession, spec: CorpusSpec, root: str) -> DataFrame:
    """Raw rows of a corpus with all its splits; split is a partition column of the folder."""
    return spark.read.format(spec.file_format).load(f"{root.rstrip('/')}/{spec.path}")


def scan_csv(spark: SparkSession, data_files, schema: T.StructType | str | None = None,
             quoted_breaks: bool = True) -> DataFrame:
    """CSV rows with a header. Files are one path or a list (split 'train'), or a map from split
    to path or list. Without a schema every column is a string. With `quoted_breaks` fields may
    hold line breaks, and a file is one task; without, large files are split."""
    if not isinstance(data_files, dict):
        data_files = {"train": data_files}
    reader = spark.read.option("header", True).option("multiLine", quoted_breaks).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    parts = [
        reader.csv(paths if isinstance(paths, str) else list(paths)).withColumn("split", F.lit(split))
        for split, paths in data_files.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_doc_id(df: DataFrame) -> DataFrame:
    """Give the rows of a scan without doc_id one: the number of their file in the order of paths,
    then the number of the row in its file. Ids are unique, the same on every run, and in file
    order. Where the format's scan does not number its rows (CSV), ids count the rows of the scan's
    tasks: unique, and the same as long as the files and the split size are."""
    if "doc_id" in df.columns:
        return df
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return df.withColumn("doc_id", F.monotonically_increasing_id())
    paths = sorted(r["_file"] for r in placed.select("_file").distinct().limit(MAX_FILES + 1).collect())
    if len(paths) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files")
    files = df.sparkSession.createDataFrame(list(enumerate(paths)), "_number bigint, _file string")
    numbered = placed.join(F.broadcast(files), "_file")  # MAX_FILES rows at most
    return numbered.withColumn("doc_id", F.shiftleft("_number", 40) + F.col("_row")).drop("_file", "_row", "_number")


def canonical(raw: DataFrame, spec: CorpusSpec, preview: bool = False, preview_size: int = 4,
              samples: int | str = "max", min_input_size: int = 0) -> DataFrame:
    """(domain, split, doc_id, text, summary) of admissible rows.

    Caps come before the filter: a capped train split may end up smaller than its cap.
    """
    df = with_doc_id(raw).withColumn("domain", F.lit(spec.name))
    if spec.list_field:
        df = ingest.combine_list_field(df, spec.list_field)
    if spec.summary_parts:
        df = ingest.combine_columns(df, list(spec.summary_parts), "summary")
    df = ingest.preview(df, preview_size) if preview else ingest.cap_train(df, samples)
    df = ingest.rename_columns(df, spec.columns)
    df = ingest.drop_columns(df, spec.dropped)
    if spec.preprocess is not None:
        df = df.transform(spec.preprocess)
    ingest.require_columns(df, CANONICAL)
    return ingest.admissible(df, min_input_size).select(*CANONICAL)


def load_corpus(spark: SparkSession, name: str, root: str | None = None, *,
                preview: bool = False, samples: int | str = "max", min_input_size: int = 0,
                data_files=None, schema=None,
                specs: dict[str, CorpusSpec] = CORPORA) -> DataFrame:
    """One registered corpus, from its folder below `root` or from CSV `data_files`."""
    spec = corpus_spec(name, specs)
    if data_files is not None:
        raw = scan_csv(spark, data_files, schema)
    elif root is not None:
        raw = scan(spark, spec, root)
    else:
        raise ValueError("give root or data_files")
    return canonical(raw, spec, preview=preview, samples=samples, min_input_size=min_input_size)


def load_corpora(spark: SparkSession, names: list[str], root: str, **options) -> DataFrame:
    """Several corpora as one collection."""
    return reduce(DataFrame.unionByName, [load_corpus(spark, n, root, **options) for n in names])
