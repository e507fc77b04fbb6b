"""A corpus pipeline: toxic documents go, near copies go, benchmark passages go, sources are mixed, tokens are written.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. `run` writes each stage's result to the shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgap.llm import decontamination, jaccard_join, mixing, token_shards, toxicity
from corpusgap.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat(docs, mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left, in training order."""
    return token_shards.write_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token shards", write_tokens),
]

# Learned scores, hashes and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    previous = None
    for _, stage in STAGES:
        written = scratch.put(stage(spark, docs, sf_dir))
        if previous is not None:
            scratch.drop(previous)
        docs = previous = written
    return docs
