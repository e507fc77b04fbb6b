"""Inputs of the operators, derived from whole driver tables.

Every derivation exists as a DataFrame here and as a SQL view in `oracles`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed
from corpusgap.functions import text as tx
from corpusgap.operators.pairs import (
    attach_scores,
    domain_pairs,
    performance_drop,
    resolve_pairs,
)
from corpusgap.plans.feature_table import training_corpus
from corpusgap.runtime import shared_root, use_all_cores
from corpusgap.sources.tables import read_or_compute


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_all_cores(table(spark, sf_dir, "documents"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, split, doc_id, lang, text): sources as domains, every fifth block is test."""
    block = F.floor(F.col("doc_id") / 20).cast("bigint")
    return documents(spark, sf_dir).select(
        F.col("source").alias("domain"),
        F.when(block % 5 == 0, "test").otherwise("train").alias("split"),
        "doc_id", "lang", "text",
    )


def pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a summary: a benchmark text, a piece of itself, or none."""
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("_item"), F.col("text").alias("_item_text")
    )
    count = items.agg(F.count("*")).scalar()
    kind = F.col("doc_id") % 17
    return (
        corpus(spark, sf_dir).drop("lang")
        .withColumn("_item", F.col("doc_id") % count)
        .join(items, "_item", "left")
        .withColumn("summary", F.when(kind == 0, F.lit(None).cast("string"))
                    .when(kind == 1, F.substring("text", 1, 40)).otherwise(F.col("_item_text")))
        .select("domain", "split", "doc_id", "text", "summary")
    )


# Weights of the made-up per-document scores: (metric, factor, addend for tuned, modulus, base, unit)
SCORE_RULES = [
    ("rouge1", 37, 5, 61, 0, 97.0),
    ("rouge2", 23, 3, 37, 0, 97.0),
    ("rougeL", 29, 7, 53, 0, 97.0),
    ("bert_precision", 31, 4, 91, 0, 97.0),
    ("bert_recall", 17, 6, 93, 0, 97.0),
    ("bert_f1", 13, 2, 89, 0, 97.0),
    ("vocab_overlap", 41, 9, 101, 0, 0.97),
    ("Relevance", 19, 8, 41, 10, 9.7),
    ("Coherence", 43, 1, 41, 10, 9.7),
    ("Consistency", 47, 11, 41, 10, 9.7),
    ("Fluency", 53, 10, 21, 10, 9.7),
    ("fs_grounded", 59, 12, 97, 0, 97.0),
]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds, split, model, metrics): means of per-document scores that follow from n_chars.

    Tuned models have test scores only, and src7 has no tuned score.
    """
    docs = table(spark, sf_dir, "documents")
    block = F.floor(F.col("doc_id") / 20).cast("bigint")
    rows = docs.select(
        F.col("source").alias("ds"),
        F.when(block % 5 == 0, "test").otherwise("train").alias("split"),
        (F.col("n_chars") + F.length("source") * 7 + F.col("doc_id") % 20).alias("_x"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("_tuned"),
    ).where(~((F.col("_tuned") == 1) & ((F.col("split") == "train") | (F.col("ds") == "src7"))))
    means = [
        ((F.sum((F.col("_x") * a + F.col("_tuned") * b) % m + base) / F.count("*")) / unit).alias(name)
        for name, a, b, m, base, unit in SCORE_RULES
    ]
    return (
        rows.groupBy("ds", "split", "_tuned").agg(*means)
        .select("ds", "split", F.when(F.col("_tuned") == 1, "tuned").otherwise("base").alias("model"),
                *fixed.METRICS)
    )


def parse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a dependency parse: sentences end at . ! or ?, and the head of token k is
    token k / (2 + length % 3) of the same sentence, so token 0 is the root."""
    docs = corpus(spark, sf_dir).select("domain", "split", "doc_id", "text")
    sentences = docs.select(
        "domain", "split", "doc_id",
        F.posexplode(F.split("text", r"[.!?]+")).alias("sent_id", "_sentence"),
    )
    words = sentences.select(
        "domain", "split", "doc_id", "sent_id",
        F.posexplode(tx.tokens(F.col("_sentence"))).alias("i", "_word"),
    )
    head = F.floor(F.col("i") / (2 + F.length("_word") % 3)).cast("int")
    return words.select("domain", "split", "doc_id", "sent_id", "i", head.alias("head"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, split, doc_id, embedding): the vectors of documents, matched by id."""
    embeddings = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    return corpus(spark, sf_dir).select("domain", "split", "doc_id").join(embeddings, "doc_id")


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their label as the domain; label sizes differ, so pairs are cut."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("domain"),
        F.lit("test").alias("split"), F.col("vec_id").alias("doc_id"), "embedding",
    )


def line_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sources array<string>): the lines of every document as a list."""
    return documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("sources"))


def resolved_pairs(spark: SparkSession, sf_dir: str, tuned: bool = False) -> DataFrame:
    domains = table(spark, sf_dir, "documents").select(F.col("source").alias("domain")).distinct()
    return resolve_pairs(domain_pairs(domains), tuned)


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pair tables, zero-shot and tuned, with the scores of both sides and the drop."""
    sheet = scores(spark, sf_dir)
    both = resolved_pairs(spark, sf_dir, False).unionByName(resolved_pairs(spark, sf_dir, True))
    return performance_drop(attach_scores(both, sheet, fill="hash"), fixed.METRICS)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table of all pairs, stored once per application and data folder."""
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/features-{app}-{sf_dir.strip('/').replace('/', '-')}"
    return read_or_compute(spark, path, lambda: training_corpus(
        corpus(spark, sf_dir), vectors(spark, sf_dir), parse_tokens(spark, sf_dir),
        scores(spark, sf_dir), fill="hash",
    ))
