"""Pairs of corpora: enumeration, the splits and models they stand for, and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed
from corpusgap.functions import stats

SCORE_KEYS = ["ds", "split", "model"]


def domains_of(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct domains of a score table; the first `limit` by name when given."""
    domains = scores.select(F.col("ds").alias("domain")).distinct()
    return domains if limit is None else domains.orderBy("domain").limit(limit)


def domain_pairs(domains: DataFrame, parts: int = 8) -> DataFrame:
    """(da_type, source, target): every domain with itself twice, and all ordered pairs.

    The ordered pairs are the result itself. They are made by an equi-join on the cells of a
    grid, parts x parts, so no side is broadcast and no Cartesian product is planned.
    """
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = F.pmod(F.xxhash64("domain"), F.lit(parts)).cast("int")
    sources = domains.select(F.col("domain").alias("source"), own.alias("row"),
                             everywhere.alias("column"))
    targets = domains.select(F.col("domain").alias("target"), own.alias("column"),
                             everywhere.alias("row"))
    crossed = sources.join(targets, ["row", "column"]).where(F.col("source") != F.col("target"))

    def kind(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("da_type"), "source", "target")

    itself = domains.select(F.col("domain").alias("source"), F.col("domain").alias("target"))
    return (
        kind(fixed.IN_DOMAIN, itself)
        .unionByName(kind(fixed.NO_DOMAIN, itself))
        .unionByName(kind(fixed.SINGLE_DOMAIN, crossed))
    )


def resolve_pairs(pairs: DataFrame, tuned: bool, base_model: str = "base",
                  tuned_model: str = "tuned") -> DataFrame:
    """Add text splits, score splits and models of both sides.

    Texts do not depend on fine-tuning. Fine-tuned scores exist for the test split only, and an
    in-domain pair compares the tuned model with the base model.
    """
    same = F.col("source") == F.col("target")
    in_domain = same & (F.col("da_type") == fixed.IN_DOMAIN)
    no_domain = same & (F.col("da_type") == fixed.NO_DOMAIN)
    with_texts = pairs.select(
        "da_type", "source", "target", F.lit(tuned).alias("ft"),
        F.when(in_domain | no_domain, "train").otherwise("test").alias("source_split"),
        F.when(no_domain, "train").otherwise("test").alias("target_split"),
    )
    if tuned:
        return with_texts.select(
            "*",
            F.lit("test").alias("source_score_split"),
            F.lit("test").alias("target_score_split"),
            F.lit(tuned_model).alias("source_model"),
            F.when(in_domain, base_model).otherwise(tuned_model).alias("target_model"),
        )
    return with_texts.select(
        "*",
        F.col("source_split").alias("source_score_split"),
        F.col("target_split").alias("target_score_split"),
        F.lit(base_model).alias("source_model"),
        F.lit(base_model).alias("target_model"),
    )


def metrics_of(scores: DataFrame) -> list[str]:
    return [c for c in scores.columns if c not in SCORE_KEYS]


def one_score_per_key(scores: DataFrame, order: str | None = None) -> DataFrame:
    """The first score row of every (ds, split, model) by `order`, or by all metrics."""
    metrics = [m for m in metrics_of(scores) if m != order]
    first = F.min_by(F.struct(*metrics), F.struct(order) if order else F.struct(*metrics))
    picked = scores.groupBy(*SCORE_KEYS).agg(first.alias("_first"))
    return picked.select(*SCORE_KEYS, *[F.col(f"_first.{m}").alias(m) for m in metrics])


def attach_scores(resolved: DataFrame, scores: DataFrame, fill: str | None = None,
                  order: str | None = None) -> DataFrame:
    """Scores of both sides as source_* and target_*, with flags for missing rows.

    Of several score rows of one key the first by `order` counts, a column that is no metric.

    A missing score stays null and is flagged. With fill="hash" it becomes a repeatable
    pseudo-random number in [0, 1), derived from side, key and metric.
    """
    metrics = [m for m in metrics_of(scores) if m != order]
    unique = one_score_per_key(scores, order)
    result = resolved
    for side in ("source", "target"):
        keys = {side: "ds", f"{side}_score_split": "split", f"{side}_model": "model"}
        renamed = unique.select(
            *[F.col(old).alias(new) for new, old in keys.items()],
            *[F.col(m).alias(f"{side}_{m}") for m in metrics],
            F.lit(True).alias(f"_{side}_found"),
        )
        result = result.join(renamed, list(keys), "left")
        found = F.col(f"_{side}_found").isNotNull()
        if fill == "hash":
            for m in metrics:
                key = F.concat_ws("|", F.lit(side), F.lit(m), *[F.col(k) for k in keys])
                filled = F.when(found, F.col(f"{side}_{m}")).otherwise(stats.unit_interval(key))
                result = result.withColumn(f"{side}_{m}", filled)
        result = result.withColumn(f"{side}_is_missing", ~found).drop(f"_{side}_found")
    return result


def performance_drop(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Add the mean score of either side and their difference, y_drop."""
    means = {
        f"weighted_y_{side}": stats.weighted_mean([F.col(f"{side}_{m}") for m in metrics])
        for side in ("source", "target")
    }
    return df.withColumns(means).withColumn(
        "y_drop", F.col("weighted_y_source") - F.col("weighted_y_target")
    )
