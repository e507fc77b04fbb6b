"""The pair feature table: all pairs at once, from texts, vectors, parses and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed
from corpusgap.operators import distance, pairs, profile, syntax, tfidf
from corpusgap.runtime import pin


def all_distances(corpus: DataFrame, vectors: DataFrame, resolved: DataFrame,
                  top_terms: int = fixed.TOP_TERMS) -> DataFrame:
    """The seven distance columns for the text splits of all pairs; tf-idf overlap is that of the
    `top_terms` highest terms of each side."""
    terms = pin(profile.term_counts(corpus))
    few = profile.groups_fit(terms)
    return distance.pair_distances(terms, pin(tfidf.top_terms(corpus, few, top_terms)), vectors, resolved, few)


def join_features(resolved: DataFrame, distances: DataFrame, difficulty: DataFrame,
                  scores: DataFrame, fill: str | None = None, compat: bool = False,
                  score_order: str | None = None) -> DataFrame:
    """One feature row per resolved pair. Of several score rows of one key the first by the column
    `score_order` of `scores` counts.

    Difficulty is that of the target's test split. With compat the distances are taken with
    source and target exchanged and the names of the two mean scores are exchanged, as in
    tables made before this engine; y_drop is the same either way.
    """
    metrics = [m for m in pairs.metrics_of(scores) if m != score_order]
    hard = difficulty.where(F.col("split") == "test").select(
        F.col("domain").alias("target"), fixed.DIFFICULTY
    )
    if compat:
        distances = distances.select(
            F.col("target").alias("source"), F.col("source").alias("target"),
            "source_split", "target_split", *fixed.DISTANCES,
        )
    joined = (
        pairs.attach_scores(resolved, scores, fill, score_order)
        .join(distances, distance.PAIR, "left")
        .join(hard, "target", "left")
    )
    dropped = pairs.performance_drop(joined, metrics)
    means = ["weighted_y_source", "weighted_y_target"]
    renamed = dict(zip(means, reversed(means) if compat else means))
    return dropped.select(
        F.col("da_type").alias("da-type"), "source", "target", "ft", fixed.DIFFICULTY,
        *fixed.DISTANCES,
        *[f"{side}_{m}" for side in ("source", "target") for m in metrics],
        *[F.col(old).alias(new) for new, old in renamed.items()], "y_drop",
    )


def pair_features(corpus: DataFrame, vectors: DataFrame, parse: DataFrame, scores: DataFrame,
                  tuned: bool = False, base_model: str = "base", tuned_model: str = "tuned",
                  max_domains: int | None = None, fill: str | None = None,
                  compat: bool = False, top_terms: int = fixed.TOP_TERMS,
                  score_order: str | None = None) -> DataFrame:
    """Feature rows of all pairs of the domains in the score table."""
    resolved = pairs.resolve_pairs(
        pairs.domain_pairs(pairs.domains_of(scores, max_domains)), tuned, base_model, tuned_model
    )
    return join_features(resolved, all_distances(corpus, vectors, _both_ways(resolved, compat), top_terms),
                         syntax.learning_difficulty(parse), scores, fill, compat, score_order)


def _both_ways(resolved: DataFrame, compat: bool) -> DataFrame:
    if not compat:
        return resolved
    return resolved.select(
        F.col("target").alias("source"), F.col("source").alias("target"),
        "source_split", "target_split",
    )


def zero_shot_scores(scores: DataFrame, base_model: str = "base") -> DataFrame:
    return scores.where(F.col("model") == base_model)


def tuned_scores(scores: DataFrame, without: tuple[str, ...] = ("aclsum",)) -> DataFrame:
    """Test scores of all domains but those that were not fine-tuned on."""
    return scores.where((F.col("split") == "test") & ~F.col("ds").isin(*without))


def training_corpus(corpus: DataFrame, vectors: DataFrame, parse: DataFrame, scores: DataFrame,
                    base_model: str = "base", tuned_model: str = "tuned",
                    untuned_domains: tuple[str, ...] = ("aclsum",), fill: str | None = None,
                    compat: bool = False, top_terms: int = fixed.TOP_TERMS,
                    max_domains: int | None = None, score_order: str | None = None) -> DataFrame:
    """Zero-shot and fine-tuned feature rows in one table, of the first `max_domains` by name.

    Distances and difficulty do not depend on fine-tuning and are computed once, for the pairs of
    either kind.
    """
    parts = {
        False: zero_shot_scores(scores, base_model),
        True: tuned_scores(scores, untuned_domains),
    }
    resolved = {
        tuned: pin(pairs.resolve_pairs(pairs.domain_pairs(pairs.domains_of(part, max_domains)), tuned,
                                       base_model, tuned_model))
        for tuned, part in parts.items()
    }
    texts = [resolved[tuned].select(*distance.PAIR) for tuned in (False, True)]
    wanted = pin(texts[0].unionByName(texts[1]).distinct())
    distances = pin(all_distances(corpus, vectors, _both_ways(wanted, compat), top_terms))
    difficulty = pin(syntax.learning_difficulty(parse))
    tables = [
        join_features(resolved[tuned], distances, difficulty, parts[tuned], fill, compat, score_order)
        for tuned in (False, True)
    ]
    return tables[0].unionByName(tables[1], allowMissingColumns=True)
