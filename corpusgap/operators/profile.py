"""Profile of a corpus: terms, their probabilities, entropy and sizes.

A corpus collection is a DataFrame (domain, split, doc_id, text). Terms are counted before
anything is joined, so a term has at most one row per (domain, split) from then on and very
frequent terms cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed
from corpusgap.functions import text as tx
from corpusgap.runtime import few_groups, small_side

GROUP = ["domain", "split"]


def term_counts(corpus: DataFrame, stop_words=fixed.ENGLISH_STOP_WORDS,
                marks=fixed.SPECIAL_TOKENS) -> DataFrame:
    """(domain, split, term, n). The map side combines the counts before the shuffle.

    Whoever reads the counts several times should `pin` them first, or texts are tokenized
    once per reader.
    """
    return (
        corpus.select(*GROUP, F.explode(tx.tokens(F.col("text"))).alias("term"))
        .where(tx.is_term(F.col("term"), stop_words, marks))
        .groupBy(*GROUP, "term")
        .agg(F.count("*").alias("n"))
    )


def group_totals(terms: DataFrame) -> DataFrame:
    """One row per (domain, split) with all sums that later formulas need.

    With p = n / word_count: plogp is the sum of p ln p, logp the sum of ln p.
    """
    log_n = F.ln(F.col("n").cast("double"))
    sums = terms.groupBy(*GROUP).agg(
        F.sum("n").alias("word_count"),
        F.count("*").alias("vocab_size"),
        F.sum(F.col("n") * log_n).alias("_nlogn"),
        F.sum(log_n).alias("_logn"),
    )
    log_total = F.ln(F.col("word_count").cast("double"))
    return sums.select(
        *GROUP, "word_count", "vocab_size",
        (F.col("_nlogn") / F.col("word_count") - log_total).alias("plogp"),
        (F.col("_logn") - F.col("vocab_size") * log_total).alias("logp"),
    )


def term_probability(terms: DataFrame, groups_are_few: bool) -> DataFrame:
    """(domain, split, term, n, p) with p the share of the term in its group."""
    totals = terms.groupBy(*GROUP).agg(F.sum("n").alias("_total"))
    return terms.join(small_side(totals, groups_are_few), GROUP).select(
        *GROUP, "term", "n", (F.col("n") / F.col("_total")).alias("p")
    )


def shannon_entropy(terms: DataFrame) -> DataFrame:
    """(domain, split, shannon_entropy), natural logarithm."""
    return group_totals(terms).select(*GROUP, (-F.col("plogp")).alias("shannon_entropy"))


def domain_profile(corpus: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Documents, kept tokens, distinct terms and entropy of every (domain, split).

    A group without any term stays in the result with zeros.
    """
    terms = term_counts(corpus) if terms is None else terms
    sizes = corpus.groupBy(*GROUP).agg(F.count("*").alias("dataset_size"))
    totals = group_totals(terms)
    zero = F.lit(0).cast("bigint")
    return sizes.join(totals, GROUP, "left").select(
        *GROUP,
        "dataset_size",
        F.coalesce("word_count", zero).alias("word_count"),
        F.coalesce("vocab_size", zero).alias("vocab_size"),
        F.coalesce(-F.col("plogp"), F.lit(0.0)).alias("shannon_entropy"),
    )


def profile_text(profile: DataFrame) -> DataFrame:
    """One readable line per (domain, split)."""
    return profile.select(
        *GROUP,
        F.format_string(
            "Dataset: %s (%s), documents: %d, words: %d",
            "domain", "split", "dataset_size", "word_count",
        ).alias("summary"),
    )


def groups_fit(corpus: DataFrame) -> bool:
    """Whether per-group tables of this corpus collection may be broadcast."""
    return few_groups(corpus, GROUP)
