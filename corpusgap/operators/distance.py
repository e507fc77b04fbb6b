"""Distances between corpora for a list of pairs.

Pairs are rows (source, source_split, target, target_split). All pairs are computed together
from one pinned table of term counts. A term has at most one row per (domain, split); these are
gathered into one row per term, bounded by the number of corpora and not by their size. Wanted pairs
are made inside that row and summed up in the task that makes them: there is no join on terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgap.functions.fixed_values import EPSILON
from corpusgap.operators.profile import GROUP, group_totals, term_probability
from corpusgap.operators.ranking import exact_rank
from corpusgap.runtime import few_rows, pin, small_side

PAIR = ["source", "source_split", "target", "target_split"]


def _numbered(groups: DataFrame) -> DataFrame:
    """Give every (domain, split) a small integer. There is one row per corpus, not per text."""
    return pin(groups.withColumn("gid", F.row_number().over(Window.orderBy(*GROUP))))


def _with_groups(pairs: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Attach the group rows of both sides as s_* and t_*; a missing group gives nulls."""
    def side(prefix: str, name: str) -> DataFrame:
        keys = [F.col("domain").alias(name), F.col("split").alias(f"{name}_split")]
        rest = [F.col(c).alias(f"{prefix}_{c}") for c in groups.columns if c not in GROUP]
        return small_side(groups.select(*keys, *rest), few)

    return (
        pairs.select(*PAIR).distinct()
        .join(side("s", "source"), ["source", "source_split"], "left")
        .join(side("t", "target"), ["target", "target_split"], "left")
    )


def _listed(wanted: DataFrame) -> tuple[DataFrame, bool]:
    """a_gid, partners: the higher numbers that each group is wanted with, in either direction;
    and whether the pairs were counted to be few."""
    few_pairs = few_rows(wanted)
    lower, upper = F.least("s_gid", "t_gid"), F.greatest("s_gid", "t_gid")
    listed = wanted.where(F.col("s_gid") != F.col("t_gid")).groupBy(lower.alias("a_gid")).agg(
        F.sort_array(F.collect_set(upper)).alias("partners"))
    return listed, few_pairs


def _pairs_of(sides: DataFrame, gids: Column, listed: DataFrame, few_pairs: bool) -> DataFrame:
    """sides (sides: an entry per group of a term, ...) -> a_gid, b_gid, sides, at, to and the rest, a row per
    wanted pair whose groups are both in `gids` (rising), at places `at` and `to`. Pairs that nobody
    asks for are never made."""
    rest = [c for c in sides.columns if c != "sides"]
    first = sides.select("sides", *rest, gids.alias("gids")).select("*", F.posexplode("gids").alias("at", "a_gid")).where(
        F.col("at") + 1 < F.size("gids"))
    later = F.slice("gids", F.col("at") + 2, F.size("gids"))
    made = first.join(small_side(listed, few_pairs), "a_gid").select(
        "a_gid", "sides", "gids", "at", *rest, F.explode(F.array_intersect(later, "partners")).alias("b_gid"))
    return made.withColumn("to", (F.array_position("gids", F.col("b_gid")) - 1).cast("int"))


def _shared_sums(encoded: DataFrame, wanted: DataFrame, sums: list[Column]) -> DataFrame:
    """Sums over the terms two groups share, for wanted group pairs (s_gid, t_gid).

    The groups of a term are gathered in one row, with as many entries as groups have the term;
    terms of one group go at once. Wanted pairs are made inside that row, as `a` (lower number) and
    `b`, and summed up in the same task. Sums are aliased a_x / b_x for the two sides or plain for
    symmetric ones; they come back as s_x / t_x.
    """
    values = [c for c in encoded.columns if c not in ("gid", "term")]
    listed, few_pairs = _listed(wanted)
    sides = encoded.groupBy("term").agg(
        F.sort_array(F.collect_list(F.struct("gid", *values))).alias("sides")).where(F.size("sides") > 1)
    found = _pairs_of(sides.select("sides"), F.col("sides.gid"), listed, few_pairs)
    places = [F.get("sides", F.col(place))[c].alias(f"{side}_{c}") for side, place in (("a", "at"), ("b", "to")) for c in values]
    shared = found.select("a_gid", "b_gid", *places).groupBy("a_gid", "b_gid").agg(*sums)
    return _both_directions(shared, wanted, few_pairs)


def _shared_counts(encoded: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with `shared`, the number of terms that both groups have.

    Terms that the same groups have are counted together before any pair is made, so the work
    grows with the different sets of groups and not with the vocabulary.
    """
    listed, few_pairs = _listed(wanted)
    signatures = encoded.groupBy("term").agg(F.sort_array(F.collect_list("gid")).alias("sides")).where(
        F.size("sides") > 1).groupBy("sides").agg(F.count("*").alias("n"))
    found = _pairs_of(signatures, F.col("sides"), listed, few_pairs)
    shared = found.groupBy("a_gid", "b_gid").agg(F.sum("n").alias("shared"))
    return _both_directions(shared, wanted, few_pairs)


def _both_directions(shared: DataFrame, wanted: DataFrame, few_pairs: bool) -> DataFrame:
    """wanted with the sums of its pairs, whichever side has the lower number."""
    names = [c for c in shared.columns if c not in ("a_gid", "b_gid")]

    def oriented(source: str, target: str) -> Column:
        """One row read as a pair from `source` to `target` (a to b, or b to a)."""
        new_name = {}
        for name in ["a_gid", "b_gid", *names]:
            side, _, rest = name.partition("_")
            side = {source: "s", target: "t"}.get(side)
            new_name[f"{side}_{rest}" if side else name] = name
        return F.struct(*[F.col(new_name[n]).alias(n) for n in sorted(new_name)])

    both = shared.select(F.inline(F.array(oriented("a", "b"), oriented("b", "a"))))
    return wanted.join(small_side(both, few_pairs), ["s_gid", "t_gid"], "left")


def overlap_share(terms: DataFrame, pairs: DataFrame, few: bool, name: str) -> DataFrame:
    """100 * shared terms / terms of the target, 0 for a target without terms."""
    terms = terms.select(*GROUP, "term")
    groups = _numbered(terms.groupBy(*GROUP).agg(F.count("*").alias("vocab_size")))
    encoded = terms.join(small_side(groups.select(*GROUP, "gid"), few), GROUP).select("gid", "term")
    wanted = pin(_with_groups(pairs, groups, few))
    joined = _shared_counts(encoded, wanted)
    return joined.select(*PAIR, _overlap(F.col("shared")).alias(name))


def _overlap(shared: Column) -> Column:
    same = F.col("s_gid") == F.col("t_gid")
    count = F.when(same, F.col("t_vocab_size")).otherwise(F.coalesce(shared, F.lit(0)))
    return F.when(F.col("t_vocab_size") > 0, 100.0 * count / F.col("t_vocab_size")).otherwise(0.0)


def distribution_distances(terms: DataFrame, pairs: DataFrame, few: bool) -> DataFrame:
    """Vocabulary overlap, both entropies, KL divergence and Jensen-Shannon distance.

    Both distributions are meant over the union of the terms, with EPSILON for a missing term.
    Nothing of that union is built: the part over shared terms comes from an inner join, the
    parts over the terms of one side from group totals minus the shared part. The two
    Jensen-Shannon inputs are rescaled to sum 1; their scales differ by a multiple of EPSILON
    and enter to first order, which is exact in double precision.

    A side without any term has no distribution: KL and JS are null.
    """
    groups = _numbered(group_totals(terms))
    encoded = terms.join(
        small_side(groups.select(*GROUP, "gid", "word_count"), few), GROUP
    ).select("gid", "term", (F.col("n") / F.col("word_count")).alias("p"))
    wanted = pin(_with_groups(pairs, groups, few))

    a, b = F.col("a_p"), F.col("b_p")
    log_a, log_b, log_mean = F.ln(a), F.ln(b), F.ln((a + b) / 2)
    joined = _shared_sums(encoded, wanted, [
        F.count("*").alias("shared"),
        F.sum(a).alias("a_mass"), F.sum(b).alias("b_mass"),
        F.sum(log_a).alias("a_log"), F.sum(log_b).alias("b_log"),
        F.sum(a * log_a).alias("a_self"), F.sum(b * log_b).alias("b_self"),
        # differences per term: sums of their parts would cancel for near-equal corpora
        F.sum(a * (log_a - log_b)).alias("a_ratio"), F.sum(b * (log_b - log_a)).alias("b_ratio"),
        F.sum(a * (log_a - log_mean)).alias("a_gap"), F.sum(b * (log_b - log_mean)).alias("b_gap"),
        F.sum(a * b / (a + b)).alias("both"),
    ])
    sums = ["shared", "both"] + [f"{s}_{x}" for s in "st"
                                 for x in ("mass", "log", "self", "ratio", "gap")]
    joined = joined.select(
        *[c for c in joined.columns if c not in sums],
        *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in sums],
    )
    same = F.col("s_gid") == F.col("t_gid")
    defined = F.col("s_gid").isNotNull() & F.col("t_gid").isNotNull()
    return joined.select(
        *PAIR,
        _overlap(F.col("shared")).alias("vocab-overlap"),
        F.coalesce(-F.col("s_plogp"), F.lit(0.0)).alias("source_shannon_entropy"),
        F.coalesce(-F.col("t_plogp"), F.lit(0.0)).alias("target_shannon_entropy"),
        F.when(defined, F.when(same, 0.0).otherwise(_kl())).alias("kl-divergence"),
        F.when(defined, F.when(same, 0.0).otherwise(_js())).alias("js-divergence"),
    )


def _kl() -> Column:
    """Sum of p ln(p / q) - p + q over the union of terms."""
    eps, log_eps = F.lit(EPSILON), F.lit(math.log(EPSILON))
    only_s = F.col("s_vocab_size") - F.col("shared")
    only_t = F.col("t_vocab_size") - F.col("shared")
    shared = F.col("s_ratio") - F.col("s_mass") + F.col("t_mass")
    s_mass, t_mass = 1.0 - F.col("s_mass"), 1.0 - F.col("t_mass")
    s_part = F.col("s_plogp") - F.col("s_self") - log_eps * s_mass - s_mass + eps * only_s
    t_part = eps * log_eps * only_t - eps * (F.col("t_logp") - F.col("t_log")) - eps * only_t + t_mass
    return shared + s_part + t_part


def _js() -> Column:
    eps, log_2 = F.lit(EPSILON), F.lit(math.log(2.0))
    only_s = F.col("s_vocab_size") - F.col("shared")
    only_t = F.col("t_vocab_size") - F.col("shared")
    s_scale, t_scale = 1.0 + eps * only_t, 1.0 + eps * only_s
    # ratio - 1 without cancellation
    delta = eps * (only_t - only_s) / t_scale
    both = F.col("both")
    shared = (
        (F.col("s_gap") - delta * both) / s_scale
        + (F.col("t_gap") + F.col("t_mass") * delta
           - delta * (F.col("t_mass") - both)) / t_scale
    )

    def one_sided(prefix: str, count: Column, scale: Column, other_scale: Column) -> Column:
        rest = (1.0 - F.col(f"{prefix}_mass")) / scale
        missing = eps / other_scale
        logs = F.col(f"{prefix}_logp") - F.col(f"{prefix}_log") - count * F.ln(scale)
        return (log_2 * (rest + count * missing) + count * missing * (F.ln(missing) - 1.0)
                - missing * logs)

    divergence = (shared + one_sided("s", only_s, s_scale, t_scale)
                  + one_sided("t", only_t, t_scale, s_scale))
    return F.sqrt(F.greatest(F.lit(0.0), divergence / 2))


def global_distribution(terms: DataFrame, pairs: DataFrame, few: bool) -> DataFrame:
    """Both distributions of every pair over the union of terms, as rows (pair, term, p, q).

    This is the long form, with a row for every pair and term: use it to look at a few pairs.
    The distances do not need it. The groups of a term are gathered in one row, and the pairs are
    made inside it: only the vocabulary is shuffled, not its product with the pairs.
    """
    p = term_probability(terms, few).select(*GROUP, "term", "p")
    pairs = pin(pairs.select(*PAIR).distinct())
    few_pairs = few_rows(pairs)
    name = lambda side: F.struct(F.col(side).alias("domain"), F.col(f"{side}_split").alias("split"))
    sides = p.groupBy("term").agg(F.collect_list(F.struct(F.struct(*GROUP).alias("group"), "p")).alias("sides"))
    own = sides.select("term", "sides", F.explode("sides").alias("own")).select("term", "sides", "own.*")
    fill = F.lit(EPSILON)

    def other_p(other: Column) -> Column:
        return F.get(F.filter("sides", lambda x: x["group"] == other), F.lit(0))["p"]

    def from_side(side: str, other: str) -> DataFrame:
        partners = pairs.groupBy(name(side).alias("group")).agg(F.collect_set(name(other)).alias("others"))
        found = own.join(small_side(partners, few_pairs), "group").select(
            "group", "term", "sides", F.col("p").alias("own_p"), F.explode("others").alias("other"))
        return found.withColumn("other_p", other_p(F.col("other")))

    left = from_side("source", "target").select(
        F.col("group").alias("s"), F.col("other").alias("t"), "term", F.col("own_p").alias("p"), F.coalesce("other_p", fill).alias("q"))
    right = from_side("target", "source").where("other_p is null").select(
        F.col("other").alias("s"), F.col("group").alias("t"), "term", fill.alias("p"), F.col("own_p").alias("q"))
    return left.unionByName(right).select(
        F.col("s.domain").alias("source"), F.col("s.split").alias("source_split"),
        F.col("t.domain").alias("target"), F.col("t.split").alias("target_split"), "term", "p", "q")


def contextual_overlap(vectors: DataFrame, pairs: DataFrame, few: bool) -> DataFrame:
    """Mean cosine over all document pairs, the larger side cut to the size of the smaller.

    `vectors` has (domain, split, doc_id, embedding). The mean of all cosines is the dot product
    of the two mean unit vectors, so no document pair is formed. The cut needs the mean over
    the first m documents for a few m per group: documents are summed per segment between
    neighbouring cuts, and the segment sums are added up.
    """
    ids = vectors.select(*GROUP, "doc_id")
    sizes = ids.groupBy(*GROUP).agg(F.count("*").alias("size"))
    sized = pin(_with_groups(pairs, sizes, few).where(
        F.col("s_size").isNotNull() & F.col("t_size").isNotNull()
    ).withColumn("kept", F.least("s_size", "t_size")))

    def cuts_of(name: str) -> DataFrame:
        return sized.select(F.col(name).alias("domain"), F.col(f"{name}_split").alias("split"),
                            F.col("kept").alias("rank"))

    cuts = cuts_of("source").unionByName(cuts_of("target")).distinct()
    ranked = exact_rank(ids, GROUP, "doc_id")
    few_pairs = few_rows(sized)
    ends = (
        ranked.join(small_side(cuts, few_pairs), [*GROUP, "rank"])
        .select(*GROUP, F.col("doc_id").alias("_end"), F.col("rank").alias("kept"))
        .groupBy(*GROUP)
        .agg(F.sort_array(F.collect_list(F.struct("_end", "kept"))).alias("_ends"))
    )
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    segments = (
        vectors.select(*GROUP, "doc_id", "embedding", norm.alias("_norm"))
        .join(small_side(ends, few_pairs), GROUP)
        .withColumn("_segment", F.size(F.filter("_ends", lambda e: e["_end"] < F.col("doc_id"))))
        .where(F.col("_segment") < F.size("_ends"))
        .withColumn("kept", F.col("_ends")[F.col("_segment")]["kept"])
        .select(*GROUP, "kept", "_norm", F.posexplode("embedding").alias("_pos", "_x"))
        .groupBy(*GROUP, "kept", "_pos")
        .agg(F.sum(F.when(F.col("_norm") > 0, F.col("_x") / F.col("_norm")).otherwise(0.0)).alias("_sum"))
    )
    so_far = Window.partitionBy(*GROUP, "_pos").orderBy("kept").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    means = segments.withColumn("_mean", F.sum("_sum").over(so_far) / F.col("kept"))

    def side(name: str) -> DataFrame:
        return means.select(F.col("domain").alias(name), F.col("split").alias(f"{name}_split"),
                            "kept", "_pos", F.col("_mean").alias(f"_{name}"))

    return (
        sized.select(*PAIR, "kept")
        .join(side("source"), ["source", "source_split", "kept"])
        .join(side("target"), ["target", "target_split", "kept", "_pos"])
        .groupBy(*PAIR)
        .agg(F.sum(F.col("_source") * F.col("_target")).alias("contextual-overlap"))
    )


def pair_distances(terms: DataFrame, top: DataFrame, vectors: DataFrame, pairs: DataFrame,
                   few: bool) -> DataFrame:
    """All seven numbers of every pair: overlaps, entropies, divergences, mean cosine."""
    pairs = pin(pairs.select(*PAIR).distinct())
    return (
        distribution_distances(terms, pairs, few)
        .join(overlap_share(top, pairs, few, "tf-idf-overlap"), PAIR, "left")
        .join(contextual_overlap(vectors, pairs, few), PAIR, "left")
    )
