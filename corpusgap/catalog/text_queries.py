"""Queries for ingestion, profiles and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgap.catalog import derive
from corpusgap.functions import fixed_values as fixed
from corpusgap.functions import text as tx
from corpusgap.operators import chunks, distance, ingest, pairs, profile, syntax, tfidf
from corpusgap.runtime import pin, shared_folder
from corpusgap.sources import corpora, tables
from corpusgap.sources.specs import CorpusSpec

DIGITS = 6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), DIGITS) for n in names})


def _first_sentence_summary(df: DataFrame) -> DataFrame:
    block = F.floor(F.col("doc_id") / 20).cast("bigint")
    return df.withColumn("split", F.when(block % 5 == 0, "test").otherwise("train")).withColumn(
        "summary", F.concat(F.lit("In short: "), F.regexp_extract("text", r"^[^.!?]*", 0))
    )


DRIVER_SPECS = {
    "documents": CorpusSpec("documents", "driver", "documents", {"lang": "language"},
                            ("source", "n_chars"), directory="documents.parquet",
                            preprocess=_first_sentence_summary),
}


def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.load_corpus(spark, "documents", sf, min_input_size=200, specs=DRIVER_SPECS)


def corpus_without_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a corpus without ids: rows are numbered in the order of the files, copies too."""
    raw = derive.table(spark, sf, "documents").select("source", "text")
    numbered = corpora.with_doc_id(raw)
    return numbered.select("doc_id", "source", F.md5("text").alias("text_md5"))


def split_scan(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.pick_split(derive.corpus(spark, sf), "test")


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.corpus(spark, sf).select("doc_id", "domain", "text", "split")
    files = {}
    for split in ("train", "test"):
        part = ingest.pick_split(docs, split).drop("split")
        files[split] = tables.write_csv(part, shared_folder(spark, f"csv-{split}"))
    return corpora.scan_csv(spark, files, "doc_id bigint, domain string, text string")


def score_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.write_csv(derive.scores(spark, sf), shared_folder(spark, "scores"))
    read = tables.read_scores(spark, path)
    return rounded(read, *pairs.metrics_of(read))


def ingest_admissible(spark: SparkSession, sf: str) -> DataFrame:
    raw = derive.pair_text(spark, sf).select(
        "domain", "split", "doc_id", F.col("text").alias("article"),
        F.col("summary").alias("abstract"), F.length("text").alias("size"),
    )
    named = ingest.rename_columns(raw, {"article": "text", "abstract": "summary"})
    return ingest.admissible(ingest.drop_columns(named, ["size"]), 200)


def combine_columns(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.documents(spark, sf)
    labels = derive.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string"))
    return ingest.combine_columns(
        docs.join(labels, "doc_id", "left"), ["lang", "quality", "source"], "summary"
    ).select("doc_id", "summary")


def combine_list_field(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.combine_list_field(derive.line_lists(spark, sf), "sources")


def instruction_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.add_instruction(derive.corpus(spark, sf)).select("doc_id", "text")


def embed_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.embedding_inputs(derive.corpus(spark, sf)).select(
        "doc_id", "embed_text", tx.word_count(F.col("text")).alias("words")
    )


def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of 5,000 characters, as test texts are shorter than the default length."""
    docs = derive.corpus(spark, sf).select("domain", "split", "doc_id", "text")
    return chunks.parser_chunks(docs, 5_000)


def preview_per_split(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.preview(derive.corpus(spark, sf))


def train_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.cap_train(derive.corpus(spark, sf), 25)


def profile_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Cap after the filter, then profile: what a capped comparison run starts from."""
    kept = ingest.admissible(derive.pair_text(spark, sf))
    return ingest.cap_profile(kept, 5).select("domain", "split", "doc_id", "summary")


def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.holdout(derive.corpus(spark, sf), "doc_id").select("doc_id", "is_test")


def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.folds(derive.corpus(spark, sf), "doc_id").select("doc_id", "fold")


def ft_export(spark: SparkSession, sf: str) -> DataFrame:
    """Fine-tuning set of admissible train pairs, written by split and read back."""
    rows = ingest.finetuning_set(ingest.admissible(derive.pair_text(spark, sf)))
    path = tables.write_splits(rows, shared_folder(spark, "finetuning"))
    return spark.read.parquet(path).select("domain", "split", "doc_id", "text", "summary")


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.corpus(spark, sf)
    return (
        docs.select("domain", F.explode(tx.tokens(F.col("text"))).alias("term"))
        .groupBy("domain", "term").agg(F.count("*").alias("n"))
    )


def token_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = derive.corpus(spark, sf).select(
        "doc_id", F.explode(tx.tokens(F.col("text"))).alias("term")
    )
    kept = F.count_if(tx.is_term(F.col("term")))
    return docs.groupBy("doc_id").agg(F.count("*").alias("tokens"), kept.alias("kept"))


def term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return profile.term_counts(derive.corpus(spark, sf))


def term_probability(spark: SparkSession, sf: str) -> DataFrame:
    corpus = derive.corpus(spark, sf)
    probabilities = profile.term_probability(
        pin(profile.term_counts(corpus)), profile.groups_fit(corpus)
    )
    return probabilities.withColumn("p", F.round("p", 9)).orderBy("domain", "split", "p", "term")


def shannon_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.shannon_entropy(profile.term_counts(derive.corpus(spark, sf))),
                   "shannon_entropy")


def domain_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.domain_profile(derive.corpus(spark, sf))
    lines = profile.profile_text(found)
    return rounded(found.join(lines, ["domain", "split"]), "shannon_entropy")


def dependency_length(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(syntax.dependency_length(derive.parse_tokens(spark, sf)), "avg_dependency_length")


def tree_depth(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.sentence_depths(derive.parse_tokens(spark, sf)).drop("length")


def learning_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(syntax.learning_difficulty(derive.parse_tokens(spark, sf)),
                   "avg_dependency_length", "learning_difficult")


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    corpus = derive.corpus(spark, sf)
    return rounded(tfidf.document_weights(corpus, profile.groups_fit(corpus)), "weight")


def tfidf_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    corpus = derive.corpus(spark, sf)
    return rounded(tfidf.top_terms(corpus, profile.groups_fit(corpus)), "score")


def tfidf_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of the 300 top terms, so that the cut matters on test data."""
    corpus = derive.corpus(spark, sf)
    few = profile.groups_fit(corpus)
    top = pin(tfidf.top_terms(corpus, few, 300))
    return rounded(distance.overlap_share(top, derive.resolved_pairs(spark, sf), few, "tf-idf-overlap"),
                   "tf-idf-overlap")


def vocab_overlap(spark: SparkSession, sf: str) -> DataFrame:
    corpus = derive.corpus(spark, sf)
    found = distance.overlap_share(
        pin(profile.term_counts(corpus)), derive.resolved_pairs(spark, sf), profile.groups_fit(corpus),
        "vocab-overlap",
    )
    return rounded(found, "vocab-overlap")


def global_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """The filled distributions of all pairs, summed up per pair: terms, fills, masses, maxima."""
    corpus = derive.corpus(spark, sf)
    filled = distance.global_distribution(
        pin(profile.term_counts(corpus)), derive.resolved_pairs(spark, sf), profile.groups_fit(corpus)
    )
    found = filled.groupBy(*distance.PAIR).agg(
        F.count("*").alias("terms"),
        F.count_if(F.col("p") == fixed.EPSILON).alias("p_filled"),
        F.count_if(F.col("q") == fixed.EPSILON).alias("q_filled"),
        F.sum("p").alias("p_mass"), F.sum("q").alias("q_mass"),
        F.max("p").alias("p_max"), F.max("q").alias("q_max"),
    )
    return rounded(found, "p_mass", "q_mass", "p_max", "q_max")


def _divergences(spark: SparkSession, sf: str) -> DataFrame:
    corpus = derive.corpus(spark, sf)
    return distance.distribution_distances(
        pin(profile.term_counts(corpus)), derive.resolved_pairs(spark, sf), profile.groups_fit(corpus)
    )


def kl_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_divergences(spark, sf).select(*distance.PAIR, "kl-divergence"), "kl-divergence")


def js_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_divergences(spark, sf).select(*distance.PAIR, "js-divergence"), "js-divergence")


def language_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Which languages' corpora are furthest apart: every language against every other one."""
    corpus = derive.corpus(spark, sf).select(
        F.col("lang").alias("domain"), F.lit("test").alias("split"), "doc_id", "text"
    )
    wanted = pairs.resolve_pairs(
        pairs.domain_pairs(corpus.select("domain").distinct()), tuned=False
    ).where("da_type = 'single-domain-adapt'")
    found = distance.distribution_distances(pin(profile.term_counts(corpus)), wanted,
                                            profile.groups_fit(corpus))
    return rounded(found.drop("source_split", "target_split"), "vocab-overlap", "kl-divergence",
                   "js-divergence", "source_shannon_entropy", "target_shannon_entropy")


def contextual_overlap(spark: SparkSession, sf: str) -> DataFrame:
    vectors = derive.label_vectors(spark, sf)
    wanted = pairs.resolve_pairs(
        pairs.domain_pairs(vectors.select("domain").distinct()), tuned=False
    ).where("da_type = 'single-domain-adapt'")
    found = distance.contextual_overlap(vectors, wanted, profile.groups_fit(vectors))
    return rounded(found, "contextual-overlap")


def pair_distances(spark: SparkSession, sf: str) -> DataFrame:
    corpus = derive.corpus(spark, sf)
    few = profile.groups_fit(corpus)
    found = distance.pair_distances(
        pin(profile.term_counts(corpus)), pin(tfidf.top_terms(corpus, few)), derive.vectors(spark, sf),
        derive.resolved_pairs(spark, sf), few,
    )
    return rounded(found, *[c for c in found.columns if c not in distance.PAIR])


QUERIES = {
    f.__name__: f
    for f in [
        corpus_scan, corpus_without_ids, split_scan, csv_roundtrip, score_scan, ingest_admissible, combine_columns,
        combine_list_field, instruction_prompt, embed_truncate, chunk_text, preview_per_split,
        train_cap, profile_cap, holdout_split, kfold_assign, ft_export, tokenize, token_filter,
        term_frequency, term_probability, shannon_entropy, domain_profile, dependency_length,
        tree_depth, learning_difficulty, tfidf_weights, tfidf_top_terms, tfidf_overlap,
        vocab_overlap, global_distribution, kl_divergence, js_distance, language_distances,
        contextual_overlap, pair_distances,
    ]
}
