"""TF-IDF weights and top terms of every (domain, split).

The weight of a term in a document is tf * (ln((1 + N) / (1 + df)) + 1), divided by the
Euclidean norm of the document's weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed
from corpusgap.functions import text as tx
from corpusgap.operators import term_blocks
from corpusgap.operators.profile import GROUP
from corpusgap.operators.ranking import top_n, without_low
from corpusgap.runtime import pin, small_side


def document_terms(corpus: DataFrame, stop_words=fixed.ENGLISH_STOP_WORDS) -> DataFrame:
    """(domain, split, doc_id, term, tf) for words of at least two characters.

    The words of a document are counted inside its row, as runs of the sorted word list, so
    counting needs no shuffle.
    """
    words = corpus.select(
        *GROUP, "doc_id", F.sort_array(tx.long_words(F.col("text"))).alias("words")
    ).where(F.size("words") > 0)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)),
    )

    def run(start, j):
        end = F.coalesce(F.get("starts", j + 1), F.size("words"))
        return F.struct(F.get("words", start).alias("term"),
                        (end - start).cast("bigint").alias("tf"))

    runs = F.transform("starts", run)
    # inline_outer: no list is empty, and inline would make Spark count twice to test for that
    return (
        words.withColumn("starts", starts)
        .select(*GROUP, "doc_id", F.inline_outer(runs))
        .where(~F.col("term").isin(*stop_words))
    )


# So many (domain, split, term) rows count as heavy at most, and so many bytes of them are broadcast.
MOST_HEAVY = 100_000
MAX_HEAVY_BYTES = 64 << 20
# One document in so many tells which terms are likely to be frequent.
SAMPLED = 64


def heavy_limit(rows: int, most: int = MOST_HEAVY) -> int:
    """The document frequency from which a term is heavy: no more than `most` terms can reach it."""
    return max(2, -(-rows // max(most, 1)))


def with_idf(pairs: DataFrame, idf: DataFrame, limit: int) -> DataFrame:
    """pairs (domain, split, term, ...) with _idf. Terms in `limit` documents or more are looked up in
    a broadcast table, whose size is counted; only the others are shuffled, so no key of the long
    join has more than `limit` rows. A table too large to broadcast is joined by shuffle."""
    key = [*GROUP, "term"]
    heavy, light = idf.where(F.col("_df") >= limit).drop("_df"), idf.where(F.col("_df") < limit).drop("_df")
    size = heavy.agg(F.sum(F.octet_length("term") + F.octet_length("domain") + F.octet_length("split") + 64)).first()[0] or 0
    if size > MAX_HEAVY_BYTES:
        return pairs.join(idf.drop("_df"), key)
    looked_up = pairs.join(F.broadcast(heavy), key)
    rest = pairs.join(F.broadcast(heavy.select(*key)), key, "left_anti")
    return looked_up.unionByName(rest.join(light, key))


def frequent_terms(pairs: DataFrame) -> DataFrame | None:
    """(domain, split, term, _df) of terms that are likely in many documents, few enough to broadcast; None
    if there are none or they take too many bytes. Which terms are listed is guessed from one document in
    SAMPLED, their counts are exact."""
    key = [*GROUP, "term"]
    some = pairs.where(F.pmod(F.xxhash64(*GROUP, "doc_id"), F.lit(SAMPLED)) == 0)
    limit = heavy_limit(some.count())
    listed = pin(some.groupBy(*key).agg(F.count("*").alias("_df")).where(F.col("_df") >= limit).select(*key))
    size = listed.agg(F.sum(F.octet_length("term") + F.octet_length("domain") + F.octet_length("split") + 64)).first()[0] or 0
    if not 0 < size <= MAX_HEAVY_BYTES:
        return None
    return pin(pairs.join(F.broadcast(listed), key).groupBy(*key).agg(F.count("*").alias("_df")))


def with_frequency(pairs: DataFrame) -> DataFrame:
    """pairs (domain, split, term, ...) with _df, the number of rows of their term. Frequent terms are counted
    before a shuffle and looked up in a broadcast table; the rows of the others are shuffled once, by
    their term, and counted where they meet."""
    key = [*GROUP, "term"]
    counted = lambda rows: rows.withColumn("_df", F.count("*").over(Window.partitionBy(*key)))
    frequent = frequent_terms(pairs)
    if frequent is None:
        return counted(pairs)
    rest = pairs.join(F.broadcast(frequent.select(*key)), key, "left_anti")
    return pairs.join(F.broadcast(frequent), key).unionByName(counted(rest))


def document_weights(corpus: DataFrame, groups_are_few: bool,
                     stop_words=fixed.ENGLISH_STOP_WORDS) -> DataFrame:
    """(domain, split, doc_id, term, tf, weight) with rows of unit length per document.

    Rows move by term, where documents are counted, and by document, where the norm is a window over
    one document, whose terms came from one input row. What moves is counts; weights follow from them
    after the move.
    """
    pairs = with_frequency(pin(document_terms(corpus, stop_words)))
    sizes = small_side(corpus.groupBy(*GROUP).agg(F.count("*").alias("_docs")), groups_are_few)
    idf = F.ln((F.col("_docs") + 1) / (F.col("_df") + 1)) + 1
    key = [*GROUP, "doc_id"]
    raw = pairs.repartition(*key).join(sizes, GROUP).withColumn("_raw", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*key)))
    return raw.select(*key, "term", "tf", (F.col("_raw") / norm).alias("weight"))


def _repeated(corpus: DataFrame) -> bool:
    """Whether documents of one (domain, split) share an id."""
    return not corpus.groupBy(*GROUP, "doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def term_scores(corpus: DataFrame, groups_are_few: bool,
                stop_words=fixed.ENGLISH_STOP_WORDS) -> DataFrame:
    """(domain, split, term, score): the weights of a term summed over documents.

    Documents lie in blocks. A block sends one list of its distinct terms per (domain, split) and part of the
    terms, gets their document frequencies back, weighs its documents by itself, and sends sums per
    term. So no row per document and term is moved or sorted. Documents that share an id share a norm,
    wherever they lie: a corpus with such ids takes the long way over `document_weights`.
    """
    if _repeated(corpus):
        weights = document_weights(corpus, groups_are_few, stop_words)
        return weights.groupBy(*GROUP, "term").agg(F.sum("weight").alias("score"))
    sizes = pin(corpus.groupBy(*GROUP).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")))
    parts = max(1, -(-(sizes.agg(F.max("chars")).first()[0] or 0) // term_blocks.PART_CHARS))
    # a group without a name is in no pair
    named = corpus.where(F.col("domain").isNotNull() & F.col("split").isNotNull())
    blocks = pin(term_blocks.blocks(named.select(*GROUP, tx.long_words(F.col("text")).alias("words")), stop_words, parts))
    lists = blocks.where("part is not null").drop("codes", "tf")
    counted = term_blocks.with_frequency(lists.join(small_side(sizes.drop("chars"), groups_are_few), GROUP))
    return term_blocks.merged(term_blocks.weighed(blocks.where("part is null").select("block", "codes", "tf"), counted))


def top_terms(corpus: DataFrame, groups_are_few: bool, n: int = fixed.TOP_TERMS,
              stop_words=fixed.ENGLISH_STOP_WORDS) -> DataFrame:
    """(domain, split, term, score, rank): the n terms of highest score, ties by term.

    Scores are compared after rounding to 9 decimals: sums that differ only by the order of
    addition count as ties.
    """
    order = [F.round("score", 9).desc(), F.col("term").desc()]
    scores = pin(term_scores(corpus, groups_are_few, stop_words))
    # a level is wider than what rounding changes
    level = F.floor(F.log2(F.greatest("score", F.lit(1e-6))) * 16).cast("int")
    return top_n(without_low(scores, GROUP, level, n, groups_are_few), GROUP, order, "term", n)
