"""Benchmark decontamination on a positional inverted index of the training texts.

Items are cut into windows of `size` consecutive words; an item with fewer words, but not none, is one
window. The corpus frequency of every test term is counted over all texts, and the rarest terms of each
window become its anchors. The index holds the postings (term, document, position) of all anchor terms,
written once; postings of rarest terms also carry the words around them. Lists are intersected from the
rarest term on: a posting minus the term's offset is a possible start, which the next list must confirm.
What is left is compared word by word, so matches are exact. `proximity` asks for the same anchors,
each at most `slack` words away from its place.

Common words never enter the index, and no list meets another but on (document, position), so a passage
or word that a third of the documents share is spread over its documents.

Cases: null, empty and wordless texts have no words and no hits; null item ids are ignored; items of
equal id are one item; repeated documents are answered one by one (a document is known by its id and
the hash of its text, so equal ids with different texts stay apart); empty tables on either side give no
matches; other columns are ignored. Tables of terms and windows are broadcast only if they were counted
to be below MAX_TERMS rows, and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgap.llm.common import Scratch, ascii_lower, checked_broadcast, few, packed, words

SIZE, LISTS = 10, 2
MAX_TERMS = 500_000
MAX_HIT_DOCS = 1_000_000  # rows of two numbers
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["doc_id", "row_hash"]


def n_words(text: Column) -> Column:
    return F.size(words(text, BETWEEN_ANY_CASE)).cast("bigint")


def windows_of(items: DataFrame, size: int = SIZE) -> DataFrame:
    """items (item_id, text) -> distinct item_id (string), phrase."""
    w = F.col("w")
    several = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    cut = F.when(F.size(w) >= size, several).when(F.size(w) > 0, F.array(F.array_join(w, " ")))
    return (
        items.where(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("string").alias("item_id"), words(ascii_lower(F.col("text"))).alias("w"))
        .select("item_id", F.explode(cut).alias("phrase")).distinct()
    )


def _tokens(docs: DataFrame) -> DataFrame:
    """One row per word: the document's key, its words, position (from 0), term."""
    split = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), words(ascii_lower(F.col("text"))).alias("w"))
    return split.select(*KEY, "w", F.posexplode("w").alias("pos", "term"))


def anchors_of(docs: DataFrame, phrases: DataFrame, lists: int, scratch: Scratch) -> DataFrame:
    """phrases (phrase) -> phrase, n (words), rank, term, offset of the rarest terms; phrases with a term
    that no document has are left out."""
    placed = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    vocabulary = scratch.put(placed.select("term").distinct())
    terms = _tokens(docs).select("term")
    if few(vocabulary, MAX_TERMS):
        counts = terms.join(F.broadcast(vocabulary), "term").groupBy("term").count()
    else:
        counts = terms.groupBy("term").count().join(vocabulary, "term")
    counts = scratch.put(counts)
    whole = Window.partitionBy("phrase")
    ranked = (
        placed.join(checked_broadcast(counts, MAX_TERMS), "term", "left")
        .withColumn("n", F.count("*").over(whole)).withColumn("known", F.count("count").over(whole))
        .where("n = known")
        .withColumn("rank", F.row_number().over(whole.orderBy("count", "term", "offset")))
    )
    return scratch.put(ranked.where(F.col("rank") <= lists).select("phrase", "n", "rank", "term", "offset"))


def build_index(docs: DataFrame, terms: DataFrame, reach: int, scratch: Scratch) -> DataFrame:
    """terms (term, around boolean) -> written postings term, doc_id, row_hash, pos, context, lead.

    context: where `around`, the words up to `reach` places before and after, of which `lead` stand before.
    """
    lead = F.least(F.col("pos"), F.lit(reach))
    context = F.slice(F.col("w"), F.col("pos") - lead + 1, lead + 1 + reach)
    postings = _tokens(docs).join(checked_broadcast(terms, MAX_TERMS), "term").select(
        "term", *KEY, "pos",
        F.when(F.col("around"), context).alias("context"), lead.alias("lead"))
    return scratch.put(postings.sortWithinPartitions("term"))


def _intersect(index: DataFrame, anchors: DataFrame, lists: int, slack: int) -> DataFrame:
    """Starts (phrase, n, doc_id, row_hash, start, context, lead, offset) that all lists confirm."""
    first = checked_broadcast(anchors.where("rank = 1").drop("rank"), MAX_TERMS)
    found = index.join(first, "term").select(
        "phrase", "n", *KEY, (F.col("pos") - F.col("offset")).alias("start"), "context", "lead", "offset")
    found = found.where("start >= 0")
    for rank in range(2, lists + 1):
        more = anchors.where(F.col("rank") == rank).select("phrase", F.col("term").alias("t2"), F.col("offset").alias("o2"))
        # phrases with fewer terms than lists have nothing to confirm
        wanted = found.join(checked_broadcast(more, MAX_TERMS), "phrase", "left")
        terms = more.select(F.col("t2").alias("term")).distinct()
        postings = index.join(checked_broadcast(terms, MAX_TERMS), "term", "left_semi").select(
            F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2"), F.col("term").alias("p2"), F.col("pos").alias("at"))
        same = wanted["doc_id"].eqNullSafe(postings["d2"]) & (wanted["row_hash"] == postings["h2"]) & (wanted["t2"] == postings["p2"])
        place = F.col("start") + F.col("o2")
        near = (postings["at"] == place) if slack == 0 else postings["at"].between(place - slack, place + slack)
        confirmed = wanted.where("t2 is not null").join(postings, same & near, "left_semi")
        found = confirmed.unionByName(wanted.where("t2 is null")).drop("t2", "o2")
    return found


def _search(docs: DataFrame, phrases: DataFrame, lists: int, slack: int, scratch: Scratch) -> DataFrame:
    anchors = anchors_of(docs, phrases, lists, scratch)
    terms = scratch.put(anchors.groupBy("term").agg((F.min("rank") == 1).alias("around")))
    reach = anchors.agg(F.max("n")).first()[0] or 1
    return _intersect(build_index(docs, terms, reach, scratch), anchors, lists, slack)


def exact_matches(docs: DataFrame, phrases: DataFrame, lists: int = LISTS, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text), phrases (phrase) -> doc_id, row_hash, start, n, phrase of all exact occurrences."""
    found = _search(docs, phrases, lists, 0, scratch or Scratch(docs.sparkSession, "phrases"))
    begin = F.col("lead") - F.col("offset")
    said = F.array_join(F.slice(F.col("context"), begin + 1, F.col("n").cast("int")), " ")
    return found.where((begin >= 0) & (said == F.col("phrase"))).select(*KEY, "start", "n", "phrase").distinct()


def proximity_matches(docs: DataFrame, phrases: DataFrame, slack: int, lists: int = 3) -> DataFrame:
    """doc_id, row_hash, start, phrase: the rarest `lists` terms of the phrase lie at most `slack` words
    from their places, as seen from the rarest one, which gives the start."""
    scratch = Scratch(docs.sparkSession, "proximity")
    return _search(docs, phrases, lists, slack, scratch).select(*KEY, "start", "phrase").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, row_hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    windows = scratch.put(windows_of(items, size))
    matches = scratch.put(exact_matches(docs, windows.select("phrase").distinct(), scratch=scratch))
    places = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n").cast("int") - 1))
    hits = matches.select(*KEY, places.alias("at")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    owners = matches.select(*KEY, "phrase").join(checked_broadcast(windows, MAX_TERMS), "phrase").select(*KEY, "item_id").distinct()
    told = owners.groupBy(*KEY).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))  # no more than items
    hit = hits.join(told, hits["doc_id"].eqNullSafe(told["doc_id"]) & (hits["row_hash"] == told["row_hash"])).select(
        hits["doc_id"].alias("hit_doc"), hits["row_hash"].alias("hit_hash"), "n_hit",
        F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    counted = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), n_words(F.col("text")).alias("n_words"))
    joined = counted.join(hit, counted["doc_id"].eqNullSafe(hit["hit_doc"]) & (counted["row_hash"] == hit["hit_hash"]), "left")
    return joined.select(
        *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs, all columns, in which no window of an item occurs."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    phrases = scratch.put(windows_of(items, size).select("phrase").distinct())
    bad = scratch.put(exact_matches(docs, phrases, scratch=scratch).select(F.xxhash64("doc_id").alias("id_hash"), "row_hash").distinct())
    return packed(docs).join(checked_broadcast(bad, MAX_HIT_DOCS), ["id_hash", "row_hash"], "left_anti").select("doc.*")
