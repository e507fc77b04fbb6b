"""Fuzzy line de-duplication: MinHash, banding, exact verification, distributed union-find.

A line (without blanks at its ends; empty ones are no lines) is the set of its `size`-character shingles, as
32-bit hashes; a shorter line is one shingle. All shingles of all lines are hashed and signed, each different line once.
The hashes fall into BANDS * ROWS bins, and the signature is the least value of each bin (one-permutation hashing, one
hash a shingle); two sets share a band of ROWS bins with probability J ** ROWS. Sets that leave many bins empty
are signed by the least value of the whole set under each of BANDS * ROWS permutations of the hashes, those that fill neither
few nor most in both ways, so two lines near a border have bands of one kind. Which way it is follows from the set alone, not
from the line's length. All is made by Spark's functions: rows of shingles, and minima.

In each bucket of equal bands every line meets the leader (a line with most copies); verified links are
joined by union-find; then pairs of a bucket meet that are still in different components. So a line with
thousands of variants is joined by its leader, and never written as pairs. Lines that are still apart in
buckets of more than LIMIT meet by their rarest shingles instead, which misses no pair. Sizes and a sample of the
shingles stop most false pairs before the sets of both lines are compared exactly. Of each component the
occurrence with the smallest document id, text hash and line number stays.

Cases: null, empty and blank texts have no lines and lose none; exact copies of a line are one component,
inside a text too; of rows with equal id and text one (any one, as nothing tells them apart) counts as the
first, and the others lose all lines; null ids come last, ids that are no whole numbers stand in the order of
their hashes; an empty table gives an empty table; other columns are ignored. Lines
are known by a 64-bit hash: among 10 billion lines, 3 pairs may be taken for copies by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgap.llm.common import Scratch, checked_broadcast, packed
from corpusgap.llm.components import components

THRESHOLD, SIZE = 0.8, 9
BANDS, ROWS = 10, 4
FILLED, SPARSE = 22, 32  # bins: signed by bins are sets that fill so many at least, by permutations those that fill so many at most
SAMPLE = 4  # one in so many shingles is compared first
LIMIT = 200
MAX_BROADCAST = 500_000
_BLANKS = " \t\r\x0b\f"
_RANDOM = random.Random(9)
_PERMUTATIONS = [(_RANDOM.getrandbits(32), _RANDOM.getrandbits(31) | 1) for _ in range(BANDS * ROWS)]
_BAND_NAMES = [f"b{i}" for i in range(BANDS)]
_LEAST = [f"m{i}" for i in range(BANDS * ROWS)]
_FLIPS = [0, 1 << 30, -(1 << 31), -(1 << 30)]  # the ROWS bins of a band go by the first two bits of a hash


def _codes(line: Column, size: int) -> Column:
    """Four bytes a character; shorter lines are filled up with line breaks, which no line has."""
    return F.encode(F.rpad(line, F.greatest(F.length(line), F.lit(size)), "\n"), "UTF-32")


def _shingle(codes: Column, start: Column, size: int) -> Column:
    return F.hash(F.substring(codes, start, F.lit(4 * size)))


def shingles(line: Column, size: int = SIZE) -> Column:
    """Distinct hashes of a line's shingles."""
    return F.transform(F.array(_codes(line, size)), lambda c: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(line) - size, F.lit(0)) * 4 + 1, F.lit(4)), lambda i: _shingle(c, i, size))))[0]


def lines_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row_hash, pos, line, key (its hash); a document without lines has one row of nulls."""
    own = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    rows = own.select("doc_id", "row_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where("line <> ''").withColumn("key", F.xxhash64("line"))
    none = own.where(~F.coalesce(F.col("text").rlike(f"[^{_BLANKS}\n]"), F.lit(False)))
    return rows.unionByName(none.select("doc_id", "row_hash"), allowMissingColumns=True)


def _hashed(lines: DataFrame, size: int) -> DataFrame:
    """lines (key, line and others) -> the others, key and h, a row for each shingle of each line."""
    own = [c for c in lines.columns if c != "line"]
    told = lines.select(*own, _codes(F.col("line"), size).alias("codes"), F.greatest(F.length("line") - size, F.lit(0)).alias("last"))
    each = told.select(*own, "codes", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    return each.select(*own, _shingle(F.col("codes"), F.col("i") * 4 + 1, size).alias("h"))


def _signed(lines: DataFrame, size: int) -> DataFrame:
    """lines (key, place, line) -> key, copies, first_doc, filled (bins) and the bands of each line; null is a band without shingles.

    Flipping the bits of a bin puts its hashes first, so its least value is found without looking at which bin a hash is in;
    an empty bin repeats the value of another one of its band. Groups stay where the lines were dealt.
    """
    single = lines.groupBy("key").agg(F.count("*").alias("copies"), F.min("place").alias("first_doc"), F.min("line").alias("line"))
    own = ["key", "copies", "first_doc"]
    placed = _hashed(single, size).withColumn("band", F.pmod("h", F.lit(BANDS)))
    least = placed.groupBy(*own, "band").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(x))).alias(m) for m, x in zip(_LEAST, _FLIPS)])
    filled = sum((F.col(m) < -(1 << 30)).cast("int") for m in _LEAST[:ROWS])
    band = least.select(*own, "band", filled.alias("filled"), F.xxhash64(F.lit("bins"), *_LEAST[:ROWS], "band").alias("value"))
    bands = [F.max(F.when(F.col("band") == i, F.col("value"))).alias(c) for i, c in enumerate(_BAND_NAMES)]
    return band.groupBy(*own).agg(F.sum("filled").alias("filled"), *bands)


def _signed_sparse(lines: DataFrame, sparse: DataFrame, size: int) -> DataFrame:
    """lines (key, line), and sparse (key, copies), the lines that leave many bins empty -> key, copies and the bands of these."""
    asked = lines.select("key", "line").join(checked_broadcast(sparse, MAX_BROADCAST), "key")
    hashed = _hashed(asked.groupBy("key", "copies").agg(F.min("line").alias("line")), size)
    hashed = hashed.withColumn("h", F.col("h").cast("long").bitwiseAND(2**32 - 1))
    least = [F.min((F.col("h").bitwiseXOR(F.lit(x)) * F.lit(f)).bitwiseAND(2**32 - 1)).alias(m) for m, (x, f) in zip(_LEAST, _PERMUTATIONS)]
    band = [F.xxhash64(*_LEAST[i * ROWS:(i + 1) * ROWS], F.lit(i)).alias(c) for i, c in enumerate(_BAND_NAMES)]
    return hashed.groupBy("key", "copies").agg(*least).select("key", "copies", *band)


def _buckets(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """band, key, leader, members of all buckets with several lines; written."""
    rows = keys.select("key", "copies", F.explode(F.array(*_BAND_NAMES)).alias("band")).where("band is not null")
    of = Window.partitionBy("band")
    told = rows.withColumn("members", F.count("*").over(of)).withColumn("top", F.max(F.struct("copies", "key")).over(of))
    return scratch.put(told.where("members > 1").select("band", "key", F.col("top.key").alias("leader"), "members"))


def _told(lines: DataFrame, keys: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """key, n, sample and tokens (distinct shingles) of the lines of the given keys; written."""
    asked = lines.select("key", "line").join(checked_broadcast(keys, MAX_BROADCAST), "key", "left_semi")
    single = asked.groupBy("key").agg(F.min("line").alias("line"))
    tokens = single.select("key", shingles(F.col("line"), size).alias("tokens"))
    return scratch.put(tokens.select(
        "key", F.size("tokens").alias("n"), F.filter("tokens", lambda t: t.bitwiseAND(SAMPLE - 1) == 0).alias("sample"), "tokens"))


def _alike(threshold: float) -> Column:
    """Whether sizes and samples of two lines, x and y, leave the threshold open. The sample has one in SAMPLE of the
    shingles that differ, as their hashes fall: what five standard deviations and 4 more would not explain is left out."""
    differ = F.size("x.sample") + F.size("y.sample") - 2 * F.size(F.array_intersect("x.sample", "y.sample"))
    most = (F.col("x.n") + F.col("y.n")) * ((1 - threshold) / (1 + threshold) / SAMPLE)
    return (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")) & (differ <= most + 5 * F.sqrt(most) + 4)


def _linked(pairs: DataFrame, told: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of lines that reach the threshold; written."""
    brief = lambda key, name: told.select(F.col("key").alias(key), F.struct("n", "sample").alias(name))
    full = lambda key, name: told.select(F.col("key").alias(key), F.col("tokens").alias(name))
    near = pairs.distinct().join(brief("a", "x"), "a").join(brief("b", "y"), "b").where(_alike(threshold))
    near = scratch.put(near.select("a", "b", (F.col("x.n") + F.col("y.n")).alias("n")))
    common = F.size(F.array_intersect("left", "right"))
    both = near.join(full("a", "left"), "a").join(full("b", "right"), "b").withColumn("common", common)
    links = scratch.put(both.where(F.col("common") >= threshold * (F.col("n") - F.col("common"))).select("a", "b"))
    scratch.drop(near)
    return links


def _rare_pairs(member: DataFrame, told: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """member (key, root, n), written -> the pairs (a, b) of different components that can reach the threshold.

    Two such lines share one of their n - ceil(threshold * n) + 1 rarest shingles, at places that leave enough shingles behind.
    """
    tokens = member.join(told.select("key", "tokens"), "key").select("key", "root", "n", F.explode("tokens").alias("token"))
    tokens = scratch.put(tokens)
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("often", "token")) - 1
    most = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    rows = scratch.put(tokens.join(often, "token").withColumn("place", place).where((F.col("place") < most) & (F.col("often") > 1)))
    mixed = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    rows = scratch.put(rows.join(mixed, "token", "left_semi"))
    other = rows.select("token", F.col("key").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"))
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    enough = left >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-6
    sized = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-6
    return rows.join(other, "token").where((F.col("root") < F.col("other")) & sized & enough).select(F.col("key").alias("a"), "b")


def decide(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row_hash, pos, kept for each line; nulls for documents without lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select("doc_id", "text")
    order = F.when(F.col("doc_id").isNull(), F.lit(2**63 - 1)).otherwise(F.coalesce(F.col("doc_id").try_cast("bigint"), F.xxhash64("doc_id")))
    lines = scratch.put(lines_of(docs))
    found = scratch.put(lines.drop("line"))
    signed = scratch.put(_signed(lines.where("key is not null").select("key", order.alias("place"), "line"), size))
    sparse = scratch.put(_signed_sparse(lines, signed.where(F.col("filled") <= SPARSE).select("key", "copies"), size))
    full = signed.where(F.col("filled") >= FILLED).select("key", "copies", *_BAND_NAMES)
    buckets = _buckets(full.unionByName(sparse), scratch)
    keys = scratch.put(signed.select("key", "copies", "first_doc"))
    scratch.drop(signed, sparse)
    asked = scratch.put(buckets.select("key").distinct())
    told = _told(lines, asked, size, scratch)
    scratch.drop(lines)
    stars = buckets.where("key <> leader").select(F.col("key").alias("a"), F.col("leader").alias("b"))
    first = _linked(stars, told, threshold, scratch)
    known = scratch.put(components(first, scratch))
    # what a leader did not join: pairs of a bucket that are in different components
    member = buckets.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = member.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    member = scratch.put(member.where("key <> leader").join(apart, "band", "left_semi").select("band", "key", "root", "members"))
    other = member.select("band", F.col("key").alias("b"), F.col("root").alias("other"))
    rest = member.where(F.col("members") <= LIMIT).join(other, "band").where("root < other").select(F.col("key").alias("a"), "b")
    crowd = scratch.put(member.where(F.col("members") > LIMIT).select("key", "root").distinct().join(told.select("key", "n"), "key"))
    if not crowd.isEmpty():
        rest = rest.unionByName(_rare_pairs(crowd, told, threshold, scratch))
    second = _linked(rest, told, threshold, scratch)
    near = scratch.put(components(first.unionByName(second), scratch))
    scratch.drop(buckets, asked, told, member)
    # only lines with copies or links can go
    lines = keys.join(near.withColumnRenamed("node", "key"), "key", "left").where(
        "copies > 1 or root is not null").withColumn("root", F.coalesce("root", "key"))
    per_root = lines.groupBy("root").agg(F.min("first_doc").alias("root_doc"))
    lines = scratch.put(lines.join(per_root, "root").select("key", "root", "root_doc"))
    placed = scratch.put(found.join(checked_broadcast(lines, MAX_BROADCAST), "key"))
    stays = placed.where(order == F.col("root_doc")).groupBy("root").agg(F.min(F.struct("row_hash", "pos")).alias("first"))
    stays = scratch.put(stays.select("root", "first.row_hash", F.col("first.pos").alias("pos")))
    gone = placed.join(checked_broadcast(stays.select("root", F.col("row_hash").alias("h"), F.col("pos").alias("p")), MAX_BROADCAST), "root").where(
        (order != F.col("root_doc")) | (F.col("row_hash") != F.col("h")) | (F.col("pos") != F.col("p")))
    marked = found.select("doc_id", "row_hash", "pos", F.lit(True).alias("kept"), F.lit(1).alias("n"))
    both = marked.unionByName(gone.select("doc_id", "row_hash", "pos", F.lit(False).alias("kept"), F.lit(0).alias("n")))
    # dealt by document once, for this and what is counted by document later
    return both.repartition("doc_id", "row_hash").groupBy("doc_id", "row_hash", "pos").agg(F.min("kept").alias("kept"), F.sum("n").alias("n"))


def per_document(decided: DataFrame) -> DataFrame:
    """doc_id, row_hash, n_lines, n_dropped, dropped (line numbers, from 0), a row per document row."""
    rows = decided.groupBy("doc_id", "row_hash").agg(
        F.count("pos").alias("n_lines"), F.sort_array(F.collect_list("pos")).alias("places"),
        F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("pos")))).alias("dropped"), F.max("n").alias("rows"))
    told = rows.select("doc_id", "row_hash", "n_lines", "places", "dropped", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    gone = F.when(F.col("copy") > 1, F.col("places")).otherwise(F.col("dropped"))
    return told.select("doc_id", "row_hash", "n_lines", F.size(gone).cast("bigint").alias("n_dropped"), gone.alias("dropped"))


def clean(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs with the dropped lines cut out of text; all columns and rows stay."""
    rows = decided.groupBy("doc_id", "row_hash").agg(
        F.collect_list(F.when(~F.col("kept"), F.col("pos"))).alias("gone"), F.collect_list("pos").alias("places"), F.max("n").alias("rows"))
    rows = rows.where((F.size("gone") > 0) | (F.col("rows") > 1)).select(
        F.xxhash64("doc_id").alias("id_hash"), "row_hash", "gone", "places", "rows")
    joined = packed(docs).join(rows, ["id_hash", "row_hash"], "left")
    # only rows that others equal are counted off
    copies = joined.where("rows > 1").withColumn("copy", F.row_number().over(Window.partitionBy("id_hash", "row_hash").orderBy("rows")))
    told = joined.where("rows is null or rows = 1").withColumn("copy", F.lit(1)).unionByName(copies)
    text, gone = F.col("doc.text"), F.when(F.col("copy") > 1, F.col("places")).otherwise(F.col("gone"))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    cut = F.when(F.col("gone").isNull() | (F.size(gone) == 0), text).otherwise(left)
    return told.select(F.col("doc").withField("text", cut).alias("doc")).select("doc.*")
