"""N-gram Jaccard join on chosen paths: near copies of whole texts by word shingles.

A text is the set of its `size`-word shingles (lower-cased words; a text of fewer words, but not none, is
one shingle), kept as sorted 32-bit hashes. Texts of equal sets are one class, so exact copies cost one
row. Each run samples tokens of a set with probability 1 / (threshold * set size), by a hash that all
texts share, and puts the set into the bucket of each sampled token. A bucket over `limit` is split again
on further sampled tokens, up to `depth` times. Two sets of Jaccard similarity `threshold` share a bucket of
a run with probability 0.63 or more, and runs are repeated until the chance of a miss is below 1 - recall.

Buckets are searched by brute force in two passes. First every member meets the bucket's leader (the class
with most copies), then all pairs meet whose members are still in different components; both are filtered by
256-bit sketches. Members of buckets that stay over `limit` (texts around one shared passage) meet by their
rarest tokens instead, which misses no pair. All pairs are checked exactly on the sets. So a large group of near copies is joined by its leader
and never written as pairs. Links are then counted: all links lie inside components, whose members meet in
blocks of BLOCK; only counts leave a block. No link is lost but by the recall of the runs.

Cases: null, empty and wordless texts link to nothing and are a class each; repeated rows are copies; a class
id is the smallest document id of its component (null if all are null); an empty table gives an empty table;
other columns are ignored by `near_copies` and kept by `keep_one`. 32-bit hashes of two shingles of a pair of
500-shingle texts are equal by chance once in 10,000 pairs, which moves the similarity by 0.001.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgap.llm.common import WORD, Scratch, checked_broadcast, packed
from corpusgap.llm.components import components

THRESHOLD, SIZE = 0.8, 5
RECALL, LIMIT, DEPTH = 0.9999, 200, 3
BITS, SURE = 256, 128  # sketches say little about sets of fewer than SURE shingles
BLOCK = 500
PLACES = 1 << 16  # counters of tokens
MAX_BROADCAST = 500_000

_WORDS = re.compile(WORD)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_STARTS = (np.arange(BITS, dtype=np.uint64) * np.uint64(2**32 // BITS)).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's shingles."""
    found = _WORDS.findall(text.lower()) if text else []
    if not found:
        return np.empty(0, np.uint32)
    h = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    n = max(len(h) - size + 1, 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        total = mixed(total * _ODD[0] + h[k:k + n] + np.uint64(k))
    return np.unique((total >> np.uint64(32)).astype(np.uint32))


def sketch(tokens: np.ndarray) -> list[int]:
    """One bit of the next hash from each of BITS places on, the first one after the last."""
    at = np.searchsorted(tokens, _STARTS) % len(tokens)
    bits = (mixed(tokens[at].astype(np.uint64)) >> np.uint64(20)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def sampled(tokens: np.ndarray, node: int, threshold: float) -> np.ndarray:
    """Buckets below a node of the tree (a run's root, or a bucket) that the set goes to."""
    u = mixed(tokens.astype(np.uint64) * _ODD[1] + np.uint64(node % 2**64))
    chosen = u[(u >> np.uint64(32)) < np.uint64(min(2**32, int(2**32 / (threshold * len(tokens)))))]
    return mixed(chosen + np.uint64(node * int(_ODD[2]) % 2**64)).view(np.int64)


def runs_for(recall: float, threshold: float) -> int:
    """Runs until a pair at the threshold is missed with probability 1 - recall at most: it shares
    at least one token of the larger set in `threshold` of the cases, so a run finds it with 1 - 1/e."""
    return math.ceil(math.log(1 - recall) / -1.0)


def sets_of(docs: DataFrame, size: int, threshold: float, runs: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row_hash, key, n, sketch, buckets, tokens; key tells equal sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                t = shingles(text, size)
                raw = t.tobytes()
                if len(t):
                    buckets = np.concatenate([sampled(t, r + 1, threshold) for r in range(runs)]).tolist()
                    rows.append((hashlib.blake2b(raw, digest_size=16).digest(), len(t), sketch(t), buckets, raw))
                else:
                    rows.append((None, 0, None, None, None))
            out = pd.DataFrame(rows, columns=["key", "n", "sketch", "buckets", "tokens"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "row_hash", batch["row_hash"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).mapInPandas(
        run, f"doc_id {kind}, row_hash long, key binary, n int, sketch array<long>, buckets array<long>, tokens binary")


def alike(threshold: float) -> Column:
    """Whether the sizes and sketches of two members, x and y, leave the threshold open."""
    differ = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(BITS // 64)), F.lit(0))
    lowest = 1 - 2 * differ / BITS >= threshold - 0.2
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    return (small >= threshold * large) & (lowest | (small < SURE))


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = both / (len(x) + len(y) - both)
    return pd.Series(out)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of keys whose sets reach the threshold; written."""
    pairs = scratch.put(pairs.distinct())
    keys = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    used = scratch.put(sets.select("key", "tokens").join(checked_broadcast(keys, MAX_BROADCAST), "key", "left_semi")
                       .dropDuplicates(["key"]))
    left = used.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    right = used.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    similarity = F.pandas_udf(_jaccard, "double")
    links = scratch.put(pairs.join(left, "a").join(right, "b").where(similarity("ta", "tb") >= threshold).select("a", "b"))
    scratch.drop(pairs, keys, used)
    return links


def _leaves(classes: DataFrame, sets: DataFrame, threshold: float, limit: int, depth: int, scratch: Scratch) -> DataFrame:
    """bucket, x (copies, key, n, sketch), members of all buckets with several members, split where large; written."""
    rows = scratch.put(classes.select(F.explode("buckets").alias("bucket"), "key"))
    leaves, parts = None, []
    for level in range(1, depth + 1):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
        sized = scratch.put(rows.join(sizes, "bucket"))
        scratch.drop(rows)
        parts.append(sized)
        small = sized if level == depth else sized.where(F.col("members") <= limit)
        leaves = small if leaves is None else leaves.unionByName(small)
        large = sized.where(F.col("members") > limit).select("bucket", "key")
        if level == depth or large.isEmpty():
            break
        keys = scratch.put(large.select("key").distinct())
        parts.append(keys)
        tokens = sets.select("key", "tokens").join(checked_broadcast(keys, MAX_BROADCAST), "key", "left_semi").dropDuplicates(["key"])

        def split(buckets: pd.Series, tokens: pd.Series) -> pd.Series:
            return pd.Series([sampled(np.frombuffer(t, np.uint32), b, threshold).tolist() for b, t in zip(buckets, tokens)])

        below = F.pandas_udf(split, "array<long>")
        rows = scratch.put(large.join(tokens, "key").select(F.explode(below("bucket", "tokens")).alias("bucket"), "key"))
    told = classes.select("key", F.struct("copies", "key", "n", "sketch").alias("x"))
    out = scratch.put(leaves.join(told, "key").select("bucket", "x", "members"))
    scratch.drop(*parts)
    return out


def _frequencies(tokens: DataFrame) -> np.ndarray:
    """How many sets have a token of each of the PLACES hashed places."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for t in batch["tokens"]:
                total += np.bincount(np.frombuffer(t, np.uint32) % PLACES, minlength=PLACES)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    out = np.zeros(PLACES, np.int64)
    for r in tokens.select("tokens").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]  # PLACES rows at most
    return out


def rarest(tokens: np.ndarray, frequencies: np.ndarray, threshold: float) -> np.ndarray:
    """The n - ceil(threshold * n) + 1 first tokens of a set, in one order for all sets: rare places first."""
    most = len(tokens) - math.ceil(threshold * len(tokens) - 1e-9) + 1
    return tokens[np.lexsort((tokens, frequencies[tokens % PLACES]))[:most]]


def rare_pairs(member: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """member (key, root, n), written -> the pairs (a, b) of different components that can reach the threshold.

    Two such sets share one of their rarest tokens, at places that leave enough tokens behind them. A token
    that many members share is rare in none of them but in copies of each other.
    """
    tokens = sets.select("key", "tokens").join(checked_broadcast(member.select("key"), MAX_BROADCAST), "key", "left_semi").dropDuplicates(["key"])
    tokens = scratch.put(tokens)
    shared = member.sparkSession.sparkContext.broadcast(_frequencies(tokens))  # PLACES numbers

    def first_of(column: pd.Series) -> pd.Series:
        return pd.Series([rarest(np.frombuffer(t, np.uint32), shared.value, threshold).astype(np.int64) for t in column])

    first = F.pandas_udf(first_of, "array<long>")
    rows = scratch.put(member.join(tokens, "key").select("key", "root", "n", F.posexplode(first("tokens")).alias("place", "token")))
    mixed = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    rows = scratch.put(rows.join(mixed, "token", "left_semi"))
    other = rows.select("token", F.col("key").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"))
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    enough = most >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-6
    sized = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-6
    return rows.join(other, "token").where((F.col("root") < F.col("other")) & sized & enough).select(F.col("key").alias("a"), "b")


def _count_links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of each member, inside components and between the two blocks of the group."""
    out = []
    for _, part in group.groupby("root", sort=False):
        sets = [np.frombuffer(t, np.uint32) for t in part["tokens"]]
        sizes = np.array([len(s) for s in sets])
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = np.zeros((len(sets), len(sets)), np.float32)
        several = np.bincount(at) > 1
        number = np.cumsum(several) - 1
        live = several[at]
        row, at = row[live], number[at[live]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        step = 8192
        for start in range(0, int(several.sum()), step):
            lo, hi = np.searchsorted(at, (start, start + step))
            dense = np.zeros((len(sets), step), np.float32)
            dense[row[lo:hi], at[lo:hi] - start] = 1
            shared += dense @ dense.T
        linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
        np.fill_diagonal(linked, False)
        block = part["block"].to_numpy()
        if part["i"].iloc[0] != part["j"].iloc[0]:
            linked &= block[:, None] != block[None, :]
        out.append(pd.DataFrame({"key": part["key"].to_numpy(), "links": linked.sum(axis=1)}))
    return pd.concat(out)


def _link_counts(member: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """member (key, root), written -> key, n_links."""
    sizes = scratch.put(member.groupBy("root").agg(F.count("*").alias("m")))
    packs = max(1, math.ceil(member.count() / BLOCK))
    used = sets.select("key", "tokens").join(checked_broadcast(member.select("key"), MAX_BROADCAST), "key", "left_semi").dropDuplicates(["key"])
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = member.join(sizes, "root").join(used, "key").select(
        "key", "root", "tokens", blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"))
    # small components share a group; a large one has a group for each pair of its blocks
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(packs)).cast("string")).otherwise(F.hex("root"))
    paired = placed.withColumn("pack", pack).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    counted = paired.groupBy("pack", "i", "j").applyInPandas(lambda g: _count_links(g, threshold), "key binary, links long")
    return counted.groupBy("key").agg(F.sum("links").alias("n_links"))


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, recall: float = RECALL,
                limit: int = LIMIT, depth: int = DEPTH, count_links: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row_hash, n_shingles, text_id, n_copies, class_id, n_links, root.

    root: the component itself, null for texts without words; text_id: smallest id of the documents with the same shingles, n_copies: how many these are;
    class_id: smallest id of the component; n_links: other texts (not documents) at the threshold.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    sets = scratch.put(sets_of(docs, size, threshold, runs_for(recall, threshold)))
    some = sets.where("key is not null")
    classes = scratch.put(some.groupBy("key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("text_id"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets")))
    leaves = _leaves(classes, some, threshold, limit, depth, scratch)
    leader = leaves.groupBy("bucket").agg(F.max("x").alias("y"))
    stars = leaves.join(leader, "bucket").where((F.col("x.key") != F.col("y.key")) & alike(threshold))
    first = _linked(stars.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")), some, threshold, scratch)
    known = scratch.put(components(first, scratch))
    # what a leader did not join: pairs of a bucket that are in different components
    member = leaves.withColumn("node", F.col("x.key")).join(known, "node", "left").select(
        "bucket", "x", "members", F.coalesce("root", "node").alias("root"))
    mixed = member.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    member = scratch.put(member.join(mixed, "bucket", "left_semi"))
    other = member.select("bucket", F.col("x").alias("y"), F.col("root").alias("other"))
    rest = member.where(F.col("members") <= limit).join(other, "bucket").where((F.col("root") < F.col("other")) & alike(threshold))
    rest = rest.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    crowd = scratch.put(member.where(F.col("members") > limit).select("x.key", "root", "x.n").distinct())
    if not crowd.isEmpty():
        rest = rest.unionByName(rare_pairs(crowd, some, threshold, scratch))
    second = _linked(rest, some, threshold, scratch)
    scratch.drop(leaves, member)
    found = scratch.put(components(first.unionByName(second), scratch))
    grouped = scratch.put(classes.select("key", "text_id", "copies").join(
        found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    named = grouped.groupBy("root").agg(F.min("text_id").alias("class_id"))
    told = grouped.join(named, "root")
    if count_links:
        told = told.join(_link_counts(scratch.put(found.withColumnRenamed("node", "key")), some, threshold, scratch), "key", "left")
    else:
        told = told.withColumn("n_links", F.lit(None).cast("long"))
    told = told.select("key", "root", "text_id", "copies", "class_id", "n_links")
    return sets.select("doc_id", "row_hash", "key", "n").join(told, "key", "left").select(
        "doc_id", "row_hash", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), "root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, but of each component only the one with the smallest id (then
    the smallest text hash). Texts without words stay."""
    scratch = Scratch(docs.sparkSession, "keep")
    found = scratch.put(near_copies(docs, count_links=False, **options).where("root is not null"))
    rows = found.groupBy("root", "doc_id", "row_hash").agg(F.count("*").alias("rows"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "row_hash")).alias("first"))
    marked = scratch.put(rows.join(first, "root").select(
        F.xxhash64("doc_id").alias("id_hash"), "row_hash", "rows",
        (F.struct("doc_id", "row_hash").eqNullSafe(F.col("first"))).alias("stays")))
    keys, several = ["id_hash", "row_hash"], F.col("rows") > 1  # rows that are alike in id and text
    gone = scratch.put(marked.where(~F.col("stays") | several).select(keys))
    again = scratch.put(marked.where(F.col("stays") & several).select(keys))
    single = packed(docs).join(checked_broadcast(gone, MAX_BROADCAST), keys, "left_anti").select("doc.*")
    if again.isEmpty():
        return single
    one = packed(docs).join(checked_broadcast(again, MAX_BROADCAST), keys, "left_semi").dropDuplicates(keys)
    return single.unionByName(one.select("doc.*"))
