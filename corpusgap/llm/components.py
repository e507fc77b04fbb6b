"""Distributed union-find: connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.llm.common import Scratch

MAX_ROUNDS = 60


def _links(df: DataFrame) -> DataFrame:
    return df.where("a <> b").distinct()


def _state(df: DataFrame):
    return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b), without nulls -> node, root; root is the smallest node of the component.

    A large star hangs all larger neighbours of a node on its smallest neighbour, a small star the
    smaller ones and itself. Both shuffle links only; the smallest neighbour is found with map-side
    combine, so a hub is never gathered. The stars have settled once a round changes no link.
    """
    now = scratch.put(_links(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _links(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        hung = least.select("a", F.col("m").alias("b"))
        after = scratch.put(_links(small.unionByName(hung)))
        changed = _state(after)
        scratch.drop(now)
        now = after
        if changed == state:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        state = changed
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
