"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1. Per source the rates are tilted as little as possible, in relative
entropy and below an upper bound, so that the expected words of the source meet its target:
rate = min(cap, exp(dual * size / mean size)). The duals solve a convex problem; each Newton step is
one aggregation over the written (source, size) counts, safeguarded by a bracket. Rates are then
rounded into whole copies: per source, sizes are walked from large to small and the error in words is
carried on, so that the copies of a source miss its target by about the smallest size at most. Within
equal size, documents get their copies in the order of a hash of the document id.

Targets: all sources share `budget` times all words by the weights 3, 1, 2 in turn (sources by code
point, null last); a target stops at `cap` times its source's words, and the excess is shared among
the rest by weight until none is above.

Cases: a null or empty text has size 0, takes 0 words and keeps one copy; a null source is a source; a
source without words has target 0; repeated rows are mixed one by one; an empty table gives an empty
table; other columns are ignored by `mix` and kept by `repeat`. Sources are a table for the driver, so
more than MAX_SOURCES raise. One task walks the distinct sizes of one source, never its documents; a
hot source or a hot (source, size) is split by hash buckets of about BUCKET rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgap.llm.common import BLANKS, Scratch, packed, words

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET, CAP = 1.5, 2.0
MAX_SOURCES = 100_000
BUCKET = 500
STEPS = 80


def size_of(text) -> F.Column:
    return F.size(words(text, BLANKS)).cast("bigint")


def targets(sizes: list[float], weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> list[float]:
    """Words of each source, in the order of the sources."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget * sum(sizes)
    while open_:
        share = left / sum(weight[i] for i in open_)
        full = sorted(i for i in open_ if share * weight[i] > cap * sizes[i])
        if not full:
            for i in open_:
                out[i] = share * weight[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def solve_duals(counts: DataFrame, sources: list, cap: float) -> dict[int, float]:
    """The dual of each source: counts has (sid, size, n), sources (sid, words, mean, target)."""
    spark, log_cap = counts.sparkSession, math.log(cap)
    dual, bracket = {}, {}
    todo = {}
    for sid, total, mean, target in sources:
        if target >= cap * total:
            dual[sid] = math.inf
        elif target <= 0:
            dual[sid] = -math.inf
        else:
            dual[sid], bracket[sid], todo[sid] = 0.0, [-math.inf, math.inf], (mean, target)
    for _ in range(STEPS):
        if not todo:
            break
        now = spark.createDataFrame([(s, dual[s], m) for s, (m, _) in todo.items()], "sid int, dual double, mean double")
        x, exponent = F.col("size"), F.col("dual") * F.col("size") / F.col("mean")
        rate = F.exp(F.least(exponent, F.lit(log_cap)))
        step = (
            counts.join(F.broadcast(now), "sid")  # one row per source, MAX_SOURCES at most
            .groupBy("sid", "mean")
            .agg(F.sum(F.col("n") * x * rate).alias("words"),
                 F.sum(F.when(exponent < log_cap, F.col("n") * x * rate * x / F.col("mean"))).alias("slope"))
            .collect()
        )
        for r in step:
            sid, (_, target) = r["sid"], todo[r["sid"]]
            miss, at, edge = r["words"] - target, dual[r["sid"]], bracket[r["sid"]]
            if abs(miss) <= 1e-9 * target:
                del todo[sid]
                continue
            edge[miss > 0] = at
            new = at - miss / r["slope"] if r["slope"] else at - math.copysign(1.0, miss)
            lo, hi = edge
            if not lo < new < hi:
                new = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else at - math.copysign(max(1.0, abs(at)), miss)
            if new == at or hi - lo < 1e-13 * max(1.0, abs(at)):
                del todo[sid]
                continue
            dual[sid] = new
    return dual


def _whole_copies(group: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Copies of all documents of each size of one source."""
    group = group.sort_values("size", ascending=False)
    wanted = taken = 0.0
    copies = []
    for size, n, rate in zip(group["size"], group["n"], group["rate"]):
        if size == 0:
            copies.append(n)
            continue
        wanted += n * rate * size
        k = min(max(round((wanted - taken) / size), 0), int(cap * n))
        taken += k * size
        copies.append(k)
    return group.assign(copies=copies)[["sid", "size", "n", "rate", "copies"]]


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, rate, copies, taken, and
    row_hash, a hash of the document's text."""
    scratch = Scratch(docs.sparkSession, "mix")
    spark = docs.sparkSession
    sized = scratch.put(docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("row_hash"),
        (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 12) / float(1 << 52)).alias("u"),
    ))
    listed = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([float(r["words"]) for r in listed], weights, budget, cap)
    rows = [(i, r["source"], r["words"], max(r["words"] / r["n"], 1e-9), t) for i, (r, t) in enumerate(zip(listed, goal))]
    sources = F.broadcast(spark.createDataFrame(rows, "sid int, source string, source_size bigint, mean double, target double"))
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    counts = scratch.put(placed.groupBy("sid", "size").agg(F.count("*").alias("n")))
    dual = solve_duals(counts, [(r[0], r[2], r[3], r[4]) for r in rows], cap)
    solved = F.broadcast(spark.createDataFrame([(r[0], dual[r[0]], r[3]) for r in rows], "sid int, dual double, mean double"))
    rate = (F.when(F.col("size") == 0, 1.0).when(F.col("dual") == math.inf, cap).when(F.col("dual") == -math.inf, 0.0)
            .otherwise(F.exp(F.least(F.col("dual") * F.col("size") / F.col("mean"), F.lit(math.log(cap))))))
    # one task walks one source's distinct sizes
    plan = scratch.put(
        counts.join(solved, "sid").select("sid", "size", "n", rate.alias("rate")).groupBy("sid")
        .applyInPandas(lambda g: _whole_copies(g, cap), "sid int, size bigint, n bigint, rate double, copies bigint"))
    # a rank within (source, size) by hash buckets: first the buckets' offsets, then ranks inside buckets
    dealt = placed.join(plan, ["sid", "size"]).withColumn(
        "bucket", F.floor(F.col("u") * F.ceil(F.col("n") / BUCKET)).cast("bigint"))
    offsets = dealt.groupBy("sid", "size", "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    inside = Window.partitionBy("sid", "size", "bucket").orderBy("u", "doc_id", "row_hash")
    ranked = dealt.withColumn("rank", F.row_number().over(inside)).join(offsets, ["sid", "size", "bucket"])
    whole = F.floor(F.col("copies") / F.col("n"))
    own = whole + (F.col("offset") + F.col("rank") <= F.col("copies") - whole * F.col("n")).cast("bigint")
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", "rate",
        own.cast("bigint").alias("copies"), (own * F.col("size")).cast("bigint").alias("taken"), "row_hash")


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as `mixed` takes it. Rows that are alike in doc_id and text share
    their copies: each gets its part, the first ones one more."""
    total = mixed.groupBy(F.xxhash64("doc_id").alias("id_hash"), "row_hash").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("alike"))
    same = Window.partitionBy("id_hash", "row_hash").orderBy("copies")  # the join's keys: no further shuffle
    numbered = packed(docs).join(total, ["id_hash", "row_hash"]).withColumn("nth", F.row_number().over(same))
    own = F.floor(F.col("copies") / F.col("alike")) + (F.col("nth") <= F.col("copies") % F.col("alike")).cast("bigint")
    return numbered.select("doc", F.explode(F.array_repeat(F.lit(1), own.cast("int")))).select("doc.*")
