"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or not: words, word pairs, and pairs with one and two words between them, hashed
into DIMENSIONS places. Each coordinate has its own learning rate; L1 keeps most weights at zero, and
the rest is broadcast (at most DIMENSIONS pairs). Learning takes a bounded sample of labelled rows:
MAX_LABELLED by the order of a hash of their ids, in one task. Scoring covers every whole text.

Cases: null, empty and wordless texts get the score of the bias alone; a null label is no label; of
several labels of one id the highest counts; rows with a null id are scored and never learned from;
without any label (or with one class only) every score is the share of toxic labels, 0 if there is
none; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgap.llm.common import WORD

DIMENSIONS = 1 << 20
MAX_LABELLED = 20_000
MIN_ROWS = 3  # labelled rows that a place must occur in to be a coordinate
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0
TOXIC_WEIGHT = 3.0  # the rarer class weighs more, as a missed toxic text costs more

_WORDS = re.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GAPS = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def places(text: str | None) -> np.ndarray:
    """Hashed places of all n-grams and skip-grams of a text, repeated ones included."""
    found = _WORDS.findall(text.lower()) if text else []
    if not found:
        return np.empty(0, np.int64)
    h = np.fromiter(map(zlib.crc32, " ".join(found).encode("utf-8", "surrogatepass").split(b" ")), np.uint64, len(found))
    grams = [h * _MIX]
    for gap, factor in enumerate(_GAPS, start=1):
        if len(h) > gap:
            grams.append((h[:-gap] * factor ^ h[gap:]) * _MIX)
    return (np.concatenate(grams) >> np.uint64(44)).astype(np.int64)


def fit(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and weights that are not zero, and the bias; passes in the order of the rows."""
    z, n, w = (np.zeros(DIMENSIONS) for _ in range(3))
    share = sum(labels) / len(labels) if labels else 0.0
    if share in (0.0, 1.0):
        return np.empty(0, np.int32), np.empty(0), (-np.inf, np.inf)[int(share)]
    bias = np.log(share / (1 - share))
    bias_n = 0.0
    rows = [np.unique(places(t)).astype(np.int32) for t in texts]
    common = np.zeros(DIMENSIONS, np.int32)
    for at in rows:
        common[at] += 1
    rows = [at[common[at] >= MIN_ROWS] for at in rows]
    for _ in range(EPOCHS):
        for at, label in zip(rows, labels):
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(bias + wi.sum(), -35, 35)))
            g = (p - label) * (TOXIC_WEIGHT if label else 1.0)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * wi
            n[at] = ni + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    live = np.flatnonzero(np.abs(z) > L1)
    w = (np.sign(z[live]) * L1 - z[live]) / ((BETA + np.sqrt(n[live])) / ALPHA + L2)
    return live.astype(np.int32), w, float(bias)


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, max_labelled: int = MAX_LABELLED):
    """The model from labelled documents of which `may_learn` (over doc_id) holds."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may_learn)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_labelled rows

    def train(group: pd.DataFrame) -> pd.DataFrame:
        order = pd.util.hash_array(group["doc_id"].to_numpy())
        group = group.assign(o=order).sort_values(["o", "text"], na_position="first")
        at, w, bias = fit(group["text"].tolist(), group["toxic"].tolist())
        return pd.DataFrame({"at": np.append(at, -1), "weight": np.append(w, bias)})

    # the bounded sample meets in one task
    model = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "at int, weight double").collect()
    at = np.array([r["at"] for r in model if r["at"] >= 0], np.int64)
    weight = np.array([r["weight"] for r in model if r["at"] >= 0])
    bias = next((r["weight"] for r in model if r["at"] < 0), -np.inf)
    return at, weight, bias


def _scorer(docs: DataFrame, model):
    """A vectorised function from texts to scores; the weights are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weight, bias = shared.value
        w, live = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS, bool)
        w[at], live[at] = weight, True
        for texts in batches:
            total = np.empty(len(texts))
            for i, text in enumerate(texts):
                p = places(text)
                total[i] = w[np.unique(p[live[p]])].sum()
            with np.errstate(over="ignore"):
                yield pd.Series(1 / (1 + np.exp(-(bias + total))))

    return F.pandas_udf(run, "double")


def score(docs: DataFrame, model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, predicted."""
    scored = docs.select("doc_id", _scorer(docs, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model) -> DataFrame:
    """The rows of docs, all columns, that score below 0.5."""
    return docs.where(_scorer(docs, model)("text") < 0.5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))

