"""Quality rules: a trusted-to-raw log-likelihood ratio of hashed n-grams, and plain text counts.

Words and word pairs are hashed into BUCKETS places. Two multinomials over the places are counted over
all rows: of the raw corpus (every document) and of the trusted target (documents labelled as good).
A document's score is the mean, over its n-grams, of ln(p_target / p_raw), both with add-one
smoothing. The threshold is one number for all documents: of the scores' 0.001 grid, the lowest point
at which good labelled documents passed and bad labelled documents stopped are most (as the sum of
both shares); without bad labels, the lowest score of a good one; without labels, everything passes.

Base counts (see `measures`) decide first: a document fails with fewer than 10 words, or if over 20%
of its words lie in 5-word windows that its text has twice.

Cases: null, empty and blank texts have no words, score 0 and fail the base rules; labels with a null
id or null quality are ignored; several labels of one id count as their lowest; repeated rows count
as rows; an empty table gives an empty table; other columns are ignored. Tables that go to the driver
or to all tasks have BUCKETS rows, or one row per point of the score grid.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.llm.common import Scratch, checked_broadcast

BUCKETS = 1 << 16
GRID = 1_000
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
MAX_BROADCAST_LABELS = 2_000_000  # of 12 bytes each

_BLANKS, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], np.uint64)


def _numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its first occurrence among distinct words; hashes of these."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, np.fromiter(map(zlib.crc32, seen), np.uint64, len(seen))


def _buckets(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of all words and word pairs."""
    h = hashes[ids]
    pairs = (h[:-1] * _FACTORS[0] ^ h[1:]) * _MIX
    return (np.concatenate([h * _MIX, pairs]) >> np.uint64(48)).astype(np.int64)


def buckets_of(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return _buckets(*_numbered(words)) if words else np.empty(0, np.int64)


def _repeated(ids: np.ndarray) -> int:
    """Words inside 5-word windows that occur twice or more, by 64-bit fingerprints of windows."""
    if len(ids) <= WINDOW:
        return 0
    factors = _FACTORS[np.arange(WINDOW) % len(_FACTORS)]
    n = len(ids) - WINDOW + 1
    own = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    own ^= own >> np.uint64(29)
    prints = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        prints += own[k:k + n] * factors[k]
    _, at, counts = np.unique(prints, return_inverse=True, return_counts=True)
    starts = np.zeros(len(ids) + 1, np.int64)
    hot = np.flatnonzero(counts[at] > 1)
    np.add.at(starts, hot, 1)
    np.add.at(starts, hot + WINDOW, -1)
    return int((np.cumsum(starts)[:-1] > 0).sum())


def measures(text: str | None, ratio: np.ndarray | None = None) -> tuple[int, int, int, int, int, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    ids, hashes = _numbered(words)
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    score = 0.0
    if words and ratio is not None:
        score = float(ratio[_buckets(ids, hashes)].mean())
    return (
        len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)), _repeated(ids), score,
    )


def with_labels(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text) with the lowest quality label, null where there is none."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = scratch.put(known.groupBy("doc_id").agg(F.min("quality").alias("quality")))
    return docs.select("doc_id", "text").join(checked_broadcast(known, MAX_BROADCAST_LABELS), "doc_id", "left")


def log_ratio(labelled: DataFrame) -> np.ndarray:
    """ln(p_target / p_raw) of every place, from the counts of all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, quality in zip(batch["text"], batch["quality"]):
                seen = np.bincount(buckets_of(text), minlength=BUCKETS)
                raw += seen
                if quality == 1:
                    good += seen
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"at": at, "raw": raw[at], "good": good[at]})

    counted = labelled.select("text", "quality").mapInPandas(count, "at long, raw long, good long")
    rows = counted.groupBy("at").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # BUCKETS rows
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in rows:
        raw[r["at"]] += r["raw"]
        good[r["at"]] += r["good"]
    if good.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def measured(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs (doc_id, text, quality) -> doc_id, quality, the counts and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [measures(t, shared.value) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out.insert(1, "quality", batch["quality"].to_numpy())
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, " + ", ".join(f"{n} long" for n in names[:-1]) + ", score double"
    return docs.select("doc_id", "text", "quality").mapInPandas(run, schema)


def threshold(scored: DataFrame) -> float:
    """The score from which documents pass, by the labelled ones."""
    point = F.floor(F.col("score") * GRID).cast("long")
    rows = sorted(
        scored.where("quality is not null").groupBy(point.alias("at"))
        .agg(F.sum((F.col("quality") == 1).cast("int")).alias("good"), F.sum((F.col("quality") != 1).cast("int")).alias("bad"))
        .collect())
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good:
        return -np.inf
    if not bad:
        return min(r["at"] for r in rows) / GRID
    best, at, passed, stopped = -1.0, -np.inf, good, 0
    for r in rows:
        if (gain := passed / good + stopped / bad) > best:
            best, at = gain, r["at"] / GRID
        passed -= r["good"]
        stopped += r["bad"]
    return at


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, counts, base_failed, score, kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    labelled = with_labels(docs, labels, scratch)
    scored = scratch.put(measured(labelled, log_ratio(labelled)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return scored.drop("quality").withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("score") >= threshold(scored)))
