"""Language-model scoring with a probabilistic suffix tree over words.

A state of the tree is a context: the last 1 .. DEPTH words. Contexts that occur LEAST times or more in the learning
texts are candidates; one is retained if its next-word distribution diverges enough from that of the context one word
shorter: n * KL >= COST * (distinct next words), so each successor that a state stores has to pay for itself. A word is
scored in the state of the longest retained suffixes, whose distributions are smoothed towards each other by absolute
discounting: P(w | s) = (max(c(sw) - DISCOUNT, 0) + DISCOUNT * t(s) * P(w | shorter)) / n(s), with c counts, n the
context's count, t its number of successors. The root is the base model, (c + 0.1) / (N + 0.1 (V + 1)) with one class
of unknown words, so that every state's probabilities add up to 1.

How it runs. Texts are read once, into written blocks of about BLOCK bytes of text: hashed words, as numbers of a
dictionary of their own. All that the blocks have to learn of the whole corpus comes from one kind of exchange:
a block sends its distinct keys with its own sums, sorted, in as many ranges of keys as the corpus needs; each
range is added up over all blocks, and every block gets the totals of its keys back. Sums are taken over positions:
first the counts of words and pairs, then those of longer sequences whose context is a candidate, and last the
divergence and the number of successors of the contexts (the sum of 1 / c(sw) over the positions). Nothing is gathered
on the driver but N, V and the number of ranges; no table of the model is broadcast. Keys are hashes, and a block
sends a key once, so that frequent words, hot sources and copies load no range more than others. The blocks lie in a table
that is bucketed by block, so that only the totals are shuffled when they come back.

Sequences are known by 55-bit hashes: among 10^8 distinct ones about one pair falls together, among 10^13 one in four
thousand. Memory grows with a block (about 150 bytes a word) and with the longest text, which is never cut into
blocks. Sums of divergences are rounded to 32 bits a block.

Cases: null and empty texts have only their end; all texts end with one end token, which is never a context; contexts
do not cross texts; repeated texts and ids are scored one by one and learned from as often as they occur; without
learning texts every token is unknown, with N = V = 0; an empty table gives an empty table; other columns, whatever
their names, are kept in `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgap.llm import hashed_words
from corpusgap.llm.common import Scratch
from corpusgap.llm.hashed_words import mixed

DEPTH, LEAST = 3, 8
COST, DISCOUNT = 4.0, 0.75  # chosen on a tenth of the learning texts
ADDED = 0.1
BLOCK = 2 << 20  # bytes of text
RANGE = 1 << 19  # tokens of the corpus for each range of keys
BLOCKS_PER_BUCKET = 8
KEY_BITS = 56  # the last one tells words from sequences
END = np.uint64(7)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# numbers as bytes

def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed: their lowest bytes, then the next ones, as many as the largest needs."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising keys, as differences."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data)).view(np.uint64)


class Block:
    """A block of texts, and what it knows of the corpus: counts of the sequences that end at each position."""

    def __init__(self, row: dict, least: int):
        self.least = least
        self.lengths = unpack(row["lengths"])
        self.tokens = unpack_sorted(row["vocabulary"])[unpack(row["ids"])]
        self.learned = np.repeat(unpack(row["learned"]).astype(bool), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.starts = starts
        self.offset = np.arange(len(self.tokens)) - np.repeat(starts, self.lengths)
        self.counts = [unpack(c) for c in row["counts"]]
        self.grams = [self.tokens]

    def gram(self, level: int) -> np.ndarray:
        """A hash of the token of each position and the `level` ones before it."""
        while len(self.grams) <= level:
            k, n = len(self.grams), len(self.tokens)
            longer = np.zeros(n, np.uint64)
            longer[k:] = mixed(self.grams[-1][k:] * _STEP + self.tokens[:max(n - k, 0)])
            self.grams.append(longer)
        return self.grams[level]

    def before(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, values.dtype), values[:-1]])

    def candidates(self, level: int) -> np.ndarray:
        """Positions whose last `level` words are a candidate context. Pairs are counted in the same exchange as
        words, so all of them are looked up."""
        whole = self.offset >= level
        return whole & (self.before(self.counts[level - 1]) >= self.least) if level and len(self.counts) >= level else whole

    def wanted(self, levels: range) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct keys of the sequences of these levels, the positions of each level, the key of each of these,
        and how often each key occurs in learning texts."""
        places = [np.flatnonzero(self.candidates(k)) for k in levels]
        keys = np.concatenate([key_of(self.gram(k)[at], k == 0) for k, at in zip(levels, places)])
        distinct, which = np.unique(keys, return_inverse=True)
        learned = np.concatenate([self.learned[at] for at in places])
        return distinct, places, which, np.bincount(which, learned, len(distinct)).astype(np.int64)

    def contexts(self, depth: int, tokens: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the candidate contexts, the positions after those of each level, the key of each, and the
        block's share of each one's divergence and successors."""
        places = [np.flatnonzero(self.candidates(k)) for k in range(1, depth + 1)]
        keys, gains, parts = [], [], []
        for k, at in enumerate(places, 1):
            keys.append(key_of(self.gram(k - 1)[at - 1], False))
            learned = self.learned[at]
            count = np.maximum(self.counts[k][at], 1)
            shorter = self.counts[k - 2][at - 1] if k > 1 else tokens
            gain = np.log(count / self.counts[k - 1][at - 1]) - np.log(np.maximum(self.counts[k - 1][at], 1) / shorter)
            gains.append(np.where(learned, gain, 0))
            parts.append(np.where(learned, 1 / count, 0))
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        return (distinct, places, which, np.bincount(which, np.concatenate(gains), len(distinct)),
                np.bincount(which, np.concatenate(parts), len(distinct)))

    def scores(self, depth: int, tokens: int, kinds: int, discount: float, successors: list[np.ndarray],
               places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text. successors: 0 where a context was not retained."""
        chance = (self.counts[0] + ADDED) / (tokens + ADDED * (kinds + 1))
        base = self.totals(np.log10(chance))
        for k in range(1, depth + 1):
            kept = successors[k - 1] > 0
            at, t = places[k - 1][kept], successors[k - 1][kept]
            own = np.maximum(self.counts[k][at] - discount, 0)
            chance[at] = (own + discount * t * chance[at]) / self.counts[k - 1][at - 1]
        return self.totals(self.counts[0] > 0).astype(np.int64), base, self.totals(np.log10(chance))

    def totals(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), self.starts)


def key_of(gram: np.ndarray, word: bool) -> np.ndarray:
    """Keys of KEY_BITS bits; those of words are odd."""
    gram = mixed(gram + _STEP)
    return (gram >> np.uint64(64 - KEY_BITS + 1) << np.uint64(1)) | np.uint64(word)


# blocks

BLOCK_COLUMNS = ["lengths", "learned", "vocabulary", "ids", "counts"]


def blocks_of(docs: DataFrame, learned: Column, size: int) -> DataFrame:
    """docs (text, ...) -> blocks of texts: their other columns, their tokens; no counts yet."""
    others = [docs[c] for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("doc"), docs["text"].alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashed_words.buffers(batch.column("text"))
            flags = batch.column("learned").to_numpy(zero_copy_only=False)
            for a, b in hashed_words.groups(offsets, size):
                at = offsets[a:b + 1]
                words = hashed_words.split(data[at[0]:at[-1]], at - at[0], lower=True)
                tokens = np.full(len(words.hash) + b - a, END, np.uint64)
                tokens[np.arange(len(words.hash)) + words.text] = words.hash >> np.uint64(64 - KEY_BITS)
                vocabulary, ids = np.unique(tokens, return_inverse=True)
                docs_of = batch.column("doc").slice(a, b - a)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), docs_of),
                    pa.array([len(tokens)], pa.int64()), pa.array([int(np.sum((words.counts + 1)[flags[a:b]]))], pa.int64()),
                    pa.array([pack(words.counts + 1)]), pa.array([pack(flags[a:b])]),
                    pa.array([pack_sorted(vocabulary)], pa.binary()), pa.array([pack(ids)]), pa.array([[]], pa.list_(pa.binary())),
                ], names=["docs", "tokens", "learned_tokens", "lengths", "learned", "vocabulary", "ids", "counts"])

    kind = rows.schema["doc"].dataType.simpleString()
    cut = rows.mapInArrow(run, f"docs array<{kind}>, tokens bigint, learned_tokens bigint, lengths binary, "
                          "learned binary, vocabulary binary, ids binary, counts array<binary>")
    return cut.withColumn("block", F.monotonically_increasing_id())


def _ranges(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """The non-empty ranges of rising keys."""
    # the upper half of a key's bits tells its range
    upper = (keys >> np.uint64(KEY_BITS - 32)).astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)
    some, first = np.unique(upper, return_index=True)
    for i, (r, a) in enumerate(zip(some.tolist(), first.tolist())):
        yield r, slice(a, int(first[i + 1]) if i + 1 < len(first) else len(keys))


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    names = ["range", "block", "keys", "first", "second"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _exchanged(blocks: DataFrame, ask, answer, ranges: int, write=pack, read=unpack) -> DataFrame:
    """range, block, totals, words: what ask(row) -> (keys, first sums, second sums) gets back from
    answer(keys of all blocks, first sums, second sums) -> (totals, words); sums travel by write and read."""

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, first, second = ask(row)
                rows = [(r, row["block"], pack_sorted(keys[part]), *(None if x is None else write(x[part]) for x in (first, second)))
                        for r, part in _ranges(keys, ranges)]
                if rows:
                    yield _sent(rows)

    def add_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        keys = [unpack_sorted(k) for k in table["keys"].to_pylist()]
        bounds = np.cumsum([0, *map(len, keys)])
        sums = (table[c].to_pylist() for c in ("first", "second"))
        totals, words = answer(np.concatenate(keys), *(None if x[0] is None else np.concatenate([read(y) for y in x]) for x in sums))
        n = len(keys)
        return pa.table({
            "range": table["range"], "block": table["block"],
            "totals": pa.array([pack(totals[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary()),
            "words": pa.array([words] + [0] * (n - 1), pa.int64())})

    asked = blocks.select("block", *BLOCK_COLUMNS).mapInArrow(
        requests, "range bigint, block bigint, keys binary, first binary, second binary")
    return asked.groupBy("range").applyInArrow(add_up, "range bigint, block bigint, totals binary, words bigint")


def _received(table: pa.Table) -> np.ndarray:
    """The totals of a block's keys, in the order of its keys."""
    if table.num_rows == 0:
        return np.zeros(0, np.int64)
    return np.concatenate([unpack(t) for t in table.sort_by("range")["totals"].to_pylist()])


def _counted(blocks: DataFrame, levels: range, ranges: int, buckets: int, least: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """blocks that know the counts of these levels, written; the number of distinct learned words, if asked for."""

    def ask(row: dict) -> tuple:
        keys, _, _, often = Block(row, least).wanted(levels)
        return keys, often, None

    def answer(keys: np.ndarray, often: np.ndarray, _) -> tuple[np.ndarray, int]:
        distinct, which = np.unique(keys, return_inverse=True)
        totals = np.bincount(which, often, len(distinct)).astype(np.int64)
        return totals[which], int(np.sum((totals > 0) & (distinct & np.uint64(1) == 1)))

    def attach(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.select(BLOCK_COLUMNS).to_pylist()[0]
        block, totals = Block(row, least), _received(right)
        _, places, which, _ = block.wanted(levels)
        known, done = list(row["counts"]), 0
        for at in places:
            counts = np.zeros(len(block.tokens), np.int64)
            counts[at] = totals[which[done:done + len(at)]]
            known.append(pack(counts))
            done += len(at)
        at = left.schema.get_field_index("counts")
        return left.set_column(at, left.schema.field("counts"), pa.array([known], pa.list_(pa.binary())))

    replies = scratch.put(_exchanged(blocks, ask, answer, ranges))
    told = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(attach, blocks.schema)
    done = scratch.put_buckets(told, "block", buckets)
    kinds = replies.agg(F.sum("words")).first()[0] or 0
    scratch.drop(replies, blocks)
    return done, kinds


def score(docs: DataFrame, learned: Column, depth: int = DEPTH, least: int = LEAST, cost: float = COST,
          discount: float = DISCOUNT, block: int = BLOCK, tokens_per_range: int = RANGE) -> tuple[DataFrame, int]:
    """docs (text, ...), learned (whether a row is learned from) -> doc (the other columns), n_tokens, n_known,
    base_score, score (log10 of the probability of the text) of each row; and the number of tokens learned from."""
    scratch = Scratch(docs.sparkSession, "suffix_model")
    read = scratch.put(blocks_of(docs, learned, block))
    every, tokens, n_blocks = read.agg(F.sum("tokens"), F.sum("learned_tokens"), F.count("*")).first()
    every, tokens = every or 0, tokens or 0
    ranges, buckets = max(1, -(-every // tokens_per_range)), max(1, -(-n_blocks // BLOCKS_PER_BUCKET))
    blocks = scratch.put_buckets(read.repartition(buckets, "block"), "block", buckets)
    scratch.drop(read)
    blocks, kinds = _counted(blocks, range(2), ranges, buckets, least, scratch)
    for level in range(2, depth + 1):
        blocks, _ = _counted(blocks, range(level, level + 1), ranges, buckets, least, scratch)

    def ask(row: dict) -> tuple:
        keys, _, _, gain, part = Block(row, least).contexts(depth, tokens)
        return keys, gain, part

    def answer(keys: np.ndarray, gains: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, int]:
        distinct, which = np.unique(keys, return_inverse=True)
        gain, successors = (np.bincount(which, x, len(distinct)) for x in (gains, parts))
        return np.where(gain >= cost * successors, np.rint(successors), 0).astype(np.int64)[which], 0

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        one = Block(left.select(BLOCK_COLUMNS).to_pylist()[0], least)
        totals = _received(right)
        _, places, which, _, _ = one.contexts(depth, tokens)
        bounds = np.cumsum([0, *map(len, places)])
        successors = [totals[which[a:b]] for a, b in zip(bounds, bounds[1:])]
        known, base, model = one.scores(depth, tokens, kinds, discount, successors, places)
        return pa.table({"doc": left["docs"].combine_chunks().flatten(), "n_tokens": one.lengths, "n_known": known,
                         "base_score": base, "score": model})

    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    replies = _exchanged(blocks, ask, answer, ranges, lambda x: pack(x.astype("<f4").view("<u4")),
                         lambda x: unpack(x).astype("<u4").view("<f4").astype(float))
    out = blocks.drop("tokens", "learned_tokens").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        scored, f"doc {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out, tokens
