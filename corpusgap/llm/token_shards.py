"""Token-ID output in training order: every sequence gets a global slot by a keyed permutation.

Texts are tokenized whole and cut into sequences of `length` token ids; the last one of a text is padded,
its true length is kept. Sequences are numbered 0 .. N-1 in the order of a hash of the document's id and
text, and a keyed Feistel network on the smallest even number of bits that holds N, with cycle walking for
values of N and above, maps numbers to slots: a bijection that needs no sort and no state. A shard holds
`per_shard` consecutive slots with a fixed stride, so the byte offset of a slot follows from its number, and
reading can resume at any slot. Each partition takes one range of slots, a shard, in slot order.

Numbers follow from the rows alone, not from files, splits or tasks: the hashes fall into PARTS ranges, whose
sizes are summed up in one small window, and each range is numbered by itself. So the same documents with
the same key and settings give the same shards on any cluster. `write_shards` writes them with a manifest (N,
key, settings, and a count and checksum of each shard); `resume` reads on from any slot and skips earlier shards.

Cases: null and empty texts have no tokens and make no sequence; equal documents make equal sequences in
slots of their own; a null id is kept, and ids never pass through Python numbers; an empty table gives an empty
table; other columns are ignored. A very long text is one row's work: its ids take two bytes each.
Executors need `tiktoken` and the vocabulary file (`path`, or that of `public_tokenizers`).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusgap.llm.common import Scratch

LENGTH, PER_SHARD = 256, 4096
ID_BYTES = 2  # little-endian; vocabularies up to 65,536 ids
END = 50_256  # the id that ends a text
PARTS = 4096  # ranges of hashes that are numbered one by one
ROUNDS = 6
BATCH_BYTES = 1 << 20  # of texts that are tokenized at once, and of what crosses to Python at once
KEY = 0x5EED
TOKENIZER = "byte_bpe_50k.tiktoken"


_OTHER_SPACE = re.compile(r"[^\S \n]")


class Chunks:
    """Ids of texts, as bytes. Before a blank between two other characters every piece of the tokenizer's pattern ends, so
    in texts whose blanks all are such, a blank and what follows up to the next one is encoded on its own: once for all
    equal ones of a batch, all of a batch in one call. Remembering them from batch to batch takes more time than it saves."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(TOKENIZER), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blank_led = np.zeros(max(ranks.values()) + 1, bool)
        self.blank_led[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def plain(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u2").tobytes()

    @staticmethod
    def regular(text: str) -> bool:
        """Whether each blank is between two other characters that are no white space."""
        beside = "  " in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n"
        return not (beside or _OTHER_SPACE.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        regular = [i for i, t in enumerate(texts) if self.regular(t)]
        words = pc.split_pattern(pa.array([texts[i] for i in regular], pa.string()), " ")
        told = words.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays(pa.array([0, len(told.dictionary)], pa.int32()), told.dictionary)
        ids = np.array(self.coder.encode_ordinary(" " + pc.binary_join(distinct, " ")[0].as_py()) if regular else [], "<u2")
        starts = np.flatnonzero(self.blank_led[ids])
        if len(starts) != len(told.dictionary):  # a vocabulary with blanks inside its entries
            return [self.plain(t) for t in texts]
        word, first = told.indices.to_numpy(), words.offsets.to_numpy()
        lengths = np.diff(starts, append=len(ids))[word]
        lengths[first[:-1]] = 0  # no blank leads a text
        ends = np.concatenate([[0], np.cumsum(lengths)])
        raw = ids[np.repeat(starts[word] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        bounds = (ends[first] * ID_BYTES).tolist()
        rest = {i: raw[a:b] for i, a, b in zip(regular, bounds, bounds[1:])}
        return [self.plain(t.split(" ", 1)[0]) + rest[i] if i in rest else self.plain(t) for i, t in enumerate(texts)]


def small(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of at most `most` bytes of text; a longer text is alone. Texts, ids and
    padded ids of a run lie in memory together, several times the bytes of its texts."""
    for batch in batches:
        start = held = 0
        for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def tokenized(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, place (a hash of id and text), text_hash, n_tokens, ids (binary): the ids of each
    text end with END and are padded with it to whole sequences."""
    stride = length * ID_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, end = Chunks(path), np.array([END], "<u2").tobytes()
        padding = end * length
        for batch in small(batches):
            coded = chunks.encode(batch.column("text").to_pylist())
            n = [len(c) // ID_BYTES + 1 for c in coded]
            ids = pa.array([c + padding[:(-len(c) - 1) % stride + 1] for c in coded], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), batch.column("text_hash"), pa.array(n, pa.int64()), ids],
                names=["doc_id", "place", "text_hash", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    some = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("place"), F.xxhash64("text").alias("text_hash"), "text")
    return some.where(F.length("text") > 0).mapInArrow(
        run, f"doc_id {kind}, place long, text_hash long, n_tokens long, ids binary")


def slots(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each number below n: a keyed Feistel network with cycle walking."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % 2**64) for r in range(1, ROUNDS + 1)]
    out = numbers.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        v = out[open_]
        left, right = v >> half, v & mask
        for k in keys:
            x = (right + k) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((x >> np.uint64(40)) & mask) ^ ((x >> np.uint64(5)) & mask)
        out[open_] = (left << half) | right
        open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)


def _part():
    return F.shiftrightunsigned("place", 52).cast("int")  # the upper bits: 0 .. PARTS - 1


def write_order(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY,
                path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> slot, shard, byte_offset, doc_id, part, n_tokens, payload, in shards of slots.

    payload: `length` little-endian ids, padded with END; written out, each shard is one partition with
    its slots in order, and slot s starts at byte (s % per_shard) * length * ID_BYTES of it.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    stride = length * ID_BYTES
    buckets = min(PARTS, max(8, docs.rdd.getNumPartitions()))  # as many as the reading has tasks
    put = tokenized(docs, length, path).withColumn("range", _part()).repartition(buckets, "range")
    coded = scratch.put_buckets(put, "range", buckets, codec="zstd", batch_bytes=BATCH_BYTES)
    n_seqs = (F.octet_length("ids") / stride).cast("long")
    sizes = coded.groupBy("range").agg(F.sum(n_seqs).alias("n")).collect()  # a row per range
    before = np.zeros(PARTS + 1, np.int64)
    for r in sizes:
        before[r["range"] + 1] = r["n"]
    before = np.cumsum(before)
    n = int(before[-1])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            if not len(ids):
                continue
            bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1].astype(np.int64)
            counts = np.diff(bounds) // stride
            row = np.repeat(np.arange(len(counts)), counts)
            part = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            number = before[batch.column("range").to_numpy()] + batch.column("first").to_numpy()
            left = batch.column("n_tokens").to_numpy()[row] - part * length
            # the padded ids of a batch lie one behind the other: sequences are cuts of the same bytes
            cuts = pa.py_buffer((bounds[0] + np.arange(len(row) + 1) * stride).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots(number[row] + part, n, key)), batch.column("doc_id").take(pa.array(row)), pa.array(part),
                 pa.array(np.minimum(left, length)), pa.Array.from_buffers(pa.binary(), len(row), [None, cuts, ids.buffers()[2]])],
                names=["slot", "doc_id", "part", "n_tokens", "payload"])

    # the table is bucketed by range: numbering sorts its rows, but moves none
    so_far = Window.partitionBy("range").orderBy("place", "text_hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = coded.withColumn("first", F.sum(n_seqs).over(so_far) - n_seqs)
    placed = numbered.select("range", "first", "doc_id", "n_tokens", "ids").mapInArrow(
        place, f"slot long, doc_id {kind}, part long, n_tokens long, payload binary")
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    dealt = placed.withColumn("shard", shard).withColumn("byte_offset", (F.col("slot") % per_shard) * stride)
    shards = max(1, -(-n // per_shard))
    return (
        dealt.repartitionById(shards, "shard").sortWithinPartitions("slot")  # one range of slots per partition
        .select("slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "payload")
    )


def read_from(shards: DataFrame, slot: int) -> DataFrame:
    """What is left to read from a slot on, in order: earlier shards are skipped."""
    return shards.where(F.col("slot") >= slot).orderBy("slot")


def write_shards(docs: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY,
                 path: str | None = None) -> DataFrame:
    """Write the order below `folder`: `shards`, a folder per shard, and last `manifest`; the manifest's rows.

    manifest: shard, first_slot, n (slots), checksum (of slots and payloads), total, key, length, per_shard.
    """
    write_order(docs, length, per_shard, key, path).write.partitionBy("shard").parquet(f"{folder}/shards")
    written = docs.sparkSession.read.parquet(f"{folder}/shards")
    found = _summary(written).withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row per shard
    found.withColumns({"key": F.lit(key).cast("long"), "length": F.lit(length), "per_shard": F.lit(per_shard)}).coalesce(1).write.parquet(
        f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _summary(written: DataFrame) -> DataFrame:
    return written.groupBy("shard").agg(F.min("slot").alias("first_slot"), F.count("*").alias("n"),
                                        F.bit_xor(F.xxhash64("slot", "payload")).alias("checksum"))


def damaged(spark, folder: str) -> DataFrame:
    """The shards whose files do not agree with the manifest; none if all is well."""
    told = spark.read.parquet(f"{folder}/manifest").select("shard", "first_slot", "n", "checksum")
    return told.exceptAll(_summary(spark.read.parquet(f"{folder}/shards")).select(*told.columns)).select("shard")


def resume(spark, folder: str, slot: int) -> DataFrame:
    """The written sequences from a slot on, in order; files of earlier shards are not opened."""
    per_shard = spark.read.parquet(f"{folder}/manifest").select("per_shard").first()
    shards = spark.read.parquet(f"{folder}/shards")
    return read_from(shards.where(F.col("shard") >= (slot // per_shard[0] if per_shard else 0)), slot)
