"""Blocks of documents whose terms are moved as lists.

A block holds some documents with MOST_WORDS words in all, or one longer one. Its distinct (domain, split, term) are numbered,
and lie in lists of one (domain, split, part) each, where the part of a term follows from a hash; its documents
are lists of such numbers. Lists of one (domain, split, part) meet in one call; how many parts
there are grows with the texts, so what meets does not. All steps run on Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusgap.operators.profile import GROUP

MOST_WORDS = 1 << 20
PART_CHARS = 8_000_000  # characters of the largest group for each part of its terms
BREAK = "\n"  # between the terms of a list; no term has one

_LIST = "block string, domain string, split string, part int, start int, terms string, counts binary"
_ROW = [("block", pa.string()), ("domain", pa.string()), ("split", pa.string()), ("part", pa.int32()), ("start", pa.int32()),
        ("terms", pa.string()), ("counts", pa.binary()), ("codes", pa.binary()), ("tf", pa.binary())]


def _cut(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of consecutive runs of values, as binary."""
    ends = pa.array(np.append(0, np.cumsum(sizes)) * values.itemsize, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends.buffers()[1], pa.py_buffer(values.tobytes())])


def _numbers(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """All values behind the bytes of a column, one row after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _terms(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a column of term lists: how many each list has, the number of each term, and the numbered terms."""
    lists = pc.split_pattern(column.cast(pa.large_string()), BREAK).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    coded = lists.flatten().dictionary_encode()
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with `most` words at most; a longer text is alone."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if held:
        yield batch.slice(start)


def _block(docs: pa.RecordBatch, stop: pa.Array, parts: int) -> Iterator[pa.RecordBatch]:
    """The lists and documents of one block."""
    block = uuid.uuid4().hex
    sizes = pc.fill_null(pc.list_value_length(docs.column("words")), 0).to_numpy(zero_copy_only=False)
    coded = docs.column("words").flatten().dictionary_encode()
    words, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    owner = np.repeat(np.arange(len(sizes)), sizes)
    counts = ~pc.is_in(known, stop).to_numpy(zero_copy_only=False)[words]
    words, owner = words[counts], owner[counts]
    if not len(words):
        return
    groups = pa.StructArray.from_arrays([docs.column(c) for c in GROUP], GROUP)
    pairs = pd.MultiIndex.from_arrays([docs.column(c).to_pandas() for c in GROUP])
    group, _ = pairs.factorize()
    firsts = np.unique(group, return_index=True)[1]

    # a term in a document, how often
    found, tf = np.unique(owner * len(known) + words, return_counts=True)
    owner, words = found // len(known), found % len(known)
    # a term in a group, in how many documents; numbered by part, group and term
    own, code, df = np.unique(group[owner] * len(known) + words, return_inverse=True, return_counts=True)
    term, at = own % len(known), own // len(known)
    rank = np.empty(len(known), np.int64)
    rank[pc.sort_indices(known).to_numpy()] = np.arange(len(known))
    part = (pd.util.hash_array(known.to_numpy(zero_copy_only=False)) % np.uint64(parts)).astype(np.int64)[term]
    order = np.lexsort((rank[term], at, part))
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    term, at, part, df = term[order], at[order], part[order], df[order]
    first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(part) != 0)))
    lengths = np.diff(np.append(first, len(term)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)), pa.int32()), known.take(pa.array(term)))
    names = groups.take(pa.array(firsts[at[first]])).flatten()
    yield _row(len(first), block=pa.array([block] * len(first)), domain=names[0], split=names[1], part=pa.array(part[first], pa.int32()),
               start=pa.array(first, pa.int32()), terms=pc.binary_join(lists, BREAK), counts=_cut(df.astype("<i4"), lengths))

    per_doc = np.unique(owner, return_counts=True)[1]
    yield _row(len(per_doc), block=pa.array([block] * len(per_doc)), codes=_cut(number[code].astype("<i4"), per_doc),
               tf=_cut(tf.astype("<i4"), per_doc))


def _row(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in _ROW], schema=pa.schema(_ROW))


def blocks(docs: DataFrame, stop_words, parts: int, most_words: int = MOST_WORDS) -> DataFrame:
    """docs (domain, split, words) -> rows of lists (block, domain, split, part, start, terms, counts: the documents of each
    term) and of documents (block, codes, tf; part is null). `start` is the number of a list's first term. Blocks
    are named anew in each run: pin them."""
    stop = list(stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = pa.array(stop, pa.string())
        for batch in batches:
            for some in _slices(batch, most_words):
                yield from _block(some, left_out, parts)

    return docs.mapInArrow(run, f"{_LIST}, codes binary, tf binary")


def with_frequency(lists: DataFrame) -> DataFrame:
    """lists (with `docs`, the documents of the group) -> the same; counts are those of all blocks."""

    def run(table: pa.Table) -> pa.Table:
        lengths, codes, known = _terms(table.column("terms"))
        total = np.bincount(codes, _numbers(table.column("counts"), "<i4"), len(known)).astype("<i4")
        return table.set_column(table.schema.get_field_index("counts"), "counts", _cut(total[codes], lengths))

    names = ["block", *GROUP, "part", "start", "terms", "counts", "docs"]
    return lists.select(*names).groupBy(*GROUP, "part").applyInArrow(run, f"{_LIST}, docs bigint")


def weighed(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs (block, codes, tf) and lists with all counts -> domain, split, part, terms, sums: the weights of each term of a
    list over the documents of its block, a document's weights having unit length."""

    def run(own: pa.Table, lists: pa.Table) -> pa.Table:
        counts = [np.frombuffer(c, "<i4") for c in lists.column("counts").to_pylist()]
        lengths = np.array([len(c) for c in counts], np.int64)
        starts = lists.column("start").to_numpy()
        idf = np.empty(int(lengths.sum()))
        for start, n, c in zip(starts, lists.column("docs").to_pylist(), counts):
            idf[start:start + len(c)] = np.log((n + 1) / (c + 1)) + 1
        sizes = pc.binary_length(own.column("codes")).to_numpy() // 4
        codes = _numbers(own.column("codes"), "<i4")
        raw = _numbers(own.column("tf"), "<i4") * idf[codes]
        norm = np.sqrt(np.add.reduceat(raw * raw, np.cumsum(sizes) - sizes))
        sums = np.bincount(codes, raw / np.repeat(norm, sizes), len(idf))
        cuts = pa.array([sums[s:s + n].astype("<f8").tobytes() for s, n in zip(starts, lengths)], pa.binary())
        return lists.select([*GROUP, "part", "terms"]).append_column("sums", cuts)

    return docs.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(
        run, "domain string, split string, part int, terms string, sums binary")


def merged(lists: DataFrame) -> DataFrame:
    """lists (domain, split, part, terms, sums) -> domain, split, term, score: the sums of all lists."""

    def run(table: pa.Table) -> pa.Table:
        _, codes, known = _terms(table.column("terms"))
        score = np.bincount(codes, _numbers(table.column("sums"), "<f8"), len(known))
        same = [pa.array([table.column(c)[0].as_py()] * len(known), pa.string()) for c in GROUP]
        return pa.table([*same, known.cast(pa.string()), pa.array(score)], names=[*GROUP, "term", "score"])

    return lists.groupBy(*GROUP, "part").applyInArrow(run, "domain string, split string, term string, score double")
