"""Syntactic difficulty of a corpus from a table of dependency parses.

Rows are tokens: (domain, split, doc_id, sent_id, i, head), with i and head positions in the
document; positions inside a sentence follow each other and a root is its own head.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed

GROUP = ["domain", "split"]
SENTENCE = [*GROUP, "doc_id", "sent_id"]
NULL = np.iinfo(np.int64).min  # stands for a missing position


def dependency_length(parse: DataFrame) -> DataFrame:
    """(domain, split, avg_dependency_length): mean distance of a token to its head."""
    return parse.groupBy(*GROUP).agg(
        F.avg(F.abs(F.col("i") - F.col("head"))).alias("avg_dependency_length")
    )


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column, null as 0, and where it has one."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), known


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring tokens of one sentence as one row: keys, base, and i and head less the base as lists,
    of bytes (near_i, near_head) if the run fits and as they are (far_i, far_head) if not."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        *keys, i, head = batch.columns
        new = np.zeros(n - 1, bool)
        for key in keys:
            before, after = key.slice(0, n - 1), key.slice(1)
            differs = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
            new |= differs | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))
        first = np.concatenate(([0], np.flatnonzero(new) + 1))
        sizes = np.diff(np.append(first, n))
        (i, known_i), (head, known_head) = _numbers(i), _numbers(head)
        base = i[first]
        i, head = (np.where(known, x - np.repeat(base, sizes), 0) for x, known in ((i, known_i), (head, known_head)))
        near = np.maximum.reduceat(np.maximum(np.abs(i), np.abs(head)), first) <= 127
        lists = []
        for chosen, kind in ((near, pa.int8()), (~near, pa.int64())):
            ends = pa.array(np.append(0, np.cumsum(sizes * chosen)), pa.int32())
            which = np.repeat(chosen, sizes)
            lists += [pa.ListArray.from_arrays(ends, pa.array(x[which], kind, mask=~known[which]))
                      for x, known in ((i, known_i), (head, known_head))]
        names = [*batch.schema.names[:-2], "base", "near_i", "near_head", "far_i", "far_head"]
        yield pa.RecordBatch.from_arrays([k.take(pa.array(first)) for k in keys] + [pa.array(base), *lists], names=names)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, runs) of whole sentences -> keys, tokens, length, is_tree, tree_depth.

    Pointer doubling over all tokens of a batch: a token knows its distance to an ancestor; each step
    replaces the ancestor by its own ancestor and adds the distances. Steps follow the longest sentence,
    so any tree depth is covered.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        *keys, runs = batch.columns
        owner = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
        base, *lists = runs.flatten().flatten()
        base, parts = _numbers(base)[0], []
        for some_i, some_head in (lists[:2], lists[2:]):
            run = np.repeat(np.arange(len(base)), pc.list_value_length(some_i).to_numpy(zero_copy_only=False))
            (i, known_i), (head, known_head) = _numbers(some_i.flatten()), _numbers(some_head.flatten())
            parts.append((owner[run], np.where(known_i, i + base[run], NULL), np.where(known_head, head + base[run], NULL)))
        sentence, i, head = (np.concatenate(x) for x in zip(*parts))
        sizes = np.bincount(sentence, minlength=len(runs))
        starts = np.cumsum(sizes) - sizes  # no sentence is empty

        order = np.lexsort((head, i, sentence))
        sentence, i, head = sentence[order], i[order], head[order]
        both = (i != NULL) & (head != NULL)
        length = np.add.reduceat(np.where(both, np.abs(i - head), 0), starts)
        counted = np.logical_or.reduceat(both, starts)
        place = head - i[starts][sentence]
        inside = both & (place >= 0) & (place < sizes[sentence])
        whole = np.logical_and.reduceat(inside, starts) & (i[starts + sizes - 1] - i[starts] + 1 == sizes)
        own = np.arange(len(sentence))
        heads = np.where(whole[sentence], starts[sentence] + place, own)
        up, far = heads, (heads != own).astype(np.int64)
        for _ in range(int(sizes.max()).bit_length()):
            far = far + far[up]
            up = up[up]
        is_tree = whole & np.logical_and.reduceat(heads[up] == up, starts)
        depth = np.maximum.reduceat(far, starts) + 1
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array(sizes, pa.int32()), pa.array(length, pa.int64(), mask=~counted), pa.array(is_tree),
             pa.array(np.where(is_tree, depth, 0), pa.int32(), mask=~is_tree)],
            names=[*batch.schema.names[:-1], "tokens", "length", "is_tree", "tree_depth"])


def sentence_depths(parse: DataFrame) -> DataFrame:
    """(domain, split, doc_id, sent_id, tokens, length, is_tree, tree_depth), one row per sentence;
    length is the sum of the distances of its tokens to their heads.

    A lone token has depth 1. One sentence is one group, and never longer than the text it
    came from. Heads outside the sentence or heads in a circle make is_tree false and the
    depth null. Neighbouring tokens of a sentence are put in one row before the shuffle, which then
    moves and sorts a row per sentence and not per token.
    """
    tokens = parse.select(*SENTENCE, "i", "head")
    kinds = dict(tokens.dtypes)
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in SENTENCE)
    lists = {"near_i": "tinyint", "near_head": "tinyint", "far_i": "bigint", "far_head": "bigint"}
    runs = tokens.mapInArrow(_runs, f"{keys}, base bigint, " + ", ".join(f"{x} array<{kind}>" for x, kind in lists.items()))
    sentences = runs.groupBy(*SENTENCE).agg(F.collect_list(F.struct("base", *lists)).alias("runs"))
    return sentences.mapInArrow(_trees, f"{keys}, tokens int, length bigint, is_tree boolean, tree_depth int")


def tree_depth(parse: DataFrame) -> DataFrame:
    """(domain, split, max_tree_depth)."""
    return sentence_depths(parse).groupBy(*GROUP).agg(F.max("tree_depth").alias("max_tree_depth"))


def learning_difficulty(parse: DataFrame,
                        length_weight: float = fixed.DEPENDENCY_LENGTH_WEIGHT,
                        depth_weight: float = fixed.TREE_DEPTH_WEIGHT) -> DataFrame:
    """(domain, split, avg_dependency_length, max_tree_depth, sentences, broken_sentences,
    learning_difficult), in one pass over the parse.

    Broken sentences, whose heads make no tree, count in the mean length and have no depth.
    """
    score = length_weight * F.col("avg_dependency_length") + depth_weight * F.col("max_tree_depth")
    return sentence_depths(parse).groupBy(*GROUP).agg(
        (F.sum("length") / F.sum("tokens")).alias("avg_dependency_length"),
        F.max("tree_depth").alias("max_tree_depth"),
        F.count("*").alias("sentences"),
        F.count_if(~F.col("is_tree")).alias("broken_sentences"),
    ).withColumn(fixed.DIFFICULTY, score)
