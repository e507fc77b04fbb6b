"""Periodic runs of words: maximal repetitions of every text, by suffix trees and Lyndon roots.

A run is a stretch of words that repeats with a smallest period, LEAST times at least and over SHORTEST words,
and that no neighbouring word extends. Per text:

1. Words that cannot lie in a run are set aside. All threes of neighbouring words inside a run occur three times
   or more in it, so only stretches of threes that are that frequent in their text (then again in their stretch,
   until nothing changes) can hold runs. This loses no run, as a run always lies within one stretch.
2. Of each stretch and of its reversal Ukkonen's algorithm builds the suffix tree. An Euler tour of a tree, kept
   as the least string depth between neighbouring leaves, answers lowest common ancestors, and so longest common
   extensions, in constant time (a table of minima over powers of two).
3. The longest Lyndon word that starts at a place ends before the next smaller suffix; one is taken for the order
   of the words and one for its reverse. Each run has such a root in one of the orders; every root is extended
   to both sides by the two trees.

Words are compared by 64-bit hashes. Each text is one row's work: memory grows with the longest text (about 60
bytes a word) and with the longest stretch that may hold a run (several hundred bytes a word for its two trees).
Texts are dealt as they are read; no key, source or group of copies meets in a task.

Cases: null, empty and blank texts have no words and no runs, and collapse to nothing; repeated texts are answered
one by one; null ids are kept; ties between runs cannot arise, as two runs differ in start or period; an empty
table gives an empty table; other columns, whatever their names, are kept in `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgap.llm import hashed_words
from corpusgap.llm.hashed_words import mixed

LEAST, SHORTEST = 4, 6
GRAM, OFTEN = 3, 3  # threes of words occur three times in a run of four periods and six words
GROUP = 1 << 22  # bytes of text that are searched at once


def suffix_tree(text: list[int]) -> tuple[list[dict | None], list[int], list[int]]:
    """Ukkonen's suffix tree of a text that ends with a symbol of its own: edges by first symbol (None at
    leaves), first and end position of the label that leads to each node. Node 0 is the root."""
    n = len(text)
    edges: list[dict | None] = [{}]
    first, end, link = [0], [0], [0]
    node = edge = length = pending = 0
    for i, c in enumerate(text):
        pending += 1
        made = 0  # the inner node that still needs its link
        while pending:
            if length == 0:
                edge = i
            out = edges[node]
            symbol = text[edge]
            child = out.get(symbol)
            if child is None:
                out[symbol] = len(edges)
                edges.append(None)
                first.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                start = first[child]
                span = end[child] - start
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                follows = text[start + length]
                if follows == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                inner = len(edges)
                out[symbol] = inner
                edges.append({follows: child, c: inner + 1})
                first.append(start)
                end.append(start + length)
                link.append(0)
                first[child] = start + length
                edges.append(None)
                first.append(i)
                end.append(n)
                link.append(0)
                if made:
                    link[made] = inner
                made = inner
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return edges, first, end


def tour(tree: tuple, n: int, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of the leaves, and the string depth of the lowest common ancestor of each leaf and
    the one before it. `falling` turns the order of all symbols round, but the last symbol (0) stays least."""
    edges, first, end = tree
    order, depths = [], []
    shared = 0  # the least depth since the last leaf
    stack = [(0, 0)]
    while stack:
        node, depth = stack.pop()
        if node < 0:  # back at an inner node
            if depth < shared:
                shared = depth
            continue
        out = edges[node]
        if out is None:
            order.append(n - depth)
            depths.append(shared)
            shared = depth
            continue
        symbols = sorted(out)
        if falling:
            symbols = symbols[1:][::-1] if symbols[0] else [0, *symbols[:0:-1]]
            if len(symbols) < len(out):
                symbols.append(min(out))
        for s in reversed(symbols):
            child = out[s]
            stack.append((child, depth + end[child] - first[child]))
            stack.append((-1, depth))
    return np.array(order), np.array(depths)


class Extensions:
    """Longest common extensions of suffixes: minima over the tour between two leaves."""

    def __init__(self, order: np.ndarray, depths: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.minima = [depths.astype(np.int32)]
        step = 1
        while 2 * step <= len(depths):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of suffixes that start at different places."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # depths low .. high - 1
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.minima[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """Of each place the next one with a smaller rank."""
    out = np.empty(len(rank), np.int64)
    open_: list[int] = []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    out[open_] = len(rank)
    return out


def runs_of(symbols: np.ndarray, least: int = LEAST, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence, by start and period."""
    n = len(symbols)
    names, text = np.unique(symbols, return_inverse=True)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    text = text.ravel() + 1
    forward, backward = [*text.tolist(), 0], [*text[::-1].tolist(), 0]
    tree = suffix_tree(forward)
    right = Extensions(*tour(tree, n + 1))
    fallen = tour(tree, n + 1, falling=True)[0]
    del tree
    left = Extensions(*tour(suffix_tree(backward), n + 1))
    rank = np.empty(n + 1, np.int64)
    rank[fallen] = np.arange(n + 1)
    place = np.arange(n)
    found = []
    for order in (right.rank, rank):
        i, period = place, next_smaller(order.tolist())[:n] - place
        some = period * least <= n
        i, period = i[some], period[some]
        after = np.zeros(len(i), np.int64)
        on = i + period < n
        after[on] = right.of(i[on], i[on] + period[on])
        before = np.zeros(len(i), np.int64)
        on = i > 0
        before[on] = left.of(n - i[on], n - i[on] - period[on])
        length = before + period + after
        some = length >= np.maximum(shortest, least * period)
        found.append(np.column_stack([i[some] - before[some], length[some], period[some]]))
    return np.unique(np.concatenate(found), axis=0)


def stretches(words: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words that may hold runs (see 1 above)."""
    n = len(words) - GRAM + 1
    if n < 1:
        return []
    grams = words[:n].copy()
    for k in range(1, GRAM):
        grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + words[k:n + k])
    at = np.flatnonzero(text[:n] == text[GRAM - 1:])
    part = text[at]  # the text, later the stretch, that a place lies in
    whole = False
    while True:
        keys = mixed(grams[at] ^ mixed(part.astype(np.uint64) + np.uint64(1)))
        if whole:
            _, which, often = np.unique(keys, return_inverse=True, return_counts=True)
            stays = often[which.ravel()] >= OFTEN
        else:  # counters that different threes may share: more stays than need be, never less
            keys >>= np.uint64(64 - max(1, len(at)).bit_length() - 1)
            stays = (np.bincount(keys.view(np.int64)) >= OFTEN)[keys.view(np.int64)]
        some, parts = at[stays], part[stays]
        fresh = np.ones(len(some), bool)
        fresh[1:] = (some[1:] != some[:-1] + 1) | (parts[1:] != parts[:-1])
        part = np.cumsum(fresh)
        sizes = np.bincount(part, minlength=1)
        long = sizes[part] >= SHORTEST - GRAM + 1
        some, part = some[long], part[long]
        if whole and len(some) == len(at):
            break
        at, whole = some, True
    first = np.flatnonzero(np.diff(part, prepend=-1))
    last = np.append(first[1:], len(part)) - 1 if len(first) else first
    return [(int(a), int(b) + GRAM) for a, b in zip(at[first], at[last])]


def _searched(words: hashed_words.Words) -> tuple[list[list[dict]], list[bytes]]:
    """The runs of each text, and each text without what repeats."""
    starts = np.cumsum(words.counts) - words.counts
    runs: list[list[dict]] = [[] for _ in words.counts]
    gone = np.zeros(len(words.hash) + 1, np.int64)
    for a, b in stretches(words.hash, words.text):
        text = int(words.text[a])
        for start, length, period in runs_of(words.hash[a:b]).tolist():
            runs[text].append({"start": a - int(starts[text]) + start, "length": length, "period": period})
            gone[a + start + period] += 1
            gone[a + start + length] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    raw = words.data.tobytes()
    collapsed = []
    for text, (at, n) in enumerate(zip(starts.tolist(), words.counts.tolist())):
        own = raw[words.first[at]:words.end[at + n - 1]].split() if n else []
        if runs[text]:
            runs[text].sort(key=lambda r: (r["start"], r["period"]))
            own = [w for w, s in zip(own, stays[at:at + n].tolist()) if s]
        collapsed.append(b" ".join(own))
    return runs, collapsed


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame) -> DataFrame:
    """docs (text, ...) -> doc (the other columns), n_words, runs by start and period, collapsed (bytes: the words
    that no run repeats, joined by a blank), a row per row."""
    others = [docs[c] for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("doc"), docs["text"].alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashed_words.buffers(batch.column("text"))
            for a, b in hashed_words.groups(offsets, GROUP):
                at = offsets[a:b + 1]
                words = hashed_words.split(data[at[0]:at[-1]], at - at[0])
                runs, collapsed = _searched(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(a, b - a), pa.array(words.counts, pa.int64()), pa.array(runs, _RUNS),
                     pa.array(collapsed, pa.binary())],
                    names=["doc", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc {kind}, n_words bigint, runs {RUNS}, collapsed binary")
