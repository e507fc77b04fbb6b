"""Words of many texts at once, as 64-bit hashes: numpy on the bytes of an Arrow column, no Python string per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes that are hashed at once
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number, well stirred."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE, PIECE), _powers(_INVERSE, PIECE)


@dataclass
class Words:
    """Words of texts, one after the other: hash, text number, first byte and end in `data`; words per text."""

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray
    end: np.ndarray
    data: np.ndarray
    counts: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each text begins (and the last one ends); null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _long_hash(codes: np.ndarray, word: np.ndarray) -> np.uint64:
    total, factor = 0, 1
    for at in range(0, len(word), PIECE):
        piece = word[at:at + PIECE]
        total += factor * int(np.sum(codes[piece] * _UP[:len(piece)], dtype=np.uint64))
        factor = factor * pow(_BASE, len(piece), 2**64) % 2**64
    return np.uint64(total % 2**64)


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words (everything between ASCII white space) of texts that lie at `offsets` in `data`."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_BLANK[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
    counts = np.diff(np.searchsorted(first, offsets))
    codes = _LOWER if lower else _CODES
    hashes = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        # as many words as fit into a piece
        to = int(np.searchsorted(end, first[at] + PIECE, "right"))
        if to == at:  # one long word
            hashes[at] = _long_hash(codes, data[first[at]:end[at]])
            at += 1
            continue
        begin = first[at]
        piece = data[begin:end[to - 1]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(codes[piece] * _UP[:len(piece)], out=sums[1:])
        f, e = first[at:to] - begin, end[at:to] - begin
        hashes[at:to] = (sums[e] - sums[f]) * _DOWN[f]
        at = to
    return Words(mixed(hashes), np.repeat(np.arange(len(counts)), counts), first, end, data, counts)


def groups(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text stands alone."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, min(to, n)))
        at = out[-1][1]
    return out
