"""Words and their hashes for whole Arrow batches of text at once, with numpy.

A batch is cut into slices of about ``SLICE`` bytes so that the working arrays of a task stay
small however long the texts are; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WHITE = [9, 10, 11, 12, 13, 32]

#: Words are maximal runs of anything but space and \x09-\x0D.
SPACED = np.ones(256, np.uint8)
SPACED[_WHITE] = 0

#: Letters (with every byte of a multi-byte character), digits and signs end each other.
CLASSES = np.full(256, 3, np.uint8)
CLASSES[_WHITE] = 0
CLASSES[48:58] = 2
CLASSES[65:91] = CLASSES[97:123] = CLASSES[128:] = 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Powers:
    table = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            steps = np.full(max(n, 256), 0x9E3779B97F4A7C15, np.uint64)
            steps[0] = 1
            cls.table = np.cumprod(steps, dtype=np.uint64)
        return cls.table


class Slice(NamedTuple):
    """Documents first..last of a batch, their folded bytes and the byte range of each."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Hash, byte range and class of each word; ``bounds[d]:bounds[d+1]`` are those of document d."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array, fold: bool = True, size: int = SLICE) -> Iterator[Slice]:
    """Cuts a string column into slices; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, raw = column.buffers()
    count = len(column)
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + count + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < count:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        last = min(last, count, first + 4096)
        part = data[ends[first] : ends[last]]
        yield Slice(first, last, _FOLD[part] if fold else part, ends[first : last + 1] - ends[first])
        first = last


def words(piece: Slice, classes: np.ndarray = SPACED) -> Words:
    """The words of a slice. Two words have one hash if their bytes agree."""
    n = len(piece.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none.astype(np.uint8), np.zeros(len(piece.offsets), np.int64))
    kinds = classes[piece.data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kinds[1:] != kinds[:-1]
    edge[piece.offsets] = True
    cuts = np.flatnonzero(edge)
    start, size = cuts[:-1], np.diff(cuts)
    within = np.arange(n) - np.repeat(start, size)
    weighted = _Powers.upto(int(size.max()))[within]
    weighted *= piece.data.astype(np.uint64) + np.uint64(1)
    total = np.add.reduceat(weighted, start)
    kept = kinds[start] != 0
    start, size = start[kept], size[kept]
    hashed = mix(total[kept] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(hashed, start, start + size, kinds[start], np.searchsorted(start, piece.offsets))


def prefixes(piece: Slice, found: Words, length: int) -> np.ndarray:
    """Hash of the first ``length`` bytes of every word (of the whole word when shorter)."""
    out = np.zeros(len(found.start), np.uint64)
    powers = _Powers.upto(length + 1)
    for k in range(length):
        at = found.start + k
        inside = at < found.end
        out[inside] += powers[k] * (piece.data[at[inside]].astype(np.uint64) + np.uint64(1))
    return mix(out + np.uint64(length))


def pairs(hashed: np.ndarray) -> np.ndarray:
    """Hash of every two neighbouring words; the caller drops pairs across documents."""
    left, right = hashed[:-1], hashed[1:]
    return mix(left * np.uint64(0x9FB21C651E98DF25) + (right ^ (right >> np.uint64(31))))
