"""Whole Arrow batches of texts as numpy arrays: words, their 64-bit hashes, ragged gathers.

A word is a maximal run of bytes outside a set of separators. Texts are handled in slices of some
megabytes, so that memory stays bounded whatever a batch holds; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once, unless a single text is longer.
SLICE = 4 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))
BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
#: Separators: as a pattern, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE + 4096)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[name] = p
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them and the end) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and for each row the number of words before it, then all.

    ``cut`` marks bytes, not separators themselves, at which a word starts even inside a run.
    """
    gap = space[data]
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= ~gap[edge]  # a row's first byte starts a word, whatever stands before it
    last[edge - 1] |= ~gap[edge - 1]
    if cut is not None:
        first |= cut
        last[:-1] |= cut[1:] & ~gap[:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], starts and ends ascending: polynomial sums, then mixed with the length.

    The running sums are taken over one stretch of SLICE bytes at a time, unless a single word is longer.
    """
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        base, size = starts[i], ends[j - 1] - starts[i]
        up, down = powers(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTES[data[base : base + size]] * up[:size], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row, the sum of values[bounds[i]:bounds[i + 1]]; values may have a second axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
