"""Vectorised word and n-gram hashing over Arrow string arrays.

A word is a longest run of bytes other than space and the controls 0x09 to 0x0D.
All functions work on a whole batch of texts at once and never copy single texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible odd 64-bit numbers for ``seed``."""
    start = U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    with np.errstate(over="ignore"):
        return mix(start + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


@dataclass
class Words:
    """The words of a batch: byte ranges in ``data``, and how many each text has."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def as_strings(column) -> pa.Array:
    """One contiguous large_string array; null texts become empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string()).fill_null("")


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins."""
    array = as_strings(column)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column) -> Words:
    """Find the words of every text in the column."""
    data, offsets = raw(column)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    lengths = np.flatnonzero(last) + 1 - starts
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(data, starts, lengths, counts)


def hashes(found: Words, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(found.starts):
        return np.zeros(0, U64)
    head = np.cumsum(found.lengths) - found.lengths
    total = int(found.lengths.sum())
    place = np.arange(total) - np.repeat(head, found.lengths)
    symbols = found.data[np.repeat(found.starts, found.lengths) + place]
    letter, power = stream(seed, 256), stream(seed + 1000, int(found.lengths.max()))
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(letter[symbols] * power[place], head) + found.lengths.astype(U64))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values, by doubling; shorter inputs give nothing."""
    if len(h) < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        power, span, out, covered = h, 1, None, 0
        while True:
            if k & span:
                if out is None:
                    out, covered = power, span
                else:
                    tail = power[covered : covered + len(out)]
                    out, covered = mix(out[: len(tail)] * U64(0xA0761D6478BD642F) + tail), covered + span
            if covered == k:
                return out[: len(h) - k + 1]
            power = mix(power[: len(power) - span] * U64(0xE7037ED1A0B428DB) + (power[span:] ^ U64(span)))
            span *= 2


def inside_texts(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where ``k`` words of one text begin, and the text of each."""
    usable = np.maximum(counts - (k - 1), 0)
    owner = np.repeat(np.arange(len(counts)), usable)
    first = np.cumsum(counts) - counts
    within = np.arange(int(usable.sum())) - np.repeat(np.cumsum(usable) - usable, usable)
    return first[owner] + within, owner


def pieces(table: pa.Table, column: str, most: int = 4_000_000, rows: int = 1 << 30):
    """Slices of ``table`` of up to ``rows`` texts that hold about ``most`` bytes, one text at least."""
    if not table.num_rows:
        return
    array = as_strings(table[column])
    _, where, _ = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    at = 0
    while at < len(array):
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        yield table.slice(at, to - at)
        at = to
