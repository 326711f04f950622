"""Vectorised kernels over the UTF-8 bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about `most` bytes of text, a longer text alone; bytes and offsets with each."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and how many words each text has."""
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), _ODD, U64))
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    values = _LOWER[data[place + np.repeat(starts, lengths)]].astype(U64)
    values += U64(1)
    values *= powers[place]
    return mix(np.add.reduceat(values, begin))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles; a text with fewer
    words has one for its whole sequence, a text without words none."""
    starts, ends, counts = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    scale = mix(np.arange(1, size + 1, dtype=U64) * _ODD) | U64(1)
    runs = np.zeros(max(0, len(hashes) - size + 1), U64)
    for k in range(size):
        runs += hashes[k : k + len(runs)] * scale[k]
    runs = mix(runs)
    at = 0
    for n in counts.tolist():
        if n >= size:
            yield np.unique(runs[at : at + n - size + 1])
        elif n:
            yield mix((hashes[at : at + n] * scale[:n]).sum(keepdims=True) + U64(n))
        else:
            yield runs[:0]
        at += n
