"""Arrow helpers that keep what one task holds bounded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of `column` each; a longer single row makes a slice alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column, null as empty; offsets start at 0."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return offsets, np.frombuffer(b"".join(x for x in column.cast(pa.large_binary()).to_pylist() if x), dtype=np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(offsets: np.ndarray, data: np.ndarray, separator: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of maximal runs of bytes that are no separator; runs never cross rows nor begin before a cut."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    if cuts is not None:
        edge[:-1] |= cuts
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    if len(data):
        before[1:] = ~inside[:-1] | edge[1:-1]
        after[:-1] = ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code per word, distinct words as binary): equal codes are equal words."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64), pa.array([], pa.large_binary())
    lengths = ends - starts
    stops = np.cumsum(lengths)
    take = np.arange(stops[-1], dtype=np.int64) + np.repeat(starts - (stops - lengths), lengths)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int64)), pa.py_buffer(data[take])])
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


#: The bytes of [\x20\x09-\x0D].
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
