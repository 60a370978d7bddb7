"""Texts of an Arrow batch as one byte buffer, cut into words and lines with numpy; used inside tasks.

White space is the ASCII set of the contracts: space and the bytes 9 to 13. All of it is one byte in
UTF-8, so cutting bytes never splits a character.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Hand free memory back to the machine: workers outlive tasks, and several share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(task: Task) -> Task:
    """The task, giving its memory back when it ends, also when it fails or is cut short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in runs of rows with about `most` bytes of text: bounds the memory of numpy's work."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of the given lengths that lie one after another in data."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ids of integers, and how many there are."""
    got = pa.array(values).dictionary_encode()
    return got.indices.to_numpy(), len(got.dictionary)


class Words:
    """Words of the texts: byte range, text index and per-text counts; ids are equal for equal words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> None:
        inside = ~space[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[offsets] = True
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        self.data, self.offsets, self.inside = data, offsets, inside
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """Id of each word, and the distinct words by id."""
        got = binary_array(self.data[self.inside], self.ends - self.starts).dictionary_encode()
        return got.indices.to_numpy(), got.dictionary


def line_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every line; a text without line feed is one line, also the empty one."""
    feeds = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(feeds, offsets)) + 1
    text = np.repeat(np.arange(len(offsets) - 1), count)
    first = np.cumsum(count) - count
    starts, ends = np.empty(len(text), dtype=np.int64), np.empty(len(text), dtype=np.int64)
    is_first = np.zeros(len(text), dtype=bool)
    is_first[first] = True
    starts[is_first], starts[~is_first] = offsets[:-1], feeds + 1
    is_last = np.zeros(len(text), dtype=bool)
    is_last[first + count - 1] = True
    ends[is_last], ends[~is_last] = offsets[1:], feeds
    return starts, ends, text


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the byte-wise values of each text."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
