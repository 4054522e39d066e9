"""NumPy kernels on the words of many texts at once: runs of digits, letters and
everything beyond ASCII, with A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .texthash import LOWER

#: Bytes of texts that a task holds open at a time. A longer text is held alone.
CHUNK = 1 << 21
WORD = np.zeros(256, bool)
WORD[0x80:] = True
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B)):
    WORD[_low:_high] = True


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most `size` bytes, or one row."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, one after the other; where each begins, and the end; number of words of each row)."""
    low = LOWER[data]
    inside = WORD[low]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # no word goes on in the next row
    begins = inside & (first[:-1] | ~np.r_[False, inside[:-1]]) if len(data) else inside
    ends = inside & (first[1:] | ~np.r_[inside[1:], False]) if len(data) else inside
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    counts = np.diff(np.searchsorted(starts, offsets))
    return low[inside], np.r_[0, np.cumsum(lengths)], counts


def word_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words as Arrow strings' bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def rows_of(counts: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(counts)), counts)
