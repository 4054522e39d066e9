"""NumPy kernels on the UTF-8 bytes of one text: word hashes, shingles, windows."""

from __future__ import annotations

import numpy as np

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Multiplier of the rolling word hash, odd so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


#: A random 64-bit value for each byte value.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
#: Space and the bytes 0x09-0x0D part words; all else belongs to words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = 1 << max(12, int(n).bit_length())
        with np.errstate(over="ignore"):
            _powers["up"] = np.multiply.accumulate(np.r_[U(1), np.full(size - 1, _BASE, np.uint64)])
            _powers["down"] = np.multiply.accumulate(np.r_[U(1), np.full(size - 1, _INVERSE, np.uint64)])
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal spans hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray) -> np.ndarray:
    return span_hashes(data, *word_bounds(data))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; of the whole sequence if it is shorter."""
    k = min(width, len(words))
    if not k:
        return words
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * U(_BASE) + words[i : len(words) - k + 1 + i])
    return mix(out + U(k))
