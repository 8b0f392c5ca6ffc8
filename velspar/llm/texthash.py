"""Words, word hashes and word-shingle hashes of whole UTF-8 texts, vectorised over bytes.

A slice of texts is one byte array with offsets. Word boundaries come from a byte table, word hashes from prefix sums of a
polynomial over the ring of 64-bit integers, and shingle hashes from weighted sums of word hashes, all finished by a mixing step.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


WEIGHTS = mix(np.arange(1, 65, dtype=U)) | U(1)

#: Bytes that separate words: white space alone, as in [^\x20\x09-\x0D]+, or all but letters, digits and non-ASCII bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NONWORD = np.ones(256, bool)
NONWORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_BYTES = mix(_LOWER.astype(U) + U(77))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def tidy() -> None:
    """Give freed memory back to the system: allocators keep it, and workers of Python live on beside the next ones until Spark ends them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def tidied(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """The generator, with tidy() once it is through and its own arrays are gone."""

    @functools.wraps(f)
    def run(*args: object) -> Iterator:
        yield from f(*args)
        tidy()

    return run


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one more entry at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * down[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(U))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all width-word shingles in text order, and for each text the number of shingles before it.

    A text of 1 to width - 1 words has its whole sequence as its one shingle.
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(bounds[:-1] - at[:-1], count) + np.arange(at[-1])
    size = np.repeat(np.minimum(n, width), count)
    out = size.astype(U)
    padded = np.concatenate((hashes, np.zeros(width, U)))
    for k in range(width):
        out += np.where(size > k, padded[first + k], U(0)) * WEIGHTS[k]
    return mix(out), at


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; a longer text has a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def one(text: str | None, separators: np.ndarray = SPACE) -> np.ndarray:
    """Word hashes of one text."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), separators)
    return word_hashes(data, starts, ends)
