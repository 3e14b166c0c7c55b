"""Vectorised text kernels on UTF-8 buffers, shared by the operators of this subpackage.

Everything here works on the raw bytes of an Arrow string column with numpy, a
bounded slice of bytes at a time, so that memory follows the slice and not the
batch.  Nothing is decoded unless a caller needs a Python string.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; temporaries take some forty times as much.
SLICE_BYTES = 1 << 19

_U = np.uint64


@cache
def _allocator():
    """The C library's allocator, told to map large arrays one by one, so that each goes back
    when it is freed; Arrow allocates from it as well.  None where there is none to tell."""
    libc = ctypes.CDLL(None)
    if not (hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim")):
        return None
    libc.mallopt(-3, 4 << 20)  # the size from which an array is mapped on its own; a set value stays
    libc.mallopt(-8, 2)  # arenas
    pa.set_memory_pool(pa.system_memory_pool())
    return libc


def give_back() -> None:
    """Hand this process's freed memory back to the system."""
    if (libc := _allocator()) is not None:
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run(batches)`` of ``mapInArrow``, whose reused worker keeps no memory afterwards."""

    @wraps(run)
    def go(batches):
        _allocator()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return go


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply rounds), element by element."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=_U)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PLACE = mix64(np.arange(1, 4097, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)
#: White space of every contract here: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        size = 1 << int(n - 1).bit_length()
        _PLACE = mix64(np.arange(1, size + 1, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)
    return _PLACE


def hash_spans(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive spans that tile ``data``; no span is empty."""
    if not len(lengths):
        return np.zeros(0, dtype=_U)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.int64) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        parts = _BYTE[data] * _places(int(lengths.max()))[place]
        return mix64(np.add.reduceat(parts, first) + lengths.astype(_U) * _U(0x9E3779B97F4A7C15))


def combine(columns: list[np.ndarray]) -> np.ndarray:
    """An order-dependent 64-bit hash of parallel hash columns."""
    with np.errstate(over="ignore"):
        out = np.full(len(columns[0]), 0x243F6A8885A308D3, dtype=_U)
        for c in columns:
            out = mix64(out * _U(0x9E3779B97F4A7C15) + c)
        return out


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words of each row): maximal runs of bytes not ``outside`` inside a row."""
    n = len(data)
    inside = ~outside[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    after = np.concatenate((inside[1:], [False])) if n else inside
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each row), in slices of bounded size."""
    hashes, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for i, j in slices(offsets):
        b = data[offsets[i] : offsets[j]]
        starts, ends, n = word_spans(b, offsets[i : j + 1] - offsets[i])
        held = b[~SPACE[b]]
        hashes.append(hash_spans(_LOWER[held] if lower else held, ends - starts))
        counts.append(n)
    return np.concatenate(hashes), np.concatenate(counts)


#: Words that are hashed at once by ``rolling``; also the longest run.
_SPAN = 1 << 15


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """(powers of an odd number, powers of its inverse) modulo 2**64."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(2 * _SPAN, b, _U)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def rolling(hashes: np.ndarray, width: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive hashes: their polynomial in an odd
    ``base`` modulo 2**64.  Runs that differ anywhere collide with a chance of 2**-64, as the
    hashes themselves are spread evenly; its cost doesn't depend on ``width``."""
    n = len(hashes) - width + 1
    if width > _SPAN:
        raise ValueError(f"runs of more than {_SPAN} words")
    out = np.empty(max(n, 0), _U)
    up, down = _powers(base)
    with np.errstate(over="ignore"):
        for i in range(0, n, _SPAN):
            j = min(n, i + _SPAN)
            part = hashes[i : j + width - 1]
            sums = np.cumsum(part * up[: len(part)], dtype=_U)
            span = sums[width - 1 :].copy()
            span[1:] -= sums[: j - i - 1]
            out[i:j] = span * down[: j - i]
    return out


def run_rows(counts: np.ndarray, width: int) -> np.ndarray:
    """How many runs of ``width`` words each row has."""
    return np.maximum(counts - width + 1, 0)


def run_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Place of the first word of each run of ``width`` words inside a row."""
    runs = run_rows(counts, width)
    first = np.cumsum(runs) - runs
    return np.arange(int(runs.sum())) + np.repeat(np.cumsum(counts) - counts - first, runs)


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place of its first word) of every run of ``width`` words inside a row."""
    at = run_starts(counts, width)
    row = np.repeat(np.arange(len(counts)), run_rows(counts, width))
    return (mix64(rolling(hashes, width)[at]) if len(at) else np.zeros(0, _U)), row, at


def first_of(codes: np.ndarray, n: int) -> np.ndarray:
    """The first index at which each of the codes 0..n-1 stands."""
    first = np.empty(n, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


def grouped(keys: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, each with its smallest value of ``least``."""
    if not len(keys):
        return keys, least
    order = np.lexsort((least, keys))
    k, v = keys[order], least[order]
    head = np.concatenate(([True], k[1:] != k[:-1]))
    return k[head], v[head]
