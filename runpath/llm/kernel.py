"""Vectorised byte kernels shared by the text operators.

All of them work on one flat uint8 buffer holding many texts back to back and an
offset array (text i is ``data[off[i]:off[i + 1]]``), which is what an Arrow
binary column is already.  Nothing here is per-row Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
# Odd 64-bit multipliers (golden ratio and the murmur/splitmix finaliser constants).
BASE = 0x9E3779B97F4A7C15
MIX_1 = U(0xFF51AFD7ED558CCD)
MIX_2 = U(0xC4CEB9FE1A85EC53)
STEP = U(0xD1342543DE82EF95)

#: Bytes hashed at a time: the temporaries of one slice stay in a core's cache.
SLICE = 1 << 16


def separators(spans: list[tuple[int, int]]) -> np.ndarray:
    """bool[256], true for the bytes inside the given inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


#: Words between ASCII blanks: ``[^\x20\x09-\x0D]+``.
BLANKS = separators([(0x09, 0x0D), (0x20, 0x20)])
#: Words of ASCII letters, digits and everything beyond ASCII (upper case is folded, so A-Z belong to words).
NON_ALNUM = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _byte_codes() -> np.ndarray:
    codes = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    return codes[LOWER]


CODES = _byte_codes()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of BASE modulo 2^64, and of its inverse."""
    size = max(SLICE * 2, 1 << (n - 1).bit_length())
    if size not in _POW:
        _POW[size] = (_powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size))
        for old in [k for k in _POW if k < size]:
            del _POW[old]
    return _POW[size]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Arrow string/binary column to (data, offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], rows: int, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, and of few rows where texts are long: at most `size` bytes of text, or one text."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = flat(b.column(column))
        at = 0
        while at < b.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1))
            yield b.slice(at, to - at)
            at = to


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def trim() -> None:
    """Give freed memory back to the system: a worker lives on after its task, and what it holds counts."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(run: Task) -> Task:
    """A task function that gives its memory back when it is over."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit; in place."""
    h ^= h >> U(33)
    h *= MIX_1
    h ^= h >> U(33)
    h *= MIX_2
    h ^= h >> U(33)
    return h


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of the first word (n + 1 entries)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~sep[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < n)]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    st = np.flatnonzero(start)
    return st, np.flatnonzero(end) + 1, np.searchsorted(st, off)


def hash_spans(data: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, A-Z folded; spans ascend and do not overlap."""
    out = np.empty(len(st), dtype=np.uint64)
    i, m = 0, len(st)
    while i < m:
        a = int(st[i])
        j = max(i + 1, int(np.searchsorted(en, a + SLICE, side="right")))
        b = int(en[j - 1])
        pw, inv = powers(b - a)
        sums = np.empty(b - a + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(CODES[data[a:b]] * pw[: b - a], out=sums[1:])
        s = st[i:j] - a
        out[i:j] = (sums[en[i:j] - a] - sums[s]) * inv[s]
        i = j
    # The length tells a span from the same span with low-order zeros appended.
    out += (en - st).astype(np.uint64) * STEP
    return mix(out)


def word_hashes(column: pa.Array, sep: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a column, and the number of the first word of each text."""
    data, off = flat(column)
    st, en, first = words(data, off, sep)
    return hash_spans(data, st, en), first


def combine(*parts: np.ndarray) -> np.ndarray:
    """Order-dependent hash of equally long arrays of hashes."""
    h = parts[0] * STEP
    for p in parts[1:]:
        h += p
        h *= STEP
        h ^= h >> U(29)
    return mix(h)


def owner(first: np.ndarray) -> np.ndarray:
    """Number of the text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def fold(raw: bytes) -> bytes:
    """A-Z to a-z, nothing else."""
    return raw.lower()


def code_points_before(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end), how many code points start before it."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
