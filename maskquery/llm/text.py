"""Texts as flat byte arrays: slices of an Arrow batch, word bounds and 64-bit hashes without a Python object per word.

Everything here works on UTF-8 bytes. A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BLOCK = 1 << 18

#: Maps A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for bytes of words that ASCII white space separates.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: True for digits, letters a-z and all bytes of characters beyond ASCII (to use after LOWER).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without a copy."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts hold about ``limit`` bytes (one row at least) with their flat bytes and offsets."""
    data, off = flat(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def bounds(is_word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut at row offsets; and the index of each row's first run (n + 1)."""
    n = len(is_word)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | cut[1:n]
    stop = is_word.copy()
    stop[:-1] &= ~is_word[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, off)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _cache or len(_cache[which][0]) < n:
        b = _BASES[which]
        _cache[which] = _powers(b, max(n, _BLOCK)), _powers(pow(b, -1, 1 << 64), max(n, _BLOCK))
    return _cache[which]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def run_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte run ``data[s:e]``: equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(s), np.uint64)
    lo = 0
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(e, s[lo] + _BLOCK, side="right")))
        a, b = int(s[lo]), int(e[hi - 1])
        power, inverse = _tables(which, b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
        out[lo:hi] = (sums[e[lo:hi] - a] - sums[s[lo:hi] - a]) * inverse[s[lo:hi] - a]
        lo = hi
    return mix(out)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries (all rows run together; the caller drops those that cross a row)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all entries of the ranges ``[start, start + length)``, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - skip, lengths)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
