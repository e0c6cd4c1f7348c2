"""Byte-level text helpers shared by the Arrow-side operators.

Texts arrive as Arrow string columns; everything here works on their UTF-8
bytes with numpy, a bounded chunk of whole documents at a time, so memory
follows the chunk (or the longest single document), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_U = np.uint64


def _table(*spans: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for lo, hi in spans:
        t[lo : hi + 1] = True
    return t


#: Separators of "[^\x20\x09-\x0D]+" words.
SPACE = _table((0x20, 0x20), (0x09, 0x0D))
#: Separators of "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" words, after lower-casing.
NOT_ALNUM = _table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = _ipow = np.ones(1, _U)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; other seeds give other, independent-looking values."""
    h = h ^ _U(seed * 0xD6E8FEB86659FD93 % 2**64)
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, 2 * CHUNK)
        base, inv = np.full(size, _BASE), np.full(size, _INV)
        base[0] = inv[0] = 1
        _pow, _ipow = np.multiply.accumulate(base), np.multiply.accumulate(inv)
    return _pow, _ipow


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash (mod 2**64) of 64-bit values."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of [lo, hi), whatever their place in the sequence."""
    return mix((pre[hi] - pre[lo]) * _powers(len(pre))[1][lo])


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    return prefix(_BYTE[buf])


def words(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and each document's first word.

    `offs` has one more entry than there are documents; no word crosses it.
    """
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    np.logical_not(separators[buf], out=inside[1 : n + 1])
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~here))
    return starts, ends, np.searchsorted(starts, offs)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents."""
    buf, offs = string_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each word, from documents' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Word indices at which a window of `length` words fits in its document."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    lens = np.diff(first)
    fits = lens >= length
    np.add.at(ok, first[:-1][fits], 1)
    np.add.at(ok, (first[:-1] + lens - length + 1)[fits], -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n words lie in any window [start, start + length)."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64)
    d -= np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(d[:n]) > 0


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a per-word array by document."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
