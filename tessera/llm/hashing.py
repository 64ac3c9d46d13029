"""Vectorised word, shingle and window hashes over the byte buffers of Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so multi-byte characters stay whole. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BYTE[SEPARATOR] = 0
_R, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed, published constants)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


def power(base: np.uint64, n: int) -> np.uint64:
    return U(pow(int(base), n, 1 << 64))


def text_chunks(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) for runs of rows of about `limit` bytes, one row at least."""
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    starts: np.ndarray  # byte position of each word
    ends: np.ndarray
    first: np.ndarray  # of each document, the index of its first word; one more entry for the end
    doc: np.ndarray  # document of each word


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    gap = SEPARATOR[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[edge] = True
    after[edge - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, first, np.repeat(np.arange(len(offsets) - 1), np.diff(first)))


def word_hashes(data: np.ndarray, w: Words, lower: bool = False) -> np.ndarray:
    """A hash of each word's bytes, A-Z as a-z if `lower`."""
    if not len(w.starts):
        return np.empty(0, U)
    longest = int((w.ends - w.starts).max())
    begin = np.zeros(len(data), np.int64)
    begin[w.starts] = w.starts
    at = np.arange(len(data)) - np.maximum.accumulate(begin)
    value = _BYTE[_LOWER[data] if lower else data]
    value *= _powers(_R, longest + 1)[np.minimum(at, longest)]
    total = np.add.reduceat(value, w.starts)
    return mix(total + (w.ends - w.starts).astype(U) * _Q)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive hashes from each position; n - 1 entries fewer. Not yet mixed."""
    if len(h) < n:
        return np.empty(0, U)
    parts, size, block, at = [], 1, h, 0
    while True:
        if n & size:
            parts.append((at, block))
            at += size
        if size * 2 > n:
            break
        block = block[:-size] + power(_Q, size) * block[size:]
        size *= 2
    out, m = np.zeros(len(h) - n + 1, U), len(h) - n + 1
    for at, block in parts:
        out += power(_Q, at) * block[at : at + m]
    return out


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i] .. begin[i] + size[i] - 1 for each i, one after another."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of word hashes."""
    total = np.array([(h * _powers(_Q, len(h))).sum(dtype=U)], U)
    return mix(total + np.array([len(h)], U) * _R)[0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its lower-cased `size`-word shingles; the whole sequence if it is shorter; empty without words."""
    w = words(data, offsets)
    h = word_hashes(data, w, lower=True)
    grams = mix(windows(h, size))
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(np.array([sequence_hash(h[a:b])], U) if b > a else np.empty(0, U))
    return out


def lists(column: pa.Array) -> list[np.ndarray]:
    """Views on the values of a list column's rows; a null row is empty."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(column) else []


def long_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=ends[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == U else flat.astype(np.int64)))
