"""Vectorised byte-string helpers shared by the text operators.

Everything works on one flat ``uint8`` buffer with document offsets, the
layout an Arrow string column already has, so no per-document Python loop is
needed. Hashes are prefix polynomial hashes modulo 2**64: with an odd base the
powers are invertible, so the hash of any substring is one subtraction and one
multiplication away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_2 = 0xD6E8FEB86659FD93 | 1

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n, kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 12)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            out.append(p)
        _POWERS[base] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread entropy over all 64 bits (finaliser of a multiplicative hash)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


class PrefixHash:
    """Prefix polynomial hashes of a buffer; ``span(i, n)`` hashes [i, i+n)."""

    def __init__(self, buf: np.ndarray, base: int = BASE):
        n = len(buf)
        p, self.inv = powers(n + 1, base)
        self.pref = np.zeros(n + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum((buf.astype(U64, copy=False) + U64(1)) * p[:n], out=self.pref[1:])

    def span(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.pref[start + length] - self.pref[start]) * self.inv[start]

    def every(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, by start."""
        n = len(self.pref) - 1
        m = max(0, n - length + 1)
        with np.errstate(over="ignore"):
            return (self.pref[length : length + m] - self.pref[:m]) * self.inv[:m]


def windows(buf: np.ndarray, width: int = 8) -> np.ndarray:
    """A mixed hash of the eight bytes from each place on (none for the last
    seven). Prefix hashes over these have no structure of the bytes left in which
    strings such as a Thue-Morse word and its complement meet modulo 2**64; a
    string of n bytes is n - 7 windows."""
    if len(buf) < width:
        return np.zeros(0, U64)
    raw = np.ascontiguousarray(buf)
    return mix(np.ndarray((len(raw) - width + 1,), "<u8", raw, strides=(1,)).astype(U64))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow column as (bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int):
    """Runs [lo, hi) of documents whose bytes together stay near ``limit``."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + c)``."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    at = np.cumsum(counts) - counts
    keep = counts > 0
    first, s, c = at[keep], starts[keep], counts[keep]
    out[first[0]] = s[0]
    if len(first) > 1:
        out[first[1:]] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)
