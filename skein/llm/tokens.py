"""Word and n-gram hashing over whole Arrow text columns, vectorised in numpy.

A batch of texts is handled as one flat byte buffer with row offsets.  Words are maximal
runs of bytes that a 256-entry table marks as word bytes; since every separator is ASCII,
byte classes give the same words as code-point classes on UTF-8.  A word's 64-bit hash is
a polynomial over its bytes, read off two prefix sums, so no Python object is made per word.

Null texts count as empty.  Texts are never cut.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_GRAM = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for every byte outside the given inclusive ranges."""
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))

class _Cache(dict):
    """Pickled empty: what the driver has computed doesn't travel with every task's code."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("n", -1) < n:
        n = max(n, 1 << 20)
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(n + 1, base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
        _powers["n"] = n
    return _powers["p"], _powers["i"]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets (one more than rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of about `most` text bytes; a longer text stays whole in a slice of its own."""
    _, offs = flat(batch.column(batch.schema.get_field_index(text)))
    n, at = batch.num_rows, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a text column: `start`, `end` (bytes), `row` and `first` (first word of each row, one more than rows)."""

    def __init__(self, col: pa.Array, keep: np.ndarray = SPACED, lower: bool = False):
        buf, offs = flat(col)
        self.buf = LOWER[buf] if lower else buf
        self.offs = offs
        tok = keep[self.buf]
        prev = np.zeros_like(tok)
        prev[1:] = tok[:-1]
        prev[offs[offs < len(buf)]] = False
        nxt = np.zeros_like(tok)
        nxt[:-1] = tok[1:]
        nxt[offs[offs > 0] - 1] = False
        self.start = np.flatnonzero(tok & ~prev)
        self.end = np.flatnonzero(tok & ~nxt) + 1
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offs[:-1], "left").astype(np.int64)
        self.first = np.append(self.first, len(self.start))

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        p, inv = _power(n)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * p[:n], dtype=np.uint64, out=s[1:])
        h = (s[self.end] - s[self.start]) * inv[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * _U(0x9FB21C651E98DF25))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `n` consecutive words within a row, and the index of each one's first word."""
    if n == 1:
        return h, np.arange(len(h))
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    g = h[at] * _GRAM[0]
    for j in range(1, n):
        g += h[at + j] * _GRAM[j]
    return mix(g), at


def pack(values: np.ndarray) -> bytes:
    """Sorted or small unsigned values as byte planes, zstd-compressed."""
    v = np.ascontiguousarray(values, np.uint64)
    return pa.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(v) else b""


def unpack(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=_U(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n), dtype=np.uint64)
