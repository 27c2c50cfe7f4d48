"""Vectorised text primitives over Arrow buffers.

A batch of strings is one byte array plus row offsets, so that words, lines and
hashes come from numpy passes instead of per-row Python. A *word* is a maximal run
without Unicode white space, as in ``functions.text.tokens``; a character of a script
that is written without blanks (see ALONE) is a word of its own, so that such text
has words at all. Rows never share a word or a line.
Null strings count as empty here; callers look at ``Texts.valid`` where it matters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: white space beyond ASCII
WIDE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Thai, Lao, Myanmar, Khmer, kana, Han
ALONE = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
#: what starts a character that could be in WIDE or ALONE
LEADS = np.zeros(256, bool)
LEADS[[0xC2, 0xE0, 0xE1, 0xE2, *range(0xE3, 0xEA), 0xEF, 0xF0]] = True
FOLDED = np.zeros(256, bool)
FOLDED[0xC3:0xF0] = True
_KIND = np.zeros(0x40000, np.uint8)
_KIND[WIDE] = 1
for _a, _b in ALONE:
    _KIND[_a : _b + 1] = 2
#: lower case of every character below 0x10000 whose UTF-8 form has as many bytes
LOWER = np.arange(0x10000, dtype=np.int64)
for _i in range(0x80, 0x10000):
    if not 0xD800 <= _i < 0xE000 and len(_c := chr(_i).lower()) == 1 and len(_c.encode()) == len(chr(_i).encode()):
        LOWER[_i] = ord(_c)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to 2**19 of them are kept per process."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, U64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 1 << 19:
            _pow[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur3 finaliser: a bijection of 64-bit words."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end] by prefix sums of a polynomial modulo 2**64."""
    n = len(values)
    pre = np.zeros(n + 1, U64)
    np.cumsum(values * powers(BASE, n), out=pre[1:])
    inv = powers(BASE_INV, n + 1)
    return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(U64))


@dataclass
class Texts:
    """Rows of a string column: data[off[i]:off[i+1]] is row i."""

    data: np.ndarray
    off: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> str:
        return self.data[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")


def texts_of(col: pa.Array | pa.ChunkedArray) -> Texts:
    """The buffers of a string column without copying the bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    n = len(col)
    if n == 0 or pa.types.is_null(col.type):
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool))
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if col.null_count == 0 else ~np.asarray(col.is_null())
    return Texts(raw, off - off[0], valid)


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Consecutive slices of a batch with about `most` bytes of text each; a longer text is a slice of its own."""
    at = batch.schema.get_field_index(column)
    whole = texts_of(batch.column(at))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(whole.off, whole.off[i] + most, side="right")) - 1)
        yield (
            batch.slice(i, j - i),
            Texts(whole.data[whole.off[i] : whole.off[j]], whole.off[i : j + 1] - whole.off[i], whole.valid[i:j]),
        )
        i = j


def characters(data: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, code point, bytes) of the characters beyond ASCII that start at bytes with `lead`; data is valid UTF-8."""
    at = np.flatnonzero(lead[data])
    b = data[at].astype(np.int64)
    size = 2 + (b >= 0xE0) + (b >= 0xF0)
    tail = [data[np.minimum(at + i, len(data) - 1)].astype(np.int64) & 63 for i in (1, 2, 3)]
    two, three = ((b & 31) << 6) | tail[0], ((b & 15) << 12) | (tail[0] << 6) | tail[1]
    four = ((b & 7) << 18) | (tail[0] << 12) | (tail[1] << 6) | tail[2]
    return at, np.where(size == 2, two, np.where(size == 3, three, four)), size


def solid_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which bytes are no white space, places and sizes of the characters that are words of their own)."""
    solid = ~SPACE[data]
    at, code, size = characters(data, LEADS)
    kind = _KIND[np.minimum(code, len(_KIND) - 1)]
    for i in range(3):
        wide = at[(kind == 1) & (size > i)] + i
        solid[wide] = False
    return solid, at[kind == 2], size[kind == 2]


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of every word."""
    n = len(t.data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid, alone, size = solid_bytes(t.data)
    cut = np.zeros(n + 1, bool)
    cut[t.off] = True
    cut[alone] = True
    cut[alone + size] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(t.off, starts, side="right") - 1


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of UTF-8 bytes, for all characters whose lower case is one character of as many bytes (see LOWER)."""
    out = data.copy()
    up = (out >= 65) & (out <= 90)
    out[up] += 32
    at, code, size = characters(data, FOLDED)
    low = LOWER[code]
    at, low, size = at[low != code], low[low != code], size[low != code]
    for n, lead in ((2, 0xC0), (3, 0xE0)):
        a, c = at[size == n], low[size == n]
        out[a] = lead | (c >> (6 * (n - 1)))
        for i in range(1, n):
            out[a + i] = 0x80 | ((c >> (6 * (n - 1 - i))) & 63)
    return out


def word_hashes(t: Texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, starts, ends, row) of every word."""
    s, e, row = words(t)
    if len(s) == 0:
        return np.zeros(0, U64), s, e, row
    data = fold(t.data) if lower else t.data
    return spans_hash(data.astype(U64) + U64(1), s, e), s, e, row


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of every line that has a byte other than white space."""
    n = len(t.data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    nl = np.flatnonzero(t.data == 10)
    starts = np.unique(np.concatenate([t.off[:-1], nl + 1]))
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    solid = np.zeros(n + 1, np.int64)
    np.cumsum(solid_bytes(t.data)[0], out=solid[1:])
    has = solid[ends] > solid[starts]
    starts, ends = starts[has], ends[has]
    row = np.searchsorted(t.off, starts, side="right") - 1
    ends = ends - (t.data[ends - 1] == 10)
    return starts, ends, row


def splitmix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Pseudorandom 64-bit words from integers."""
    return mix(x.astype(U64) * U64(BASE) + U64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & ((1 << 64) - 1)))
