"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 buffer of an Arrow string column: no Python
string is made for a row.  Work is cut into slices of bounded size, and a text
longer than a slice is cut where the caller says that a cut is harmless, so
memory stays bounded by the slice and not by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most `most` bytes, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODE = mix(np.arange(1, 65537, dtype=np.uint64) * _MULT)


def powers(n: int, which: str) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = np.uint64(_BASE if which == "up" else _BASE_INV)
        with np.errstate(over="ignore"):
            have = np.concatenate([np.ones(1, np.uint64), np.full(max(n, SLICE_BYTES + 64) - 1, base)])
            np.multiply.accumulate(have, out=have)
        _powers[which] = have
    return have[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial sum of the first i symbols, modulo 2**64."""
    if codes.dtype.itemsize < 4 or not len(codes) or codes.max() < 65536:
        v = _CODE[codes]
    else:
        v = np.where(codes < 65536, _CODE[codes & 65535], mix(codes.astype(np.uint64) * _MULT))
    h = np.empty(len(codes) + 1, np.uint64)
    h[0] = 0
    np.multiply(v, powers(len(codes), "up"), out=v)
    np.cumsum(v, out=h[1:])
    return h


def segment_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of segments, equal for equal symbols wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    x = (h[end] - h[start]) * powers(int(start.max()) + 1, "down")[start]
    return mix(x + (end - start).astype(np.uint64) * _MULT)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of rows: hash, start and end byte, and row.

    A-Z count as a-z when `lower`.  Row limits end words too.
    """
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    word = ~_IS_SPACE[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    glued = np.unique(inner[word[inner - 1] & word[inner]])
    marks = np.flatnonzero(edge)
    if len(glued):  # a word may end and another start at a row's limit
        marks = np.sort(np.concatenate([marks, glued, glued]))
    start, end = marks[0::2], marks[1::2]
    h = prefix_hash(_LOWER[raw] if lower else raw)
    return segment_hash(h, start, end), start, end, np.searchsorted(offsets, start, "right") - 1


def word_chunks(raw: np.ndarray, offsets: np.ndarray, a: int, b: int, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) pieces of rows [a, b): one piece, or for one long row several that are cut at blanks."""
    lo, hi = int(offsets[a]), int(offsets[b])
    if b - a > 1 or hi - lo <= most:
        yield raw[lo:hi], offsets[a : b + 1] - lo
        return
    while lo < hi:
        cut = min(lo + most, hi)
        while cut < hi:
            ahead = np.flatnonzero(_IS_SPACE[raw[cut : cut + most]])
            if len(ahead):
                cut += int(ahead[0])
                break
            cut = min(cut + most, hi)
        yield raw[lo:cut], np.array([0, cut - lo])
        lo = cut


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of valid UTF-8."""
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.uint32), np.arange(len(raw))
    pos = np.flatnonzero((raw & 0xC0) != 0x80)
    b0 = raw[pos].astype(np.uint32)
    pad = np.concatenate([raw, np.zeros(3, np.uint8)])
    cp = b0.copy()
    for least, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        at = np.flatnonzero((b0 >= least) & (b0 < {0xC0: 0xE0, 0xE0: 0xF0, 0xF0: 0x100}[least]))
        if len(at):
            x = b0[at] & mask
            for k in range(1, size):
                x = (x << 6) | (pad[pos[at] + k] & 0x3F)
            cp[at] = x
    return cp, pos


class HashTable:
    """Open addressing from 64-bit keys to int32 values, looked up by whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.full(1 << bits, -1, np.int32)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that are not there."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (keys & mask).astype(np.int64)
        out = self.vals[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(todo):
            s = (slot[todo] + 1) & int(mask)
            slot[todo] = s
            out[todo] = self.vals[s]
            todo = todo[(self.keys[s] != keys[todo]) & (out[todo] >= 0)]
        return out

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        while (self.n + len(keys)) * 2 > 1 << self.bits:
            old = self.vals >= 0
            k, v = self.keys[old], self.vals[old]
            self.__init__(self.bits + 1)
            self._put(k, v)
        self._put(keys, vals)

    def _put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        self.n += len(keys)
        mask = (1 << self.bits) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.vals[slot] < 0
            s, k, v = slot[free], keys[free], vals[free]
            self.keys[s], self.vals[s] = k, v  # of keys for one slot, the last stays
            done = np.zeros(len(keys), bool)
            done[np.flatnonzero(free)[self.vals[s] == v]] = True
            keys, vals, slot = keys[~done], vals[~done], (slot[~done] + 1) & mask


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)
