"""Adaptive context-mixing range coder for token ids.

A block of ids is cut into equal lanes that are coded in step: at each step the
model gives a distribution for the next id of every lane, so all arithmetic is
on arrays.  The model mixes three predictions:

* order 2: the id that last followed this pair of ids (a hashed table),
* order 1: the id that last followed this id,
* order 0: adaptive frequencies of all ids,

with weights learned for each pair of confidences of the first two (and whether
they agree): first one of {order-2 id, order-1 id, neither} is coded, then, for
neither, the id itself by its order-0 frequency.  All lanes of a block share the
model; every block starts from an empty one and carries checksums of its ids
and of its bytes, so a block can be read, verified and skipped by itself.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Ids of a block at most.
BLOCK_IDS = 1 << 20
#: Ids of a lane at most.
LANE_IDS = 256
#: Steps between two refreshes of frequencies, at first.
REFRESH = 8
#: Steps after which refreshes are half as frequent.
WARM = 64

_MAGIC = b"CMR2"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, steps, alphabet, crc of the ids, crc of the rest
_U32, _U12 = np.uint64(32), np.uint64(12)
_U1, _U3, _U7 = np.uint32(1), np.uint32(3), np.uint32(7)
#: What a prediction's confidence gains or, modulo 2**32, loses, by twice the confidence plus whether it was right.
_CHANGE = np.array([x for sure in range(8) for x in ((sure >> 1) - sure, int(sure < 7))], np.int64).astype(np.uint32)
_KIND = np.arange(3, dtype=np.uint32)
_TOP = np.uint64(1 << 32)
#: Totals of at most so many bits leave a lane's span of 2**32 enough for both of a step's codings.
_ONCE = 19
_PAIR_BITS = 18
_GAIN = 8


class BlockError(ValueError):
    """A block's bytes or ids do not match its checksums."""


class _Model:
    """What both directions learn alike, step by step."""

    def __init__(self, alphabet: int, lanes: int):
        # predictions: id * 8 + confidence
        self.after2 = np.zeros(1 << _PAIR_BITS, np.uint32)
        self.after1 = np.zeros(alphabet, np.uint32)
        self.seen = np.ones(alphabet, np.uint32)
        self.mixed = np.ones((128, 3), np.int64)
        self.last1 = np.zeros(lanes, np.uint32)
        self.last2 = np.zeros(lanes, np.uint32)
        self.bits = max(12, (alphabet - 1).bit_length() + 3)
        self.every = np.arange(alphabet + 1, dtype=np.uint64)
        self.kinds: list[np.ndarray] = []
        self.news: list[np.ndarray] = []
        self.steps = 0
        self._refresh()

    def _refresh(self) -> None:
        # of a total that is a power of two: dividing is shifting, and an id is looked up by its place
        upto = np.zeros(len(self.seen) + 1, np.uint64)
        np.cumsum(self.seen, out=upto[1:])
        self.cum = (upto * np.uint64((1 << self.bits) - len(self.seen)) // upto[-1] + self.every).astype(np.uint32)
        self.places = np.diff(self.cum)
        share = self.mixed * 4093 // self.mixed.sum(1, keepdims=True) + 1
        share[:, 2] += 4096 - share.sum(1)
        self.share = share.astype(np.uint64)
        self.start = np.zeros((128, 4), np.uint64)
        np.cumsum(self.share, axis=1, out=self.start[:, 1:])
        self.share_flat = self.share.ravel()
        self.start_flat = np.ascontiguousarray(self.start[:, :3]).ravel()
        self.second, self.third = (np.ascontiguousarray(self.start[:, k]) for k in (1, 2))

    def symbols(self) -> np.ndarray:
        """The id of each place of the total."""
        return np.repeat(np.arange(len(self.places), dtype=np.uint16 if len(self.places) <= 1 << 16 else np.uint32), self.places)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order-2 ids, order-1 ids, mixing context) of the lanes."""
        self.at2 = ((self.last1 * np.uint32(0x9E3779B1)) ^ (self.last2 * np.uint32(0x85EBCA77))) >> np.uint32(32 - _PAIR_BITS)
        self.at2, self.at1 = self.at2.astype(np.intp), self.last1.astype(np.intp)
        self.held2, self.held1 = self.after2[self.at2], self.after1[self.at1]
        p2, p1 = self.held2 >> _U3, self.held1 >> _U3
        self.sure2, self.sure1 = self.held2 & _U7, self.held1 & _U7
        self.context = ((self.sure2 << _U3) + self.sure1) * np.uint32(2) + (p1 == p2)
        return p2, p1, self.context

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, slot: np.ndarray, new: np.ndarray) -> bool:
        """Whether frequencies were refreshed.  hit2, hit1: lanes whose order-2 or order-1 id was right; slot: three times the context, plus 0 for order 2, 1 for order 1, 2 for neither; new: the ids of the last kind."""
        fresh = (ids << _U3) | np.uint32(1)
        for table, at, held, sure, hit in ((self.after2, self.at2, self.held2, self.sure2, hit2), (self.after1, self.at1, self.held1, self.sure1, hit1)):
            table[at] = np.where(hit | (sure > _U1), held + _CHANGE[(sure << _U1) + hit], fresh)
        self.kinds.append(slot)
        self.news.append(new)
        self.last2, self.last1 = self.last1, ids
        self.steps += 1
        if self.steps % (REFRESH if self.steps < WARM else 2 * REFRESH) == 0 or self.steps < 4:
            self.mixed += np.bincount(np.concatenate(self.kinds), minlength=384).reshape(128, 3) * 4
            self.seen += (np.bincount(np.concatenate(self.news), minlength=len(self.seen)) * _GAIN).astype(np.uint32)
            self.kinds, self.news = [], []
            self._refresh()
            return True
        return False


def lanes_of(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block of n ids."""
    steps = min(LANE_IDS, max(1, math.isqrt(n)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """The bytes of a block of at most BLOCK_IDS ids under `alphabet` (2**22 at most)."""
    n = len(ids)
    if n > BLOCK_IDS:
        raise ValueError(f"{n} ids in a block")
    ids = np.ascontiguousarray(ids, np.uint32)
    if n and int(ids.max()) >= alphabet:
        raise ValueError(f"id {int(ids.max())} in an alphabet of {alphabet}")
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return _HEAD.pack(_MAGIC, 0, 0, 0, alphabet, crc, zlib.crc32(b""))
    lanes, steps = lanes_of(n)
    grid = np.zeros(lanes * steps, np.uint32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(alphabet, lanes)
    bits = np.uint64(model.bits)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words = np.zeros((lanes, steps * 2 + 3), np.uint64)  # a carry may pass 2**32 until the end
    used = np.zeros(lanes, np.int64)
    every = np.arange(lanes)

    def emit(at: np.ndarray) -> None:
        words[at, used[at]] = low[at] >> _U32
        used[at] += 1
        low[at] <<= _U32
        span[at] <<= _U32

    with np.errstate(over="ignore"):
        for k in range(steps):
            t = grid[k]
            p2, p1, context = model.predict()
            hit2, hit1 = p2 == t, p1 == t
            kind = np.where(hit2, _KIND[0], np.where(hit1, _KIND[1], _KIND[2]))
            slot = (context * np.uint32(3) + kind).astype(np.intp)
            r = span >> _U12
            moved = low + r * model.start_flat[slot]
            over = np.flatnonzero(moved < low)
            if len(over):
                words[over, used[over] - 1] += np.uint64(1)
            low[:] = moved
            np.multiply(r, model.share_flat[slot], out=span)
            if bits > _ONCE and len(at := np.flatnonzero(span < _TOP)):
                emit(at)
            m = np.flatnonzero(kind == 2)
            new = t[m]
            if len(m):
                r = span[m] >> bits
                was = low[m]
                moved = was + r * model.cum[new]
                over = m[moved < was]
                if len(over):
                    words[over, used[over] - 1] += np.uint64(1)
                low[m] = moved
                span[m] = r * model.places[new]
            at = np.flatnonzero(span < _TOP)
            if len(at):
                emit(at)
            model.learn(t, hit2, hit1, slot, new)
        end = low + np.uint64((1 << 32) - 1)
        over = np.flatnonzero(end < low)
        if len(over):
            words[over, used[over] - 1] += np.uint64(1)
        words[every, used] = end >> _U32
        used += 1
    words = words[:, : int(used.max())]
    while (high := words >> _U32).any():  # carries, to the word before
        words &= np.uint64(0xFFFFFFFF)
        words[:, :-1] += high[:, 1:]
    flat = words[np.arange(words.shape[1]) < used[:, None]].astype("<u4")
    rest = used.astype("<u2").tobytes() + flat.tobytes()
    return _HEAD.pack(_MAGIC, n, lanes, steps, alphabet, crc, zlib.crc32(rest)) + rest


def block_length(data: memoryview) -> int:
    """Bytes of the block at the start of data."""
    magic, n, lanes, *_ = _HEAD.unpack(data[: _HEAD.size])
    if magic != _MAGIC:
        raise BlockError("not a block")
    return _HEAD.size + 2 * lanes + 4 * int(np.frombuffer(data[_HEAD.size : _HEAD.size + 2 * lanes], "<u2").sum(dtype=np.int64))


def decode_block(data: memoryview) -> np.ndarray:
    """The ids of a block."""
    data = memoryview(data)
    magic, n, lanes, steps, alphabet, crc, rest_crc = _HEAD.unpack(data[: _HEAD.size])
    rest = data[_HEAD.size :]
    if magic != _MAGIC or zlib.crc32(rest) != rest_crc:
        raise BlockError("the bytes of a block do not match their checksum")
    if not n:
        return np.zeros(0, np.uint32)
    used = np.frombuffer(rest[: 2 * lanes], "<u2").astype(np.int64)
    flat = np.concatenate([np.frombuffer(rest[2 * lanes :], "<u4").astype(np.uint64), np.zeros(4, np.uint64)])
    at_word = np.cumsum(used) - used
    end_word = at_word + used

    def word(at: np.ndarray) -> np.ndarray:
        pos = at_word[at]
        at_word[at] += 1
        return np.where(pos < end_word[at], flat[np.minimum(pos, len(flat) - 1)], np.uint64(0))

    every = np.arange(lanes)
    code = word(every) << _U32
    code |= word(every)
    span = np.full(lanes, (1 << 64) - 1, np.uint64)
    model = _Model(alphabet, lanes)
    bits, last, symbol = np.uint64(model.bits), np.uint64((1 << model.bits) - 1), model.symbols()
    grid = np.zeros((steps, lanes), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(steps):
            p2, p1, context = model.predict()
            r = span >> _U12
            row = context.astype(np.intp)
            kind = (code >= r * model.second[row]).astype(np.uint32) + (code >= r * model.third[row])
            slot = row * 3 + kind
            code -= r * model.start_flat[slot]
            np.multiply(r, model.share_flat[slot], out=span)
            if bits > _ONCE and len(at := np.flatnonzero(span < _TOP)):
                code[at] = (code[at] << _U32) | word(at)
                span[at] <<= _U32
            t = np.where(kind == 0, p2, p1)
            m = np.flatnonzero(kind == 2)
            new = t[m]
            if len(m):
                r = span[m] >> bits
                new = symbol[np.minimum(code[m] // r, last)].astype(np.uint32)
                t[m] = new
                code[m] -= r * model.cum[new]
                span[m] = r * model.places[new]
            at = np.flatnonzero(span < _TOP)
            if len(at):
                code[at] = (code[at] << _U32) | word(at)
                span[at] <<= _U32
            grid[k] = t
            if model.learn(t, p2 == t, p1 == t, slot, new):
                symbol = model.symbols()
    ids = np.ascontiguousarray(grid.T).ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise BlockError("the ids of a block do not match their checksum")
    return ids
