"""Token counts by finite-state tokenizer compilation.

Two deterministic machines give the counts of a byte-level BPE tokenizer.

*Pre-token machine.*  Thirteen states over classes of code points; transitions
are annotated with the piece limits that they settle (the pattern looks one
symbol ahead, so a limit may be settled one symbol late).  A text is cut into
chunks; each chunk's state map (where each state would end) is computed for all
chunks at once, maps are composed by a parallel prefix scan, and a last pass
runs each chunk from its then known state.

*Count transducer.*  Compiled on demand from the merge ranks: a state holds, for
every start from which a token may still be completed, the bytes since then, the
last token before it and its count relative to now; a transition on a byte is
annotated with the (signed) number of tokens that the prefix's encoding gains.
The last token of each prefix is the one token that ends there and is
compatible with the last token before it, so the sum of the annotations along a
piece is its number of tokens in the library's own encoding.

Counts of distinct pieces are kept in a table of bounded size.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm import textkit as tk
from scriptorium.llm import tokens
from scriptorium.llm.frames import map_arrow

#: Transitions that are kept; the compiled part is dropped beyond.
MOST_TRANSITIONS = 2_000_000

# classes of code points in the pre-token machine
_L, _A, _R, _V, _E, _LL, _N, _SP, _WS, _O, _AP = range(11)
_CLASSES = 11
# states
(_FRESH, _IN_L, _IN_N, _IN_O, _P1, _P2, _W1, _W2, _Q, _QR, _QV, _QL, _DONE) = range(13)
_STATES = 13


def _step(state: int, c: int) -> tuple[int, int]:
    """(next state, limits): 1 a piece starts at this symbol, 2 one starts at the symbol before."""
    letter = c <= _LL
    if (state, c) in ((_QR, _E), (_QV, _E), (_QL, _LL)) or (state == _Q and c == _A):
        return _DONE, 0
    if state in (_QR, _QV, _QL):  # no contraction: the letter began a word of its own
        nxt, limits = _step(_IN_L, c)
        return nxt, limits | 2
    if c in (_SP, _WS):
        if state in (_P1, _P2, _W1, _W2):
            return (_P2 if c == _SP else _W2), 0
        return (_P1 if c == _SP else _W1), 1
    if state == _Q and c in (_R, _V, _LL):
        return {_R: _QR, _V: _QV, _LL: _QL}[c], 0
    run = _IN_L if letter else _IN_N if c == _N else _IN_O
    if state == _Q and run == _IN_O:
        return _IN_O, 0
    if state in (_P1, _P2):  # a plain blank joins what follows
        return run, 2 if state == _P2 else 0
    if state == run:
        return run, 0
    limits = 3 if state == _W2 else 1
    return (_Q if c == _AP else run), limits


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and limits[class, state]; classes from _CLASSES on are those of a row's first symbol, the last one ends the input."""
    nxt = np.zeros((2 * _CLASSES + 1, _STATES), np.uint8)
    lim = np.zeros_like(nxt)
    for s in range(_STATES):
        open_ = 2 if s in (_QR, _QV, _QL) else 0
        for c in range(_CLASSES):
            nxt[c, s], lim[c, s] = _step(s, c)
            nxt[_CLASSES + c, s], lim[_CLASSES + c, s] = _step(_FRESH, c)
            lim[_CLASSES + c, s] |= open_
        nxt[-1, s], lim[-1, s] = _FRESH, open_
    return nxt, lim


_NEXT, _LIMITS = _machine()
_class_table: list[np.ndarray] = []


def _symbol_classes() -> np.ndarray:
    if not _class_table:
        kind = tokens.classes()
        t = np.select([kind == tokens._LETTER, kind == tokens._NUMBER, kind == tokens._SPACE], [_L, _N, _WS], _O).astype(np.uint8)
        t[32], t[39] = _SP, _AP
        for c, k in zip("stmdrvel", (_A, _A, _A, _A, _R, _V, _E, _LL), strict=True):
            t[ord(c)] = k
        _class_table.append(t)
    return _class_table[0]


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps [chunk, state] under composition, by doubling."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
        step *= 2
    return maps


def scan_limits(symbols: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Limits settled at each symbol, by chunk state maps and a prefix scan."""
    n = len(symbols)
    chunks = max(1, -(-n // chunk))
    grid = np.full(chunks * chunk, 2 * _CLASSES, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(chunks, chunk).T)
    base = grid.astype(np.int16) * _STATES
    flat, flat_limits = _NEXT.ravel(), _LIMITS.ravel()
    state = np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], chunks, 1)
    for k in range(chunk):
        state = flat[base[k] + state]
    ends = compose_scan(np.ascontiguousarray(state.T))[:, _FRESH]
    now = np.concatenate([[_FRESH], ends[:-1]]).astype(np.uint8)
    out = np.empty((chunk, chunks), np.uint8)
    for k in range(chunk):
        at = base[k] + now
        out[k] = flat_limits[at]
        now = flat[at]
    return out.T.ravel()[:n]


def split_scan(cp: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces [start, end) of rows of code points; last: the code points that end a row."""
    n = len(cp)
    symbols = np.empty(n + 1, np.uint8)
    symbols[:n] = _symbol_classes()[cp]
    symbols[0] += _CLASSES
    symbols[last[last < n - 1] + 1] += _CLASSES
    symbols[n] = 2 * _CLASSES
    limits = scan_limits(symbols)
    head = (limits[:n] & 1).astype(bool)
    head |= (limits[1:] & 2).astype(bool)
    start = np.flatnonzero(head)
    return start, np.append(start[1:], n)


class CountTransducer:
    """Bytes of a piece to its number of tokens; states and transitions are compiled as they are met."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.encode = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, int] = {}
        self.pairs.clear()
        self._state(((b"", None, 0),))

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def compatible(self, before: int | None, token: int) -> bool:
        key = (before, token)
        if key not in self.pairs:
            data = self.bytes[token] if before is None else self.bytes[before] + self.bytes[token]
            got = [self.ranks[data]] if data in self.ranks else self.encode(data)
            self.pairs[key] = got == ([token] if before is None else [before, token])
        return self.pairs[key]

    def compile(self, state: int, byte: int) -> int:
        """The transition of a state on a byte, as next state * 1024 + annotation + 512."""
        b = bytes([byte])
        open_, found = [], None
        for seen, before, count in self.states[state]:  # the longest first
            grown = seen + b
            if found is None and grown in self.ranks and self.compatible(before, self.ranks[grown]):
                found = (self.ranks[grown], count + 1)
            if grown in self.prefixes:
                open_.append((grown, before, count))
        token, gain = found
        key = tuple((s, t, c - gain) for s, t, c in open_) + ((b"", token, 0),)
        if len(self.moves) >= MOST_TRANSITIONS:
            self.reset()
            return self._state(key) * 1024 + gain + 512
        move = self._state(key) * 1024 + gain + 512
        self.moves[state * 256 + byte] = move
        return move

    def count(self, piece: bytes) -> int:
        state, total, moves = 0, 0, self.moves
        for b in piece:
            move = moves.get(state * 256 + b)
            if move is None:
                move = self.compile(state, b)
            state = move >> 10
            total += (move & 1023) - 512
        return total


class CountEncoder(tokens.PieceEncoder):
    """Counts of rows: pieces by the pre-token machine, counts by the transducer."""

    def __init__(self, path: str):
        tok = tokens.library(path)
        self.transducer = CountTransducer(tokens.byte_ranks(path))
        specials = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        super().__init__(split_scan, None, tokens._plain_all, lambda text: tok.encode(text, add_special_tokens=False).ids, specials)

    def _learn(self, keys: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        keys, first = np.unique(keys, return_index=True)
        data, count = raw.tobytes(), self.transducer.count
        gc.disable()  # nothing here is cyclic, and the states are many small tuples
        try:
            new = [count(data[s:e]) for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        finally:
            gc.enable()
        while self.n + len(new) > len(self.len):
            self.len = np.concatenate([self.len, np.zeros_like(self.len)])
        rows = np.arange(self.n, self.n + len(new))
        self.len[rows] = new
        self.table.add(keys, rows.astype(np.int32))
        self.n += len(new)


_counters: dict[str, CountEncoder] = {}


def counter(path: str) -> CountEncoder:
    if path not in _counters:
        _counters[path] = CountEncoder(path)
    return _counters[path]


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row.

    vocabulary: path of a byte-level BPE file of the tokenizers library, there
    on each machine.  Null and empty texts have no tokens; a null key stays
    null; repeated rows are counted each; texts of any length are read whole, in
    slices; other columns of df, whatever their names, play no part.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        raw, offsets = tk.utf8(batch.column(1))
        n = np.zeros(batch.num_rows, np.int64)
        for a, b, _, sizes, _ in counter(vocabulary).rows(raw, offsets, want_ids=False):
            n[a:b] += sizes
        yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["key", "n_bytes", "n_tokens", "over_limit"])

    out = map_arrow(df.select(df[key].alias("key"), df[text].cast("string").alias("text")), run, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("key", key)
