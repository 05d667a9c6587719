"""Exact token ids of public tokenizers, at the speed of array operations.

A text is cut into the tokenizer's pre-tokens with array operations on its code
points; each distinct pre-token is encoded once by the library's own BPE model
and remembered in a bounded table; ids of a text are then gathered.  Texts with
anything outside the verified classes (special strings, code points whose lower
case or normal form is not a single one) go to the library as they are.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from scriptorium.llm import textkit as tk

#: Pre-tokens that are remembered; the table is emptied beyond.
MOST_PIECES = 1_200_000

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
# Unicode's White_Space characters
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point."""
    if not _classes:
        table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        for cp in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(cp))[0]
            if kind in "LN":
                table[cp] = _LETTER if kind == "L" else _NUMBER
        table[_WHITE] = _SPACE
        _classes.append(table)
    return _classes[0]


def _contractions(cp: np.ndarray, kind: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(apostrophes that start 's 't 'm 'd 're 've 'll, lengths); free: where a token can start."""
    at = np.flatnonzero((cp == 39) & free)
    if not len(at):
        return at, at
    pad = np.concatenate([cp, [0, 0]])
    one, two = pad[at + 1], pad[at + 2]
    pairs = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(pairs, 3, 0))
    keep = size > 0
    return at[keep], size[keep]


def split_gpt(cp: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens [start, end) of the byte-level pattern; last: the code points that end a row."""
    n = len(cp)
    kind = classes()[cp]
    head = np.zeros(n + 1, bool)  # a row starts here
    head[0] = True
    head[last + 1] = True
    cut = head.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # the last blank before a word leaves its run; a plain one joins the word
    before = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n]) if n else np.zeros(0, np.int64)
    cut[before] = True
    joined = before[cp[before] == 32]
    cut[joined + 1] = False
    free = cut[:n].copy()
    at, size = _contractions(cp, kind, free)
    if len(at):
        row_end = last[np.searchsorted(last, at)] + 1
        ok = at + size <= row_end
        at, size = at[ok], size[ok]
        cut[at + 1] = False
        cut[at + size] = True
    start = np.flatnonzero(cut[:n])
    return start, np.append(start[1:], n)


def split_word(cp: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of the lower-case word pattern: letters, single numbers, other runs; blanks go."""
    n = len(cp)
    kind = classes()[cp]
    cut = np.zeros(n + 1, bool)
    cut[0] = True
    cut[last + 1] = True
    cut[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    at, size = _contractions(cp, kind, cut[:n].copy())
    if len(at):
        row_end = last[np.searchsorted(last, at)] + 1
        ok = at + size <= row_end
        at, size = at[ok], size[ok]
        cut[at + 1] = False
        cut[at + size] = True
    start = np.flatnonzero(cut[:n])
    end = np.append(start[1:], n)
    keep = kind[start] != _SPACE
    return start[keep], end[keep]


_BYTE_CHARS = {}


def byte_chars() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    if not _BYTE_CHARS:
        plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160)]
        _BYTE_CHARS.update({b: chr(b) for b in plain})
        _BYTE_CHARS.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)})
    return _BYTE_CHARS


class PieceEncoder:
    """Encodes rows of UTF-8 to ids.

    encode_piece: pre-token's bytes to ids; plain: whether a row's code points
    allow the fast path; whole: a text to ids, for the other rows; lower: code
    points are replaced by lower case ones first.
    """

    def __init__(self, split: Callable, encode_piece: Callable[[bytes], list[int]], plain: Callable, whole: Callable[[str], list[int]], specials: list[bytes], lower: bool = False):
        self.split, self.encode_piece, self.plain, self.whole, self.specials, self.lower = split, encode_piece, plain, whole, specials, lower
        self.reset()

    def reset(self) -> None:
        self.table = tk.HashTable(18)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.at = np.zeros(1 << 16, np.int64)
        self.len = np.zeros(1 << 16, np.int32)
        self.n = 0

    def _learn(self, keys: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        keys, first = np.unique(keys, return_index=True)
        data = raw.tobytes()
        new = [self.encode_piece(data[s:e]) for s, e in zip(start[first].tolist(), end[first].tolist())]
        sizes = np.fromiter(map(len, new), np.int32, len(new))
        flat = np.fromiter((x for y in new for x in y), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(new) > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
        rows = np.arange(self.n, self.n + len(new))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[rows] = self.used + np.cumsum(sizes) - sizes
        self.len[rows] = sizes
        self.table.add(keys, rows.astype(np.int32))
        self.n += len(new)
        self.used += len(flat)

    def _fast(self, raw: np.ndarray, offsets: np.ndarray, cp: np.ndarray, pos: np.ndarray, want_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids, ids per row) of a slice."""
        n_rows = len(offsets) - 1
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        row_last = np.searchsorted(pos, offsets[1:], "left") - 1
        last = np.unique(row_last[row_last >= 0])
        start, end = self.split(cp, last)
        keys = tk.segment_hash(tk.prefix_hash(cp), start, end)
        edge = np.append(pos, len(raw))
        rows = self.table.find(keys)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            if self.n + len(missing) > MOST_PIECES:
                self.reset()
                missing = np.arange(len(keys))
            self._learn(keys[missing], raw, edge[start[missing]], edge[end[missing]])
            rows = self.table.find(keys)
        sizes = self.len[rows].astype(np.int64)
        ids = self.ids[tk.ranges(self.at[rows], sizes)] if want_ids else None
        total = np.concatenate([[0], np.cumsum(sizes)])
        upto = total[np.searchsorted(start, np.searchsorted(pos, offsets, "left"), "left")]
        return ids, np.diff(upto)

    def _safe_cut(self, raw: np.ndarray, lo: int, hi: int) -> int:
        """The first place from lo on where a blank follows a visible ASCII character: pre-tokens end there."""
        step = 1 << 16
        while lo < hi - 1:
            x = raw[lo : min(lo + step, hi)]
            at = np.flatnonzero((x[1:] == 32) & (x[:-1] > 32) & (x[:-1] < 127)) if len(x) > 1 else ()
            if len(at):
                return lo + int(at[0]) + 1
            lo += max(len(x) - 1, 1)
        return hi

    def rows(self, raw: np.ndarray, offsets: np.ndarray, want_ids: bool = True) -> Iterator[tuple[int, int, np.ndarray | None, np.ndarray, bool]]:
        """(first row, next row, ids, ids per row, whether the rows end here), in order of the rows.

        A row longer than a slice comes in several parts, each as rows (a, a + 1).
        """
        with np.errstate(over="ignore"):
            for a, b in tk.row_slices(offsets):
                lo, hi = int(offsets[a]), int(offsets[b])
                if hi - lo > 2 * tk.SLICE_BYTES and not self._special(raw[lo:hi]):
                    while lo < hi:
                        cut = self._safe_cut(raw, lo + tk.SLICE_BYTES, hi) if hi - lo > tk.SLICE_BYTES else hi
                        yield a, b, *self._slice(raw[lo:cut], np.array([0, cut - lo]), want_ids), cut == hi
                        lo = cut
                else:
                    yield a, b, *self._slice(raw[lo:hi], offsets[a : b + 1] - lo, want_ids), True

    def rows_ended(self, raw: np.ndarray, offsets: np.ndarray, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
        """As rows(), with an end id after each row."""
        for a, b, ids, sizes, done in self.rows(raw, offsets):
            if done:
                ids = np.insert(ids, np.cumsum(sizes), end)
                sizes = sizes + 1
            yield a, b, ids.astype(np.uint32, copy=False), sizes, done

    def _special(self, raw: np.ndarray) -> bool:
        data = raw.tobytes()
        return any(s in data for s in self.specials)

    def _slice(self, raw: np.ndarray, offsets: np.ndarray, want_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        cp, pos = tk.code_points(raw)
        odd = ~self.plain(cp)
        if not odd.any() and not self._special(raw):
            if self.lower:
                cp, raw = self._lowered(cp, raw)
            return self._fast(raw, offsets, cp, pos, want_ids)
        # row by row: the odd ones go to the library
        data, ids, sizes = raw.tobytes(), [], []
        odd_rows = set((np.searchsorted(offsets, pos[np.flatnonzero(odd)], "right") - 1).tolist())
        for k in range(len(offsets) - 1):
            s, e = int(offsets[k]), int(offsets[k + 1])
            if k in odd_rows or any(x in data[s:e] for x in self.specials):
                got = np.array(self.whole(data[s:e].decode()), np.uint32)
            else:
                r = raw[s:e]
                c, p = tk.code_points(r)
                if self.lower:
                    c, r = self._lowered(c, r)
                got, n = self._fast(r, np.array([0, e - s]), c, p, want_ids)
                if got is None:
                    sizes.append(int(n[0]))
                    continue
            ids.append(got)
            sizes.append(len(got))
        return (np.concatenate([np.zeros(0, np.uint32), *ids]) if want_ids else None), np.array(sizes, np.int64)

    def _lowered(self, cp: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower case of code points under U+0250, which keep their number of bytes there."""
        low = lower_table()[cp]
        if np.array_equal(low, cp):
            return cp, raw
        raw = raw.copy()
        pos = np.flatnonzero((raw & 0xC0) != 0x80)
        at = np.flatnonzero(low != cp)
        one, two = at[low[at] < 128], at[low[at] >= 128]
        raw[pos[one]] = low[one]
        raw[pos[two]] = 0xC0 | (low[two] >> 6)
        raw[pos[two] + 1] = 0x80 | (low[two] & 0x3F)
        return low, raw


_lower: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    if not _lower:
        x = np.arange(0x250, dtype=np.uint32)
        for cp in range(0x250):
            y = chr(cp).lower()
            if len(y) == 1 and ord(y) < 0x250 and len(y.encode()) == len(chr(cp).encode()):
                x[cp] = ord(y)
        _lower.append(x)
    return _lower[0]


_PLAIN_WORD = np.array([len(y := chr(x).lower()) == 1 and ord(y) < 0x250 and len(y.encode()) == len(chr(x).encode()) for x in range(0x250)] + [False])


def _plain_word(cp: np.ndarray) -> np.ndarray:
    """Under U+0250, in normal form C as they are, with a lower case of as many bytes."""
    return _PLAIN_WORD[np.minimum(cp, 0x250)]


def _plain_all(cp: np.ndarray) -> np.ndarray:
    return np.ones(len(cp), bool)


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a byte-level vocabulary whose merges stand in order of their ids."""
    import json

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    back = {c: b for b, c in byte_chars().items()}
    special = {x["content"] for x in told["added_tokens"]}
    ranks = {bytes(back[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    ids = [told["model"]["vocab"]["".join(m)] for m in merges]
    if ids != sorted(ids) or told["model"].get("end_of_word_suffix"):
        raise ValueError(f"{path}: merges are not in order of their ids")
    return ranks


def encoder(path: str, kind: str) -> PieceEncoder:
    """The encoder of a vocabulary file, one for each Python worker; kind: "byte" or "word"."""
    if (path, kind) in _encoders:
        return _encoders[path, kind]
    tok = library(path)
    specials = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
    whole = lambda text: tok.encode(text, add_special_tokens=False).ids
    if kind == "byte":
        import tiktoken

        ranks = byte_ranks(path)
        core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        piece = lambda data: [ranks[data]] if data in ranks else core.encode_single_piece(data)
        made = PieceEncoder(split_gpt, piece, _plain_all, whole, specials)
    else:
        chars, model = byte_chars(), tok.model
        piece = lambda data: [t.id for t in model.tokenize("".join(map(chars.__getitem__, data)))]
        made = PieceEncoder(split_word, piece, _plain_word, whole, specials, lower=True)
    _encoders[path, kind] = made
    return made
