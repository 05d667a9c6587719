from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from scriptorium.llm import range_coder as rc  # noqa: E402
from scriptorium.llm import textkit as tk  # noqa: E402
from scriptorium.llm import token_counts, tokens  # noqa: E402

HARD = [
    "", " ", "\n", "don't 'tis it's  we've 'll!!'s x 's \n\n foo\n bar  \t baz ", "a<|endoftext|>b 's's", "Ünïcode 123 ½x İstanbul ΣΑΣ 中文 字 é  x",
    "'re're'x'", " ' s", "日本 語  テスト", "it''s", "\n's", "1's2", "'r 'v", "x" * 3000,
]


def texts() -> list[str]:
    rng = random.Random(3)
    return HARD + ["".join(rng.choice("ab s'tre vl\n\t 1!,É  ß中") for _ in range(rng.randint(0, 30))) for _ in range(1500)]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_are_the_librarys(name, kind):
    raw, offsets = tk.utf8(pa.array(texts()))
    got = []
    for _, _, ids, sizes, _ in tokens.encoder(str(P.path(name)), kind).rows(raw, offsets):
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [e.ids for e in tokens.library(str(P.path(name))).encode_batch(texts(), add_special_tokens=False)]


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(tk, "SLICE_BYTES", 256)
    text = " ".join(texts())
    raw, offsets = tk.utf8(pa.array([text.replace("<|endoftext|>", "")]))
    parts = list(tokens.encoder(str(P.path("byte_bpe_50k.json")), "byte").rows(raw, offsets))
    assert len(parts) > 10 and [p[4] for p in parts].count(True) == 1
    assert np.concatenate([p[2] for p in parts]).tolist() == tokens.library(str(P.path("byte_bpe_50k.json"))).encode(text.replace("<|endoftext|>", ""), add_special_tokens=False).ids


def test_counts_by_machines():
    raw, offsets = tk.utf8(pa.array(texts()))
    counter = token_counts.counter(str(P.path("byte_bpe_50k.json")))
    got = np.concatenate([sizes for _, _, _, sizes, _ in counter.rows(raw, offsets, want_ids=False)])
    assert got.tolist() == [len(e.ids) for e in tokens.library(str(P.path("byte_bpe_50k.json"))).encode_batch(texts(), add_special_tokens=False)]


def test_scan_equals_one_pass():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, token_counts._CLASSES, 5000).astype(np.uint8)
    symbols[0] += token_counts._CLASSES
    state, want = token_counts._FRESH, []
    for c in symbols:
        want.append(token_counts._LIMITS[c, state])
        state = token_counts._NEXT[c, state]
    assert token_counts.scan_limits(symbols, 64).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 20_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.minimum(rng.zipf(1.2, n), 49407), np.zeros(n, int)):
        block = rc.encode_block(ids.astype(np.uint32), 49408)
        assert rc.block_length(memoryview(block)) == len(block)
        assert rc.decode_block(block).tolist() == ids.tolist()


def test_damage_is_noticed():
    block = bytearray(rc.encode_block(np.arange(100, dtype=np.uint32), 200))
    block[-1] ^= 1
    with pytest.raises(rc.BlockError):
        rc.decode_block(bytes(block))
    with pytest.raises(ValueError):
        rc.encode_block(np.array([7], np.uint32), 7)


def test_likely_ids_take_fewer_bits():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 49408, 40)
    ids = np.tile(phrase, 500).astype(np.uint32)
    assert len(rc.encode_block(ids, 49408)) < 0.5 * 2 * len(ids)
