import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from llm.helpers import edge_docs, empty_docs
from pelorus.llm import packing

VOCABULARY = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_encoder_equals_the_tokenizer(tokenizer):
    encode, rng = packing.WordEncoder(VOCABULARY), random.Random(4)
    pool = [chr(c) for c in list(range(0x250)) + [0x307, 0x301, 0x17F, 0x212A, 0x3A3, 0x4E2D, 0x1F600, 0x2019, 0x2003]] + ["<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("abc 'STsdlv12!?\n") for _ in range(rng.randint(0, 40)))
        assert encode(text) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def naive(lengths, window):
    room, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            k = min(fits)
            room.remove(k)
        else:
            k = window
            out.append(1)
        room.append(k - lengths[i])
    return len(out), sorted(room)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, rng.integers(0, 300))
    places, offsets = packing.best_fit_decreasing(lengths, 64)
    n, room = naive(lengths.tolist(), 64)
    assert (places.max() + 1 if len(places) else 0) == n
    for p in range(n):
        at = np.argsort(offsets[places == p])
        assert (np.cumsum(lengths[places == p][at])[:-1] == offsets[places == p][at][1:]).all()
    used = np.bincount(places, weights=lengths, minlength=n) if n else []
    assert sorted(64 - np.asarray(used)) == room


@pytest.mark.parametrize("shard_docs", [20_000, 3])
def test_every_id_lies_in_one_piece(spark, tokenizer, shard_docs):
    docs = edge_docs(spark)
    rows = packing.pack(docs, VOCABULARY, window=256, shard_docs=shard_docs).collect()
    want = {}
    for d in docs.collect():
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        want.setdefault(d["doc_id"], []).append(ids)
    for doc_id, copies in want.items():
        own = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc_id)
        ids = copies[0]
        cut = [(s, min(256, len(ids) - s), zlib.crc32(np.asarray(ids[s : s + 256], dtype="<u4").tobytes()), len(ids)) for s in range(0, len(ids), 256)]
        assert own == sorted(cut * len(copies))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256


def test_empty_table(spark):
    assert packing.pack(empty_docs(spark), VOCABULARY).count() == 0
