from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_uses_every_slot_once():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.find(k) for k in keys) == list(range(5000))
    assert all(h.find(f"other{i}".encode()) == -1 for i in range(1000))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_equals_library(library, text):
    own = bpe.loaded(PATH, PATTERN)
    assert array("I", library.encode_ordinary(text)).tobytes() == own.encode(text)
    assert own.decode(own.encode(text)) == text.encode()


MARKS = ["'s", "'re", "'x", "'", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "é", "Ω", "日", "1", "²", "٣", "!", "…", "😀", "s", "ve", "''", " '", "ll", "ＡＢ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(MARKS), max_size=12).map("".join), max_size=5))
def test_cuts_equal_the_pattern(texts):
    import regex

    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    want = [int(o) + len(t[: m.start()].encode()) for o, t in zip(offs, texts, strict=False) for m in regex.finditer(PATTERN, t)]
    assert bpe.cut_arrays(np.frombuffer(b"".join(raw), np.uint8), offs).tolist() == want


def test_other_pattern_and_shared_hashes(monkeypatch, library):
    other = r"\w+|\W+"
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    text = "some words, and: more don't\n 日本 " * 5
    assert bpe.ByteBPE(PATH, other).encode(text) == array("I", enc.encode_ordinary(text)).tobytes()
    own = bpe.loaded(PATH, PATTERN)
    monkeypatch.setattr(bpe, "_hashed", lambda k0, k1, size: (k0 % np.uint64(3)).astype(np.uint64))
    assert own.encode(text) == array("I", library.encode_ordinary(text)).tobytes()


def test_odd_texts(library):
    own = bpe.loaded(PATH, PATTERN)
    for t in ["", "<|endoftext|>", "a" * 3000, " " * 999, "日本語" * 300, "don't DON'T", "\x00﻿ é😀"]:
        assert array("I", library.encode_ordinary(t)).tobytes() == own.encode(t)


def test_long_text_in_stretches(monkeypatch, library):
    monkeypatch.setattr(bpe, "STRETCH", 7)
    own = bpe.loaded(PATH, PATTERN)
    assert len(own._stretches(np.frombuffer(b"some words and more 123 words\n" * 20, np.uint8))) > 20
    assert own.encode("some words and more 123 words\n" * 20) == array("I", library.encode_ordinary("some words and more 123 words\n" * 20)).tobytes()


def test_columns(docs, no_docs, texts, library):
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH, PATTERN, keep=["doc_id"]).collect()}
    for i, t, *_ in texts:
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    both = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert both.columns == ["doc_id", "text", "n_words", "lang", "ids", "n_tokens", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both.collect())
    assert bpe.encode(no_docs, PATH, PATTERN).count() == 0


def test_merged_cache_keeps_what_it_says(monkeypatch):
    # Few slots: pre-tokens take each other's places, and the ids held run over.
    monkeypatch.setattr(bpe, "CACHE_SLOTS", 8)
    monkeypatch.setattr(bpe, "CACHE_IDS", 64)
    own, enc = bpe.ByteBPE(PATH, PATTERN), bpe.loaded(PATH, PATTERN)
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("qxzvjkü"), rng.integers(2, 9))) for _ in range(5)) for _ in range(30)]
    for text in texts + texts:
        assert own.decode(own.encode(text)) == text.encode()
        assert own.encode(text) == array("I", [i for w in regex.findall(PATTERN, text) for i in whole(enc, w.encode())]).tobytes()
    assert (own.short.size > 0).any() and own.short.held <= 64


def whole(code: bpe.ByteBPE, raw: bytes) -> list[int]:
    """By definition: the leftmost pair of lowest rank, until none is a token."""
    if raw in code.ranks:
        return [code.ranks[raw]]
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while pairs := [(code.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in code.ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [code.ranks[x] for x in parts]


def test_encode_checked(spark):
    docs = spark.createDataFrame([(1, "some words  here"), (2, None), (3, ""), (4, "é" * 9)], "doc_id long, text string")
    want = {r.doc_id: (bytes(r.ids), r.n_tokens) for r in bpe.encode(docs, PATH, PATTERN).collect()}
    rows = bpe.encode_checked(docs, PATH, PATTERN, keep=["doc_id"])
    assert {r.doc_id: (bytes(r.ids), r.n_tokens) for r in rows.collect()} == want and rows.filter("lossless").count() == 4
    # One worker a task.
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
