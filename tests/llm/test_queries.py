"""Registered queries and pipeline stages on the smallest tables, against plain Python over all rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from lexigrove.llm import QUERIES
from lexigrove.llm.common import staged, table
from tiktoken.load import load_tiktoken_bpe

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}


@pytest.fixture(scope="module")
def encoder():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(path)), special_tokens={})


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def shingles(text: str, size: int) -> frozenset:
    w = SPACED.findall(text.translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def classes(texts: dict[int, str], size: int) -> dict[int, int]:
    sets, of = {i: shingles(t, size) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((of[a], of[b]))
            of = {i: low if r == high else r for i, r in of.items()}
    return of


def kept_words(texts: dict[int, str]) -> dict[int, tuple[list[str], list[str]]]:
    """Words, and those not covered by a 35-word window that starts more than once."""
    words = {i: SPACED.findall(t) for i, t in texts.items()}
    starts = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 34) if starts[tuple(w[k : k + 35])] > 1 for j in range(35)}
        out[i] = w, [x for k, x in enumerate(w) if k not in gone]
    return out


def hits(texts: dict[int, str], items: dict) -> dict[int, tuple[int, int, list[str]]]:
    """Words, hit words and items found."""
    windows, sizes = defaultdict(set), set()
    for item, t in items.items():
        w = LETTERS.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        sizes |= {n} - {0}
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    out = {}
    for i, t in texts.items():
        w, hit, found = LETTERS.findall(t.translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (at := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[at]
        out[i] = len(w), len(hit), sorted(found)
    return out


def test_op1(spark, sf_dir, texts, encoder):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_byte_bpe"](spark, sf_dir).collect()}
    want = {}
    for i, t in texts.items():
        ids = encoder.encode_ordinary(t)
        want[i] = len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())
    assert got == want


def test_op2(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op2_minhash_neardup"](spark, sf_dir).collect()}
    assert got == {i: (len(shingles(texts[i], 2)), c, c == i) for i, c in classes(texts, 2).items()}


def test_op3(spark, sf_dir, texts):
    items = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op3_decontamination"](spark, sf_dir).collect()}
    assert got == {i: (n, h, len(f), sha(",".join(f).encode()), h > 0) for i, (n, h, f) in hits(texts, items).items()}


def test_op4(spark, sf_dir):
    body = {r.page_id: (r.html or "").encode() for r in table(spark, sf_dir, "pages").collect()}
    last = {b: i for i, b in sorted(body.items())}
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in QUERIES["op4_warc"](spark, sf_dir).collect()}
    assert got == {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if last[b] == i else ("revisit", last[b]))) for i, b in body.items()}


def test_op5(spark, sf_dir, encoder):
    want = defaultdict(lambda: [0, 0])
    for r in table(spark, sf_dir, "documents").collect():
        if r.text:
            for version, n in (("words", len(SPACED.findall(r.text))), ("byte_bpe_50k", len(encoder.encode_ordinary(r.text)))):
                want[r.source, r.lang, version][0] += 1
                want[r.source, r.lang, version][1] += n
    got = {(r.source, r.lang, r.tokenizer_version): [r.docs, r.tokens] for r in QUERIES["op5_token_counts"](spark, sf_dir).collect()}
    assert got == dict(want)


def test_op6(spark, sf_dir, texts):
    rows = QUERIES["op6_toxicity"](spark, sf_dir).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_op7(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_substring_dedup"](spark, sf_dir).collect()}
    assert got == {i: (len(w), len(w) - len(k), sha(" ".join(k).encode())) for i, (w, k) in kept_words(texts).items()}


def test_op9(spark, sf_dir, texts):
    for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect():
        t = texts[r.doc_id]
        w = SPACED.findall(t)
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        often = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = len({k + j for k in range(len(w) - 4) if often[tuple(w[k : k + 5])] > 1 for j in range(5)})
        failed = len(w) < 10 or 100 * repeated > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert (r.n_repeat_words, r.base_failed) == (repeated, failed) and not (failed and r.kept)


def test_every_stage_of_the_pipeline(spark, sf_dir, texts, encoder):
    """Each stage on what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    verdict = {r.doc_id: r.kept for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect()}
    items = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    held = texts
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            got = {r.doc_id: r.text or "" for r in rows}
            assert len(got) == len(rows)
        if name == "quality_rules":
            assert got == {i: t for i, t in held.items() if verdict[i]}
        elif name == "near_duplicates":
            assert got == {i: held[i] for i, c in classes(held, 5).items() if c == i}
        elif name == "substring_dedup":
            assert {i: SPACED.findall(t) for i, t in got.items()} == {i: kept for i, (_, kept) in kept_words(held).items()}
        elif name == "benchmark_decontamination":
            found = hits(held, items)
            assert {i: got[i] for i in got if not found[i][1]} == {i: held[i] for i in held if not found[i][1]}
            assert all(len(LETTERS.findall(got[i])) <= n - h for i, (n, h, _) in found.items())
        else:
            assert {r.doc_id: (r.n_tokens, bytes(r.ids), r.lossless) for r in rows} == {i: (len(x), np.array(x, "<u4").tobytes(), True) for i, x in ((i, encoder.encode_ordinary(t)) for i, t in held.items())}
        held = got
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "benchmark_decontamination", "byte_bpe"]
