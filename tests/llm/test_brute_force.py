"""Operators against plain Python over a small table with every odd case."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import decontaminate, neardup, quality, substrings, toxicity

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# ---------------------------------------------------------------- near-duplicates


def classes(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = SPACE.findall(lower(t or ""))
        sets[i] = frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2])
@pytest.mark.parametrize("lists", [(2, 2)])
def test_classes(docs, texts, monkeypatch, size, lists):
    # Short lists of two drive nearly everything through pivots and prefix filtering.
    monkeypatch.setattr(neardup, "SHORT", lists[0])
    monkeypatch.setattr(neardup, "MEDIUM", lists[1])
    want = classes([r[:2] for r in texts], size, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, size, 0.8).collect()}
    assert got == want


def test_own_text_in_a_large_group(spark):
    # All that a large group shares is frequent; the retained values that are not may all be a document's own text.
    base = [f"t{i}" for i in range(600)]
    rows = [(0, " ".join(base))]
    for i in range(1, 91):
        at = i * 6
        rows.append((i, " ".join([*base[:at], *(f"v{i}x{k}" for k in range(6)), *base[at + 6 :]])))
    common = next(neardup.shingle_sets(pa.array([rows[0][1]]), 2))
    seed = 0
    while len(rows) < 97:
        seed += 1
        text = f"{rows[0][1]} " + " ".join(f"o{seed}x{k}" for k in range(145))
        low = next(neardup.shingle_sets(pa.array([text]), 2))[: neardup.RETAINED]
        if (~np.isin(low, common)).sum() >= 12:
            rows.append((1000 + seed, text))
    want = classes(rows, 2, 80)
    assert {c for _, c in want.values()} == {0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 2, 0.8).collect()} == want


def test_star_of_a_document_and_its_extensions(spark):
    # 400 words and 1,500 texts that append 99 of their own: each links with the first at 0.801, none with another.
    base = " ".join(f"t{i}" for i in range(400))
    rows = [(0, base), *((i, f"{base} " + " ".join(f"o{i}x{k}" for k in range(99))) for i in range(1, 1501))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = neardup.near_duplicates(docs, 2, 0.8).collect()
    assert len(got) == 1501 and {r.component_id for r in got} == {0}


def test_large_group_with_members_apart(spark):
    # Copies of one text with own edits: some link with the centre, some only with others, some with none.
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(420):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(2, 11)), replace=False):
            w[at] = f"e{rng.integers(0, 400)}" if i % 3 else f"own{i}x{at}"
        rows.append((i, " ".join(w[: 120 - int(rng.integers(0, 6))])))
    for i in range(420, 440):  # near copies of members that may be far from the centre
        w = rows[i - 300][1].split(" ")
        w[5] = f"z{i}"
        rows.append((i, " ".join(w)))
    want = classes(rows, 2, 80)
    assert 5 < len({c for _, c in want.values()}) < 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 2, 0.8).collect()} == want


def test_dedup_keeps_one_row_a_class(spark, docs, texts, no_docs):
    want = classes([r[:2] for r in texts], 5, 80)
    twice = docs.union(docs.filter("doc_id = 19")).union(spark.createDataFrame([(None, "no id", "", "")], docs.schema))
    got = neardup.dedup(twice)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.filter("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert got.filter("doc_id is null").count() == 1
    assert neardup.near_duplicates(no_docs, 2).count() == 0


# ---------------------------------------------------------------- repeated windows


def removed(texts, window):
    words = {i: SPACE.findall(t or "") for i, t in texts}
    seen = collections.Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window", [8])
@pytest.mark.parametrize("hot", [1024, 1])
def test_repeated_windows(docs, texts, monkeypatch, window, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    found = substrings.remove_repeats(docs.drop("n_words"), window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found.collect()} == removed([r[:2] for r in texts], window)


def test_repeated_rows_lose_their_text(spark, docs, no_docs):
    text = " ".join(f"u{i}" for i in range(50))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text + " z"), (2, " ".join(f"v{i}" for i in range(50)))], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.remove_repeats(rows).collect()) == [0, 50, 50, 50]
    assert substrings.remove_repeats(no_docs.drop("n_words")).count() == 0


def test_buckets_count_windows_by_their_words():
    group = [(k, 1, " ".join(f"w{(i * i) % 5}" for i in range(k, k + 60))) for k in range(4)] + [(9, 1, " ".join(f"x{i}" for i in range(50)))]
    seen = collections.Counter(tuple(t.split(" ")[i : i + 6]) for *_, t in group for i in range(len(t.split(" ")) - 5))
    want = {k: [i for i in range(len(t.split(" ")) - 5) if seen[tuple(t.split(" ")[i : i + 6])] > 1] for k, _, t in group}
    assert {c: sorted(offsets) for c, offsets in substrings._in_bucket(group, 6)} == {k: v for k, v in want.items() if v}


def test_columns_of_any_name(spark):
    names = ["__r1", "__kept", "__text", "__own0", "te.xt", "kept", "turn", "c0", "doc_id2"]
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (None, "a b c d e f"), (3, None)]
    df = spark.createDataFrame([(*r, *"abcdefghi") for r in rows], "doc_id long, `bo.dy` string, " + ", ".join(f"`{n}` string" for n in names))
    kept = neardup.dedup(df, 2, 0.8, text="bo.dy")
    assert kept.columns == df.columns
    assert {r[1] for r in kept.collect()} == {"a b c d e f", "q r s t u v", None}  # no text is lost
    assert substrings.remove_repeats(df, 5, text="bo.dy").columns == [*df.columns, "n_words", "n_removed", "kept_text"]
    assert substrings.clean(df, 5, text="bo.dy").count() == 5
    toxic = toxicity.score(df, toxicity.fit(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"), text="bo.dy"), text="bo.dy")
    assert toxic.columns == [*df.columns, "score"] and toxic.count() == 5
    items = spark.createDataFrame([("i", "q r s t u v")], "item_id string, text string")
    assert decontaminate.find_spans(df, items, df.columns, text="bo.dy").filter("size(items) > 0").count() == 2


# ---------------------------------------------------------------- decontamination


def test_decontamination(spark, docs, texts, no_docs, monkeypatch):
    words = lambda t: ALNUM.findall(lower(t or ""))
    items = [(1, " ".join(words(texts[6][1])[20:45])), (2, "One"), (10, "Two, WORDS"), (3, None), (4, "!!"), (5, "not there at all"), (2, "One")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t, *_ in texts:
        w, hit, named = words(t), set(), []
        for name, item in items:
            x = words(item)
            n = min(10, len(x))
            at = [k for k in range(len(w) - n + 1) for j in range(len(x) - n + 1) if n and w[k : k + n] == x[j : j + n]]
            if at:
                named.append(str(name))
                hit.update(k + d for k in at for d in range(n))
        want[i] = (len(w), len(hit), sorted(named))
    for block in (2_000_000, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        found = decontaminate.find_spans(docs, bench, ["doc_id"])
        assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found.collect()} == want
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert all(len(words(clean[i])) == n - h for i, (n, h, _) in want.items())
    assert clean[texts[20][0]] is not None and decontaminate.decontaminate(docs, bench.limit(0)).exceptAll(docs).count() == 0
    assert decontaminate.find_spans(no_docs, bench, ["doc_id"]).count() == 0


def test_fm_index_counts_and_places():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 400)
    index = decontaminate.FMIndex(text, 5)
    for n in (1, 2, 3, 5):
        phrases = rng.integers(1, 5, (30, n))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [k for k in range(400 - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---------------------------------------------------------------- quality rules


def measures(t):
    t = t or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    at = collections.defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    again = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))


def test_quality_measures(docs, texts, no_docs):
    m = F.col(quality.HELD)
    rows = quality.judge(docs, carry=["doc_id"]).select("doc_id", m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, m.kept, m.probability).collect()
    assert {r[0]: tuple(r[1:7]) for r in rows} == {i: measures(t) for i, t, *_ in texts}
    assert not any(r[6] and r[7] for r in rows) and all(0 <= r[8] <= 1 for r in rows)
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.quality_filter(no_docs).count() == 0


def test_quality_verdicts(spark):
    plain = " ".join(f"word{i} text" for i in range(30))
    junk = " ".join(f"word{i}*** text%%%" for i in range(30))
    loud = " ".join(f"WORD{i}!! TEXT!!" for i in range(30))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([plain] * 20 + [junk] * 5 + [loud] * 5)], "doc_id long, text string")
    assert sorted(r.doc_id for r in quality.quality_filter(rows).collect()) == list(range(20))
    plan = quality.with_measures(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hashes_are_of_bytes():
    assert hashlib.sha256(b"").hexdigest() == decontaminate.digest_of_items([])


def test_clean_keeps_clashing_columns(docs, texts):
    got = substrings.clean(docs, 8)
    want = removed([r[:2] for r in texts], 8)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {i: want[i][2] if want[i][1] else t for i, t, *_ in texts}
