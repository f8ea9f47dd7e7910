from __future__ import annotations

import base64
import hashlib
import json
from collections import Counter

import numpy as np
import pytest

from lexigrove.llm import pages, rollup, shards, toxicity, warc
from lexigrove.llm.common import scratch_path, staged
from pyspark.sql import functions as F


# ---------------------------------------------------------------- WARC


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK_ROWS", 3)
    rows = [(i, f"http://h{i % 3}.example.com/p{i % 4}?é={i % 2}", h) for i, h in enumerate(["a", "bbbbbb", None, "", "a", "bbbbbb", "c" * 100_000, "é<p>\r\n\r\n", "a", "bbbbbb"])]
    rows += [(99, None, "null url"), (None, "http://x/", "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    root = warc.write(df, least_bytes=least)
    got = warc.read_all(spark, root).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", -1))
    for r in got:
        if r.page_id is None:
            continue
        body = ({i: h for i, _, h in rows}[r.page_id]) or ""
        other = len(body.encode()) >= least and top[body] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(body.encode()), base64.b32encode(hashlib.sha1(body.encode()).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", top[body]) if other else ("response", None))
    archive = warc.Archive(spark, root)
    for i, u, _ in rows:
        if u:
            assert i in [r["page_id"] for r in archive.lookup(u)]
    assert archive.lookup("http://nowhere/") == []


@pytest.mark.parametrize("least", [0, 5])
def test_warc_repeated_and_null_ids(spark, least):
    rows = [(1, "same")] * 3 + [(None, "same"), (0, "same"), (None, "no ids")] + [(None, "no ids")] * 2 + [(7, "x"), (7, "y"), (7, "yyyyy"), (7, "yyyyy"), (8, "y")]
    df = spark.createDataFrame([(i, "http://h/", h, "clash") for i, h in rows], "page_id long, url string, html string, digest string").repartition(4)
    got = warc.read_all(spark, warc.write(df, least_bytes=least)).collect()
    want = []
    for h in {h for _, h in rows}:
        ids = sorted((i for i, x in rows if x == h), key=lambda i: -1 if i is None else i)
        if len(h) < least:
            want += [(i, len(h), "response", None) for i in ids]
        else:
            want += [(ids[-1], len(h), "response", None)] + [(i, len(h), "revisit", ids[-1]) for i in ids[:-1]]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in got)


def test_warc_of_nothing(spark):
    root = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_all(spark, root).count() == 0


def test_surt():
    assert warc.surt("https://user@www.A.com:80/Path?q#f") == "com,a)/path?q" and warc.surt("http://b.a.com") == "com,a,b)/"


# ---------------------------------------------------------------- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use</div>
<article><h1>A &amp; B</h1><p><b>First&nbsp; par
agraph<br><p>Second <i>one</i>.</p><div class="ad">Buy</div><section class="comments"><p>nice</p></section><form>x</form><ul><li>i<li>ii</ul></article>
<aside>side</aside><footer>&copy; f</footer></body></html>"""


def test_article(spark):
    rows = spark.createDataFrame([(1, "http://a/", PAGE), (2, "http://a/2", None), (3, None, ""), (1, "http://a/", PAGE), (None, "http://a/9", "<article>x")], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in pages.main_text(rows).collect())
    text = "A & B\n\nFirst par agraph\n\nSecond one.\n\ni\n\nii"
    assert got == [(0, "x", 1), (1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0)]


def test_characters_whose_lower_case_is_longer():
    page = "<p>" + "İ" * 40 + "</p><SCRIPT>x</Script><p>one</p><p>two</p>"
    assert [t for _, t in pages.blocks_of(page)] == ["İ" * 40, "one", "two"]


def test_boilerplate_of_pages_without_article(spark):
    frame = "<div>{}</div><div>all rights reserved by the owners of this very site</div>"
    rows = [(i, f"http://h/{i}", frame.format(f"own words of page number {i}")) for i in range(4)] + [(9, "http://other/", frame.format("single"))]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "own words of page number 2"
    assert got[9].startswith("single\n\nall rights")


def test_shards_of_a_host_share_runs(spark, monkeypatch):
    # Each footer is on two pages, which mostly fall into different shards.
    rows = [(i, "http://h/", f"<div>own words of page {i}</div><div>footer {i // 2} a b c d e f g h {i // 2}</div>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(pages, "SHARD_TOKENS", 100)
    assert {r.page_id: r.text for r in pages.main_text(df).collect()} == {i: f"own words of page {i}" for i in range(60)}


NOTICE = "sign up for the weekly letter and read what others missed"


def _page(i: int, *blocks: str) -> tuple[int, str, str]:
    return i, f"http://h/{i}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"


@pytest.mark.parametrize("tokens", [1_000_000, 150])
def test_notice_inside_articles(spark, monkeypatch, tokens):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    quote = "two of these articles quote the same ten words here"
    rows = [_page(i, own(i), NOTICE if i % 3 else f"{own(-i - 1)} {NOTICE}", *([quote] if i in (3, 4) else []), f"end {i}") for i in range(20)]
    # The first page once more, and a host whose articles are versions of one text.
    rows += rows[:1] + [(100 + i, f"http://v/{i}", _page(0, f"version {i}", own(7), own(8))[2]) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(pages, "SHARD_TOKENS", tokens)
    got = sorted((r.page_id, r.text) for r in pages.main_text(df).collect())
    want = [(i, "\n\n".join([own(i), *([] if i % 3 else [own(-i - 1)]), *([quote] if i in (3, 4) else []), f"end {i}"])) for i in [0, *range(20)]]
    assert got == want + [(100 + i, f"version {i}\n\n{own(7)}\n\n{own(8)}") for i in range(8)]


def test_spread_runs_equal_brute_force():
    rng = np.random.default_rng(8)
    streams = [rng.integers(1, 4, n).astype(np.uint64) for n in (40, 0, 3, 60, 25, 5)]
    holders = Counter(int(f) for s in streams for f in np.unique(pages.fingerprints(s, 5)))
    for least in (1, 2, 3, 4):
        assert sorted(pages.spread_runs(streams, least, 5).tolist()) == sorted(f for f, n in holders.items() if n >= least)


def test_shared_tokens_equal_brute_force():
    rng = np.random.default_rng(2)
    streams = [rng.integers(1, 4, rng.integers(0, 60)).astype(np.uint64) for _ in range(6)]
    runs = [{tuple(s[k : k + 5].tolist()) for k in range(len(s) - 4)} for s in streams]
    for i, (s, got) in enumerate(zip(streams, pages.shared_tokens(streams, 5), strict=True)):
        want = np.zeros(len(s), bool)
        for k in range(len(s) - 4):
            if any(tuple(s[k : k + 5].tolist()) in r for j, r in enumerate(runs) if j != i):
                want[k : k + 5] = True
        assert (got == want).all()


# ---------------------------------------------------------------- rollups


def test_rollup(spark):
    book = rollup.TokenRollup(spark)
    rows = spark.createDataFrame([("s", "en", 5), ("s", "en", 7), (None, "de", None)], "source string, lang string, n long")
    add = rollup.changes(rows, F.lit("insert"), F.lit("v1"), F.col("n"))
    assert book.commit("a", add) and not book.commit("a", add)
    assert book.commit("b", rollup.changes(rows.filter("n = 5"), F.lit("revise"), F.lit("v1"), F.lit(9), F.col("n")))
    assert book.commit("c", rollup.changes(rows.filter("n is null"), F.lit("delete"), F.lit("v1"), F.col("n")))
    want = [("s", "en", "v1", 2, 16)]
    assert [tuple(r) for r in book.totals().collect()] == want
    book.compact()
    assert [tuple(r) for r in book.totals().collect()] == want
    assert not book.commit("b", add) and book.committed() == {"a", "b", "c"}
    book.commit("d", add.limit(0))
    assert [tuple(r) for r in book.totals().collect()] == want
    with pytest.raises(Exception, match="unknown kind"):
        book.commit("e", rollup.changes(rows, F.lit("other"), F.lit("v1"), F.col("n")))
    assert "e" not in book.committed()


# ---------------------------------------------------------------- shards


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_feistel_is_a_permutation(n):
    f = shards.Feistel(n, 5)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (f.number(slots) == np.arange(n)).all()


def test_shards(spark, texts):
    bodies = [t.encode() for _, t, *_ in texts if t is not None]
    df = staged(spark.createDataFrame([(b,) for b in [*bodies, None]], "ids binary").repartition(4), "ids")
    root, rows = shards.write(df, "ids", 1, 255, length=64, shard_bytes=64 * 10)
    got = sorted(rows.collect())
    assert [r.slot for r in got] == list(range(len(got)))
    sequences = list(shards.read(root))
    order = shards.Feistel(len(got), 17)
    stream = b"".join(sequences[int(s)].tobytes() for s in order.slot(np.arange(len(got))))
    assert sorted(x for x in stream.split(b"\xff") if x) == sorted(b for b in bodies if b)
    assert [s.tobytes() for s in shards.read(root, 13, 5)] == [s.tobytes() for s in sequences[13:18]]
    again, _ = shards.write(df, "ids", 1, 255, length=64, shard_bytes=640)[1], None
    assert sorted(again.collect()) == got
    assert shards.write(df.limit(0), "ids", 1, 255)[1].count() == 0


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark, no_docs):
    rows = [(i, f"some ordinary words {i} here and {'grumbolt' + str(i % 4) if i % 5 == 0 else 'nothing'} there {i * 7}") for i in range(600)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i, _ in rows) and got[1000] == got[1001] < 0.5
    assert toxicity.score(no_docs, model).count() == 0
    bare = toxicity.score(docs, toxicity.fit(docs, labels.limit(0)), ["doc_id"])
    assert {r.score for r in bare.collect()} == {0.0}


def test_toxicity_of_few_rows_and_conflicting_labels(spark):
    rows = [(i, f"plain words number {i} of {'a grumbolt' if i % 10 == 0 else 'some'} text {i * 31}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 10 == 0)) for i, _ in rows]
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (10, 0), (20, 0)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)
    back = toxicity.fit(docs, spark.createDataFrame([(10, 0), (20, 0), *labels], "doc_id long, toxic int").repartition(3))
    assert (model.voters == back.voters).all() and np.allclose(model.weights, back.weights)


def test_sequences_travel_compressed(spark, monkeypatch):
    made, run = [], shards.arrow_map
    monkeypatch.setattr(shards, "arrow_map", lambda *x: made.append(run(*x)) or made[-1])
    df = staged(spark.createDataFrame([(b"ab" * 5000,)] * 3, "ids binary"), "ids")
    root, rows = shards.write(df, "ids", 2, 255, length=1024)
    n = rows.count()
    assert made[0].selectExpr("max(length(body)) n").first().n < 1024
    assert [len(x) for x in shards.read(root)] == [1024] * n


def test_query_shards_token_ids(spark, sf_dir, monkeypatch):
    import public_tokenizers

    from lexigrove.llm import bpe, queries

    made, write = [], shards.write
    monkeypatch.setattr(shards, "write", lambda *a, **k: made.append(write(*a, **k)) or made[0])
    n = queries.op10_training_shards(spark, sf_dir).count()
    code = bpe.loaded(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    sequences = list(shards.read(made[0][0]))
    stream = np.concatenate([sequences[int(s)] for s in shards.Feistel(n, 17).slot(np.arange(n))])
    assert stream.dtype == np.dtype("<u2")
    parts = np.split(stream, np.flatnonzero(stream == len(code.piece)))
    got = sorted(code.decode(x[x != len(code.piece)].astype("<u4").tobytes()) for x in parts)
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert [x for x in got if x] == sorted(t for t in texts if t)


def test_layout_is_json(spark, texts):
    root = shards.write(spark.createDataFrame([(b"abc",)], "ids binary"), "ids", 1, 255, root=scratch_path(spark, "t"))[0]
    fs, top = shards._open(root)
    with fs.open_input_stream(f"{top}/layout.json") as f:
        assert json.loads(f.read())["sequences"] == 1
