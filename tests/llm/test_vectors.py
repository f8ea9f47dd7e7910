"""Vector operators against brute force: odd rows, ties, repeated rows, clashing columns, small blocks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from lexigrove.llm import QUERIES, codes, negatives, postings
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, rid string, v string, id string, block string, `a.b` int"
NAN, INF = float("nan"), float("inf")


def rows_of(n: int, dim: int, seed: int, hot: int = 0) -> list[tuple]:
    """Clusters, ``hot`` equal vectors, repeated ids and rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    x = centers[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:hot] = x[0]
    rows = [(int(i * 10), x[i].astype(np.float32).astype(float).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [rows[5], rows[5], (rows[7][0], rows[8][1], 1), (31, None, 1), (33, [NAN] * dim, 2), (35, [INF] + [0.0] * (dim - 1), 2), (37, [None] + [1.0] * (dim - 1), 0), (39, [], 1), (41, [0.0] * dim, 3), (43, rows[3][1], None), (45, [1.0] * (dim + 8), 1)]
    return [(*r, "x", "y", "z", "w", 1) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def good(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# ---------------------------------------------------------------- codes


def plain_codes(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096):
    kept = [(r[0], r[2], [math.floor(scale * x) for x in r[1]]) for r in rows if good(r[1])]
    dim = len(min((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2]), default=(0, 0, []))[2])
    kept = [r for r in kept if len(r[2]) == dim]
    width = dim // parts
    first = {}
    for i, _, x in kept:
        if i not in first or x < first[i]:
            first[i] = x
    start = [first[i] for i in sorted(first, key=lambda i: (i is None, i))[:entries]]
    books = [[x[p * width : (p + 1) * width] for x in start] for p in range(parts)]

    def place(x):
        out = []
        for p in range(parts):
            far = [(sum((a - b) ** 2 for a, b in zip(x[p * width : (p + 1) * width], e, strict=True)), k) for k, e in enumerate(books[p])]
            out.append(min(far))
        return out

    for _ in range(rounds):
        at = [place(x) for _, _, x in kept]
        for p in range(parts):
            for k in range(len(start)):
                of = [x[p * width : (p + 1) * width] for (_, _, x), c in zip(kept, at, strict=True) if c[p][1] == k]
                if of:
                    books[p][k] = [sum(col) // len(of) for col in zip(*of, strict=True)]
    out = []
    for i, label, x in kept:
        c = place(x)
        out.append((i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), label))
    return out, books


def key(row: tuple) -> tuple:
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize(("n", "hot"), [(90, 0), (70, 30), (5, 0)])
def test_codes_equal_brute_force(spark, n, hot):
    rows = [r for r in rows_of(n, 16, n, hot) if len(r[1] or [1]) != 0] if n > 9 else [(i * 3, [float(i)] * 8, 1, "", "", "", "", 0) for i in range(n)]
    rows.append((None, rows[0][1], None, "", "", "", "", 0))
    got = codes.compress(frame(spark, rows), keep=["label"], buckets=3)
    want, books = plain_codes(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got.rows.collect()), key=key) == sorted(want, key=key)
    assert got.books.tolist() == books
    assert got.sha256() == codes.Codes(None, np.array(books)).sha256()


def test_a_round_shuffles_only_what_changed():
    rng = np.random.default_rng(1)
    x = rng.integers(-4000, 4000, (200, 16))
    books = x[:16].reshape(16, 8, 2).transpose(1, 0, 2)
    old, _ = codes.assign(x, books)
    assert codes.changes(x, old, old, 8, 16) == []
    new = old.copy()
    new[3, 2] = (new[3, 2] + 1) % 16
    moved = codes.changes(x, old, new, 8, 16)
    assert sorted((d["part"], d["n"]) for d in moved) == [(2, -1), (2, 1)]
    assert sorted(d["sums"] for d in moved) == sorted([x[3, 4:6].tolist(), (-x[3, 4:6]).tolist()])


def test_wide_integers_are_exact():
    x = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 3]])
    books = np.array([[[1 << 26, -(1 << 26)], [0, 0]]])
    code, error = codes.assign(x, books)
    assert code.tolist() == [[0], [1]] and error.tolist() == [[0], [((1 << 26) - 1) ** 2 + 9]]


def test_codes_of_nothing_and_of_too_large_components(spark):
    none = codes.compress(frame(spark, []), keep=["label"])
    assert none.rows.count() == 0 and none.rows.columns == ["vec_id", "label", "code", "error"]
    assert codes.compress(frame(spark, [(1, None, 1, "", "", "", "", 0)])).rows.count() == 0
    with pytest.raises(PySparkException):
        codes.compress(frame(spark, [(1, [1e9] * 8, 1, "", "", "", "", 0)]))
    with pytest.raises(ValueError, match="clash"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 8, 2)], "vec_id long, embedding array<double>, code int"), keep=["code"])


# ---------------------------------------------------------------- hard negatives


def plain_negatives(rows: list[tuple], every: int, positives: int = 5, most: int = 10):
    kept = [(r[0], r[2], [math.floor(256 * x) for x in r[1]]) for r in rows if r[0] is not None and r[2] is not None and good(r[1]) and r[1]]
    dim = len(min(kept, key=lambda r: r[0])[2])
    kept = [r for r in kept if len(r[2]) == dim]
    x = np.array([r[2] for r in kept])
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        score = x @ np.array(v)
        order = sorted((k for k in range(len(kept)) if k != a), key=lambda k: (-score[k], kept[k][0]))
        for p in [k for k in order if kept[k][1] == label][:positives]:
            fit = [k for k in order if kept[k][1] != label and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            out += [(i, kept[p][0], rank, kept[k][0], int(score[p]), int(score[k])) for rank, k in enumerate(fit[:most], 1)]
    return out


@pytest.mark.parametrize(("n", "hot"), [(150, 0), (120, 50)])
def test_negatives_equal_brute_force(spark, monkeypatch, n, hot):
    for name, size in (("CELL_ROWS", 24), ("BLOCK_ROWS", 10), ("PACK_ROWS", 6), ("LEAF_ROWS", 4)):
        monkeypatch.setattr(negatives, name, size)
    rows = rows_of(n, 16, n + 1, hot)
    got = negatives.mine(frame(spark, rows), F.col("id") % 30 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_negatives(rows, 30))


def test_bounds_prune_and_keep_what_counts():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(100, 8)) * 0.1 + c * 9 for c in np.eye(8)[:4]])
    tree = negatives.Tree(x, 16)
    cell = negatives.nearest(x, tree.centers)
    radii = np.array([np.sqrt(((x[cell == k] - tree.centers[k]) ** 2).sum(axis=1)).max() if (cell == k).any() else -1 for k in range(16)])
    cells = negatives.Cells(tree.children, *tree.cover(radii), np.arange(17))
    a = x[:20]
    center, radius = negatives._ball(a)
    for low, high in ((60.0, 1e9), (-1e9, 2.0), (-1e9, 1e9), (70.0, 75.0)):
        found = set(cells.reached(center, radius, low, high))
        score = a @ x.T
        must = set(cell[np.unique(np.nonzero((score >= low) & (score <= high))[1])])
        assert must <= found
        if low == 60.0:
            assert len(found) <= 8


def test_negatives_of_nothing(spark):
    assert negatives.mine(frame(spark, []), F.col("id") % 2 == 0).count() == 0
    assert negatives.mine(frame(spark, [(2, [1.0], 1, "", "", "", "", 0)]), F.col("id") % 2 == 0).count() == 0
    assert negatives.mine(frame(spark, [(3, [1.0], 1, "", "", "", "", 0)]), F.col("id") % 2 == 0).count() == 0


# ---------------------------------------------------------------- nearest neighbours


def plain_search(rows: list[tuple], every: int, k: int = 10) -> list[tuple]:
    kept = [(r[0], r[1]) for r in rows if r[0] is not None and good(r[1]) and any(r[1])]
    dim = len(min(kept, key=lambda r: r[0])[1])
    kept = [r for r in kept if len(r[1]) == dim]
    x = np.array([r[1] for r in kept])
    out = []
    for a, (i, v) in enumerate(kept):
        if i % every == 0:
            far = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            near = sorted((j for j in range(len(kept)) if j != a), key=lambda j: (far[j], kept[j][0]))[:k]
            out += [(i, rank, kept[j][0], float(far[j])) for rank, j in enumerate(near, 1)]
    return out


@pytest.mark.parametrize(("n", "hot", "ratio"), [(150, 0, 0.2), (130, 60, 0.2), (150, 40, 9.0)])
def test_search_finds_nearly_all(spark, monkeypatch, n, hot, ratio):
    for name, size in (("BLOCK_ROWS", 12), ("QUERY_ROWS", 3), ("HELD_QUERIES", 5)):
        monkeypatch.setattr(postings, name, size)
    rows = rows_of(n, 16, n, hot)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in postings.search(frame(spark, rows), F.col("id") % 30 == 0, ratio=ratio, list_rows=16).collect())
    want = sorted(plain_search(rows, 30))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    by = lambda z: {q: [x[2] for x in z if x[0] == q] for q in {x[0] for x in z}}
    a, b = by(got), by(want)
    hits = sum(len(set(a[q]) & set(b[q])) for q in b) / sum(len(set(b[q])) for q in b)
    assert hits >= 0.9
    assert all(g[3] >= w[3] - 1e-12 for g, w in zip(got, want, strict=True))
    if ratio > 1:  # all lists are searched
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_few_lists_still_hold_enough_rows(spark):
    rows = rows_of(90, 8, 3, 20)
    got = postings.search(frame(spark, rows), F.col("id") % 50 == 0, ratio=0.0, replica_ratio=0.0, list_rows=2).groupBy("query_id").count().collect()
    assert got and all(r["count"] % 10 == 0 for r in got)


def test_graph_search_reaches_what_a_scan_finds():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 12)) * 0.1 + c * 4 for c in np.eye(12)])
    centers = postings.Tree(x, 120).centers
    graph = postings.CentroidGraph.over(centers)
    q = x[::60]
    rows, at, far = graph.within(q, 0.15)
    d = np.sqrt(((q[:, None] - centers) ** 2).sum(axis=2))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= d.min(axis=1, keepdims=True) * 1.15), strict=True)}
    assert len(want & set(zip(rows.tolist(), at.tolist(), strict=True))) >= 0.95 * len(want)
    assert np.allclose(far, d[rows, at])


def test_search_of_nothing_and_of_few(spark):
    assert postings.search(frame(spark, []), F.col("id") % 2 == 0).count() == 0
    one = frame(spark, [(2, [1.0, 0.0], 1, "", "", "", "", 0)])
    assert postings.search(one, F.col("id") % 2 == 0).count() == 0
    two = frame(spark, [(2, [1.0, 0.0], 1, "", "", "", "", 0), (3, [1.0, 2.0], 1, "", "", "", "", 0)])
    assert [tuple(r) for r in postings.search(two, F.col("id") % 2 == 0).collect()] == [(2, 1, 3, 2.0)]


# ---------------------------------------------------------------- registered queries


def embeddings(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]


def test_op11(spark, sf_dir):
    want, books = plain_codes(embeddings(spark, sf_dir))
    total = {}
    for _, _, e, label in want:
        total[label] = total.get(label, 0) + e
    sha = codes.Codes(None, np.array(books)).sha256()
    got = QUERIES["op11_vector_codes"](spark, sf_dir).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted((i, c, e, total[label], sha) for i, c, e, label in want)


def test_op12(spark, sf_dir):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in embeddings(spark, sf_dir)]
    assert sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, sf_dir).collect()) == sorted(plain_negatives(rows, 100))


def test_op13(spark, sf_dir):
    got = {(r.query_id, r.vec_id): r.score for r in QUERIES["op13_posting_lists"](spark, sf_dir).collect()}
    want = {(q, i): s for q, _, i, s in plain_search(embeddings(spark, sf_dir), 100)}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got.keys() & want.keys())
