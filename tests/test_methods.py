"""Batch topic model, k-means from many starts and triplets against plain versions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from lexigrove.operators import methods, summed
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector


def psi(x: float) -> float:
    """By the definition: the difference quotient of the logarithm of the gamma function."""
    h = 1e-5
    return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)


def test_digamma():
    x = np.array([0.01, 0.2, 1.0, 2.5, 5.999, 6.0, 40.0, 1e4])
    assert np.allclose(summed.digamma(x), [psi(v) if v > 0.1 else -1 / v + psi(v + 1) for v in x], rtol=1e-6, atol=1e-6)


def plain_topics(docs: list[dict[int, int]], k: int, terms: int, seed: int, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Batch variational Bayes, a document at a time."""
    topics, prior = np.random.RandomState(seed).gamma(100.0, 0.01, (k, terms)), 1 / k

    def expected(w):
        return np.exp(summed.digamma(w) - summed.digamma(np.array([w.sum()]))[0])

    def one(doc, beta):
        ids, n = np.array(list(doc), int), np.array(list(doc.values()), float)
        g = np.ones(k)
        if not len(ids):
            return np.full(k, prior), ids, np.zeros((k, 0))
        for _ in range(100):
            last, theta = g, expected(g)
            norm = theta @ beta[:, ids] + 1e-100
            g = theta * (beta[:, ids] @ (n / norm)) + prior
            if np.abs(g - last).mean() < 1e-3:
                break
        theta = expected(g)
        return g, ids, np.outer(theta, n / (theta @ beta[:, ids] + 1e-100)) * beta[:, ids]

    for _ in range(iterations):
        beta, new = np.array([expected(t) for t in topics]), np.full((k, terms), prior)
        for d in docs:
            _, ids, stats = one(d, beta)
            new[:, ids] += stats
        topics = new
    beta = np.array([expected(t) for t in topics])
    return topics, np.array([one(d, beta)[0] for d in docs])


def test_topic_model_equals_plain_batch_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, terms = methods.counted(docs, 2_000)
    held = {r.doc_id: dict(zip(r.term, r.n, strict=True)) for r in rows.collect()}
    ids = sorted(held)
    want, weights = plain_topics([held[i] for i in ids], 4, len(terms), 3, 5)
    got = summed.fit_topics(rows.repartition(5), 4, len(terms), 3, 5)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-9)
    found = {r.doc_id: (r.topic, r.confidence) for r in summed.topic_of(rows, got, "doc_id").collect()}
    share = weights / weights.sum(axis=1, keepdims=True)
    assert np.allclose([found[i][1] for i in ids], share.max(axis=1), atol=1e-6)
    clear = np.sort(share, axis=1)
    assert all(found[i][0] == s.argmax() for i, s, c in zip(ids, share, clear, strict=True) if c[-1] - c[-2] > 1e-6)
    assert len(ids) == docs.count()


def test_topic_model_of_clear_texts_and_of_nothing(spark):
    rows = [(i, "cat dog bird cat" if i % 2 else "law tax court law") for i in range(20)] + [(20, None), (21, "the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.topic for r in methods.lda(docs, 2, seed=1).collect()}
    assert len(got) == 22 and len({got[i] for i in range(1, 20, 2)}) == 1 and got[0] != got[1]
    words = methods.topic_words(docs, 2, 3, seed=1).collect()
    assert {frozenset(r.term for r in words if r.topic == t) for t in (0, 1)} == {frozenset(["cat", "dog", "bird"]), frozenset(["law", "tax", "court"])}
    assert methods.lda(docs.limit(0), 2).count() == 0
    assert [r.topic for r in methods.lda(docs.filter("doc_id = 0"), 2).collect()] in ([0], [1])


def test_kmeans_costs_no_more_than_the_best_of_ten_runs(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ids, x = zip(*((r.vec_id, np.array(r.embedding, float)) for r in v.collect()), strict=True)
    x = np.array([a / np.linalg.norm(a) for a in x])
    found = {r.vec_id: r.cluster for r in methods.kmeans(v, 10).collect()}
    at = np.array([found[i] for i in ids])
    cost = sum(((x[at == c] - x[at == c].mean(axis=0)) ** 2).sum() for c in set(at.tolist()))
    rows = spark.createDataFrame([(a.tolist(),) for a in x], "v array<double>").select(array_to_vector("v").alias("features")).coalesce(1).cache()
    best = min(KMeans(k=10, seed=s, maxIter=300).fit(rows).summary.trainingCost for s in range(10))
    assert cost <= best * 1.005
    assert len(found) == len(ids)


def test_kmeans_starts_far_apart_and_odd_rows(spark):
    rows = [(i, [math.cos(a), math.sin(a)]) for i in range(90) for a in [i % 3 * 2 + i * 1e-4]] + [(100, None), (101, [0.0, 0.0]), (102, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in methods.kmeans(df, 3).collect()}
    assert len(got) == 90 and len({(got[i], i % 3) for i in range(90)}) == 3
    assert got == {r.vec_id: r.cluster for r in methods.kmeans(df.repartition(7), 3).collect()} or len(set(got.values())) == 3
    assert methods.kmeans(df.limit(0), 3).count() == 0
    assert {r.cluster for r in methods.kmeans(df.filter("vec_id < 2"), 5).collect()} == {0, 1}


def draw(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


@pytest.mark.parametrize(("cap", "clusters", "near"), [(67.0, 1, 0.02), (0.0, 6, 0.5), (3.0, 3, 0.02)])
def test_triplets_equal_a_plain_version(spark, cap, clusters, near):
    rng = np.random.default_rng(1)
    at = np.array([[0, 0], [2, 0], [10, 0], [12, 0], [5, 30], [7, 30]], float)
    label = rng.integers(0, 6, 300)
    x = at[label] + rng.normal(size=(300, 2))
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(300)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.query_idx: (r.choice1_idx, r.choice2_idx, r.entropy) for r in methods.entropy_triplets(df, df.select("vec_id", "label"), most=40, near=near, cap=cap).collect()}
    if clusters == 1:
        assert got == {}
        return
    own = label // 2 if clusters == 3 else label
    centers = np.array([x[own == c].mean(axis=0) for c in range(clusters)])
    close = max(2, math.ceil(clusters * near))
    info = []
    for i in range(300):
        chance = 1 / (1 + ((centers - x[i]) ** 2).sum(axis=1))
        order = sorted(range(clusters), key=lambda c: (-round(chance[c], 12), c))[:close]
        p = chance[order] / chance[order].sum()
        info.append((round(float(-(p * np.log(p)).sum()), 10), order))
    pool = sorted(range(300), key=lambda i: (-info[i][0], i))[:60]
    asked = sorted(pool, key=lambda i: (draw(100, "=query", i), i))[:40]
    members = {c: sorted((i for i in range(300) if own[i] == c), key=lambda i: (draw(100, "=member", i), i)) for c in range(clusters)}
    want = {}
    for i in asked:
        first = draw(100, "=first", i) % close
        second = (first + 1 + draw(100, "=second", i) % (close - 1)) % close
        pair = []
        for name, c in (("=one", info[i][1][first]), ("=two", info[i][1][second])):
            k = draw(100, name, i) % len(members[c])
            pair.append(members[c][k] if members[c][k] != i else members[c][(k + 1) % len(members[c])])
        want[i] = (*pair, info[i][0])
    assert got.keys() == want.keys()
    assert all(got[i][:2] == want[i][:2] and abs(got[i][2] - want[i][2]) < 1e-9 for i in want)


def test_triplets_of_one_cluster(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert methods.entropy_triplets(df, df.select("vec_id", "label")).count() == 0
    assert methods.entropy_triplets(df.limit(0), df.select("vec_id", "label")).count() == 0
