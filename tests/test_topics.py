"""Topic reduction against a plain version that looks at all pairs of groups each time."""

from __future__ import annotations

import numpy as np
import pytest
from lexigrove.operators import evaluation, topics
from pyspark.sql import functions as F


def plain_merge(far: np.ndarray, until: int) -> list[int]:
    groups = [[i] for i in range(len(far))]
    while len(groups) > max(until, 1):
        _, a, b = min((round(float(np.mean([far[i, j] for i in x for j in y])), 12), x[0], y[0]) for k, x in enumerate(groups) for y in groups[k + 1 :])
        x, y = (next(g for g in groups if g[0] == r) for r in (a, b))
        groups = [g for g in groups if g is not y]
        x += y
        x.sort()
        groups.sort()
    return [next(g[0] for g in groups if i in g) for i in range(len(far))]


@pytest.mark.parametrize("seed", range(6))
def test_merge_order(seed):
    rng = np.random.default_rng(seed)
    x = rng.random((14, 4))
    far = 1 - x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    for until in (1, 3, 7, 14, 20):
        assert topics.merge_order(far, until) == plain_merge(far, until)
    assert topics.merge_order(np.zeros((0, 0)), 3) == []


def test_reduction_joins_topics_of_like_words(spark):
    words = {0: "cat dog bird", 1: "cat dog fish", 2: "tax law court", 3: "law court judge", 4: "rain snow wind"}
    rows = [(10 * t + i, f"{w} extra{t}", t) for t, w in words.items() for i in range(4 + t)] + [(99, "cat law rain", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cluster int")
    asked, assign = evaluation.topics_asked(3, True)
    got = {r.doc_id: r.cluster for r in topics.reduce_topics(docs, asked).collect()}
    assert not assign and got[99] == -1
    assert got[0] == got[10] and got[20] == got[30] and len({got[0], got[20], got[40]}) == 3
    assert got[20] == 0  # the largest
    assert {r.cluster for r in topics.reduce_topics(docs, 50).collect()} == {-1, 0, 1, 2, 3, 4}
    assert topics.reduce_topics(docs.limit(0), 3).count() == 0


def test_outliers_go_to_the_nearest_topic(spark):
    rows = [(i, [1.0, 0.1 * i], 0) for i in range(5)] + [(i, [0.1 * i, 1.0], 1) for i in range(5, 8)] + [(8, [5.0, 0.0], -1), (9, [0.0, 3.0], -1)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>, cluster int")
    got = {r.doc_id: r.cluster for r in topics.assign_outliers(df.select("doc_id", "cluster"), df).collect()}
    assert got[8] == 0 and got[9] == 1 and got[0] == 0


def test_method_gives_the_number_of_topics_asked_for(spark):
    rng = np.random.default_rng(2)
    at = rng.normal(size=(6, 6)) * 3
    rows = [(i, f"word{i % 6} term{i % 6} both{i % 6 // 2}", (at[i % 6] + rng.normal(size=6) * 0.05).tolist()) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>")
    found = topics.density_method(docs, 3, has_none=False)
    got = {r.doc_id: r.cluster for r in found.collect()}
    assert set(got.values()) == {0, 1, 2} and all(got[i] == got[i % 6 // 2 * 2] for i in range(180))
    assert found.filter(F.col("cluster") < 0).count() == 0
