"""What the topic model costs and what its packed rows hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from lexigrove.operators import methods, summed


def jobs(spark, run) -> tuple[object, int]:
    sc, group = spark.sparkContext, f"counted-{id(run)}"
    sc.setJobGroup(group, "")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("tasks", [7, 90])
def test_sums_are_one_job_of_many_tasks(spark, tasks):
    def add(total: np.ndarray, b: pa.RecordBatch) -> None:
        total += sum(b.column("id").to_pylist())

    got, n = jobs(spark, lambda: summed.task_sums(spark.range(0, 900, 1, tasks), add, (2,)))
    assert got.tolist() == [899 * 450.0] * 2
    assert n <= 3  # of 7 tasks each was a job of its own


@pytest.mark.parametrize("seed", range(3))
def test_documents_in_groups_equal_documents_alone(seed, monkeypatch):
    monkeypatch.setattr(summed, "HELD_WEIGHTS", 900)
    rng = np.random.default_rng(seed)
    sizes = np.concatenate([[0, 60, 1], rng.integers(0, 40, 50)])
    bound = np.concatenate([[0], np.cumsum(sizes)])
    term = np.concatenate([np.sort(rng.choice(60, n, replace=False)) for n in sizes])
    count, words = rng.integers(1, 9, len(term)).astype(float), summed.expected(rng.random((3, 60)) + 0.1)
    weights, stats = summed.document_topics(bound, term, count, words, 1 / 3)
    alone = [summed.document_topics(np.array([0, b - a]), term[a:b], count[a:b], words, 1 / 3) for a, b in zip(bound, bound[1:], strict=False)]
    assert np.allclose(weights, np.concatenate([x[0] for x in alone]), rtol=1e-9) and np.allclose(stats, sum(x[1] for x in alone), rtol=1e-9)


def test_narrow_numbers():
    for x in ([], [0, 255], [256, 1], [65_536, 3]):
        assert summed.widened(summed.narrow(np.array(x, int))).tolist() == x
    assert [summed.narrow(np.array([x]))[0] for x in (255, 256, 65_535, 65_536)] == [1, 2, 2, 4]


def test_each_row_is_a_text(spark, monkeypatch):
    monkeypatch.setattr(methods, "PACKED_TEXTS", 2)
    rows = [(1, "cat cat dog"), (1, "dog the law"), (None, "cat law"), (2, None), (3, "")]
    found, terms = methods.counted(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert terms == ["cat", "dog", "law"]
    got = sorted(((r.doc_id or 0, list(r.term), list(r.n)) for r in found.collect()))
    assert got == [(0, [0, 2], [1, 1]), (1, [0, 1], [2, 1]), (1, [1, 2], [1, 1]), (2, [], []), (3, [], [])]  # rows of one id were joined before


def test_an_iteration_of_topic_words_is_one_job(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} term{i % 5} both{i % 3}") for i in range(60)], "doc_id long, text string")
    rows, terms = methods.counted(docs)
    once, more = (jobs(spark, lambda n=n: summed.fit_topics(rows.repartition(6), 2, len(terms), 0, n))[1] for n in (1, 5))
    assert more - once <= 8  # a job a task and iteration before
