"""Concurrent saves, embeddings by content, and the ledger of requests."""

from __future__ import annotations

import threading

import numpy as np
import pandas as pd
import pytest
from lexigrove.sources.ledger import Ledger
from lexigrove.sources.state import Taken, Workspace
from lexigrove.sources.vector_store import VectorStore
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def test_two_writers_lose_no_save(spark, tmp_path):
    root = f"file://{tmp_path}/ws"
    Workspace(spark, root).init()
    failed = []

    def add(who: str) -> None:
        try:
            w = Workspace(spark, root)
            for k in range(3):
                w.apply({"type": "add", "new_cluster": {"name": f"{who}{k}", "description": "d"}})
        except Exception as e:  # the thread's failure is the test's
            failed.append(e)

    threads = [threading.Thread(target=add, args=(x,)) for x in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    state = Workspace(spark, root).load()
    assert {r.name for r in state.clusters.collect()} == {f"{x}{k}" for x in "ab" for k in range(3)}
    saves = [r.save for r in Workspace(spark, root)._saves().collect()]
    assert len(saves) == len(set(saves)) == 7
    assert len({r.cluster_id for r in state.clusters.collect()}) == 6


def test_a_dead_writers_number_is_passed_over(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/ws")
    w.init()
    w.patience = 0.5
    (tmp_path / "ws/numbers" / f"{2:020d}").touch()  # and nothing is said in it
    with pytest.raises(Taken):
        w.save(w.load(), "x", "", after=1)
    assert [r.name for r in w.apply({"type": "add", "new_cluster": {"name": "n", "description": "d"}}).clusters.collect()] == ["n"]
    assert w._latest() == 3


def encoder_of():
    return lambda: lambda texts: np.array([[len(t), sum(c in "aeiou" for c in t)] for t in texts])


def test_texts_are_embedded_once(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["one", "two", "one", None, "", "three"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    store, encoder = VectorStore(spark, f"file://{tmp_path}/v", "m1"), encoder_of()
    assert store.fill(docs, encoder, batch=2) == 4
    assert store.fill(docs, encoder) == 0
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 1, "too").otherwise(F.col("text")))
    assert VectorStore(spark, f"file://{tmp_path}/v", "m1").fill(changed, encoder) == 1
    assert {r.doc_id: list(r.embedding) for r in store.vectors(changed, "doc_id").collect()} == {0: [3, 2], 1: [3, 2], 2: [3, 2], 3: [0, 0], 4: [0, 0], 5: [5, 2]}
    assert VectorStore(spark, f"file://{tmp_path}/v", "m2").fill(docs, encoder) == 4


def provider_for(path):
    """Answers "<request>!"; ids ending in 3 fail twice, in 5 are limited once, in 7 refused; every call is a file."""

    def provider(asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in asked.itertuples():
            calls = len(list(path.glob(f"{r.custom_id}#*")))
            (path / r.key).touch(exist_ok=False)
            status = "failed" if r.custom_id.endswith("3") and calls < 2 else "limited" if r.custom_id.endswith("5") and calls < 1 else "refused" if r.custom_id.endswith("7") else "ok"
            out.append((r.custom_id, status, f"{r.request}!" if status == "ok" else None, 9.0 if status == "limited" else 0.0))
        return pd.DataFrame(out, columns=["custom_id", "status", "response", "wait"])

    return provider


def test_a_resumed_run_equals_a_whole_one(spark, tmp_path):
    requests = spark.createDataFrame([(f"r{i:02d}", f"ask {i}") for i in range(40)], "custom_id string, request string").repartition(4)
    results = []
    for name, stops in (("whole", [None]), ("resumed", [1, 2, None])):
        calls = tmp_path / name
        calls.mkdir()
        waits: list[float] = []
        for stop in stops:  # a new driver each time
            ledger = Ledger(spark, f"file://{tmp_path}/ledger_{name}")
            assert ledger.submit(requests) == (40 if stop == stops[0] else 0)
            ledger.run(provider_for(calls), wave_rows=15, sleep=waits.append, waves=stop)
        assert all(w >= 1.0 for w in waits) and max(waits) >= 9.0
        state = ledger.state().collect()
        results.append(sorted((r.custom_id, r.status, r.response, r.attempts) for r in state))
        assert len(list(calls.iterdir())) == ledger.attempts().count()  # no attempt twice
    assert results[0] == results[1]
    assert {r[1] for r in results[0] if r[0].endswith("7")} == {"refused"} and {r[3] for r in results[0] if r[0].endswith("3")} == {3}
    assert sum(r[1] == "ok" for r in results[0]) == 36


def test_a_wave_that_breaks_leaves_no_attempts(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l", most_attempts=2)
    ledger.submit(spark.createDataFrame([("a", "x"), ("b", "y")], "custom_id string, request string"))

    def broken(asked: pd.DataFrame) -> pd.DataFrame:
        raise RuntimeError("killed")

    with pytest.raises(PySparkException):
        ledger.run(broken)
    assert ledger.attempts().count() == 0 and ledger.state().filter("status = 'open'").count() == 2
    nothing = lambda asked: pd.DataFrame({"custom_id": [], "status": [], "response": [], "wait": []})
    assert ledger.run(nothing, sleep=lambda s: None) == 4
    assert [r.status for r in ledger.state().collect()] == ["failed", "failed"] and ledger.answers().count() == 0
