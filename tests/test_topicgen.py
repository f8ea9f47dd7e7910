"""Topic generation against a plain loop, stops and goes on; refinement, assignment and correction."""

from __future__ import annotations

import hashlib
import uuid

import pytest

from lexigrove.operators import topicgen
from lexigrove.session import shared_folder

TEMPLATE = "Topics:\n{Topics}\nText:\n{Document}"


def provider():
    """A topic a word that starts with a capital letter; "fail" gets no answer. Made here, so that it travels by value."""

    def by_words(asked):
        out = []
        for p in asked:
            text = p.partition("\nText:\n")[2]
            out.append(None if text == "fail" else "\n".join(f"[1] {w}: about {w} after {p.count('[1]')}" for w in text.split() if w[0].isupper()))
        return out

    return by_words


by_words = provider()


def texts(n):
    return [(i, "fail" if i % 13 == 5 else f"T{i % 17} x T{i % 17} " + (f"U{i // 40}" if i % 5 == 0 else "low [1] {Topics}")) for i in range(n)]


def plain(rows, stop, seed=0):
    names, quiet, answers = {}, 0, []
    key = lambda r: (hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), str(r[0]), r[1])
    for rank, (_, text) in enumerate(sorted((r for r in rows if r[1] is not None), key=key)):
        lines = "\n".join(f"[1] {t}: {d}" for t, (d, _, _) in names.items())
        said = by_words([TEMPLATE.replace("{Topics}", lines).replace("{Document}", text) if "{Topics}" not in text else f"Topics:\n{lines}\nText:\n{text}"])[0]
        fresh = False
        for name, about in topicgen.named(said):
            if name in names:
                names[name] = (names[name][0], names[name][1] + 1, names[name][2])
            else:
                names[name], fresh = (about, 1, rank), True
        answers.append((rank, said))
        quiet = 0 if fresh else quiet + 1
        if quiet >= stop:
            break
    return sorted((t, d, n, f) for t, (d, n, f) in names.items()), answers


def generation(spark, stop, size=16, root=None, ask=by_words):
    return topicgen.TopicGeneration(spark, root or f"{shared_folder(spark)}/gen-{uuid.uuid4().hex}", TEMPLATE, ask, stop, size)


def found(made):
    return sorted(tuple(r) for r in made.topics().collect()), [(r.r, r.response) for r in made.answers().orderBy("r").collect()]


@pytest.mark.parametrize("stop", [6, 1000])
def test_equals_a_plain_loop(spark, stop):
    rows = [*texts(90), (None, "Null one"), (7, None), (3, texts(90)[3][1])]
    made = generation(spark, stop)
    assert made.run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert found(made) == plain(rows, stop)


def test_stopped_run_goes_on(spark, monkeypatch):
    monkeypatch.setattr(topicgen, "AHEAD", 2)
    rows = texts(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = generation(spark, 1000)
    assert not made.run(docs, rounds=1)

    def broken(asked):
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        generation(spark, 1000, root=made.root, ask=broken).run(docs)
    # What a cut-off round wrote doesn't count.
    spark.createDataFrame([(1, "lost", "Lost", "", 1, 0)], topicgen.TOPICS).write.mode("append").parquet(f"{made.root}/topics")
    spark.createDataFrame([(1, "lost", 16, "0", "[1] Lost: x", 1)], topicgen.ANSWERS).write.mode("append").parquet(f"{made.root}/answers")
    again = generation(spark, 1000, root=made.root)
    assert again.run(docs)
    assert found(again) == plain(rows, 1000)
    n = again.answers().count()
    assert again.run(docs) and again.answers().count() == n


def test_empty_corpus(spark):
    made = generation(spark, 5)
    assert made.run(spark.createDataFrame([], "doc_id long, text string"))
    assert found(made) == ([], [])


def test_fill_replaces_once():
    assert topicgen.fill("{A}-{B}-{A}", A="{B}", B="b") == "{B}-b-{B}"
    with pytest.raises(ValueError):
        topicgen.fill("{A}", A="x", B="y")


def test_prompts(spark):
    got = topicgen.prompts(spark.createDataFrame([("a", "t{tree}"), ("b", None)], "id string, text string"), "see {tree}: {Document}!", "[1] X: y").orderBy("id").collect()
    assert [r.prompt for r in got] == ["see [1] X: y: t{tree}!", "see [1] X: y: !"]


def test_refined(spark):
    topics = spark.createDataFrame([("a", "da", 5, 3), ("b", "db", 3, 1), ("c", "dc", 2, 2), ("rare", "r", 1, 9), ("p", "dp", 40, 4), ("q", "dq", 49, 5)], "topic string, description string, n long, first long")
    merges = spark.createDataFrame([("a", "b", None), ("b", "new", "second"), ("b", "zzz", "later"), ("c", "new", "merged"), ("p", "q", None), ("q", "p", None), ("none", "a", "unused")], "old string, new string, description string")
    kept, fate = topicgen.refined(topics, merges, 0.02)
    assert sorted(tuple(r) for r in kept.collect()) == [("new", "merged", 10, 1), ("p", "dp", 89, 4)]
    assert {r.topic: r.refined for r in fate.collect()} == {"a": "new", "b": "new", "c": "new", "rare": None, "p": "p", "q": "p"}
    none, _ = topicgen.refined(topics.limit(0), merges)
    assert none.count() == 0


def test_assignment_and_correction(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    known = spark.createDataFrame([("A",), ("B",)], "topic string")
    said = spark.createDataFrame([("0", "[1] A: x"), ("1", "[1] Z: x"), ("2", "talk"), ("3", "[1] Z: x\n[2] B: y"), ("9", "[1] A: x")], "custom_id string, response string")
    rows = topicgen.to_correct(topicgen.assigned(docs, said), known)
    assert [(r.error, r.hallucinated) for r in rows.orderBy("doc_id").collect()] == [(False, False), (False, True), (True, False), (False, False), (True, False)]
    again = spark.createDataFrame([("1", "[1] B: x"), ("2", "Error"), ("4", None)], "custom_id string, response string")
    got = topicgen.corrected(rows, again).orderBy("doc_id").collect()
    assert [r.response for r in got] == ["[1] A: x", "[1] B: x", "talk", "[1] Z: x\n[2] B: y", "Error"]


def test_request_files(spark):
    rows = spark.createDataFrame([(f"{i:03d}", "x" * 9) for i in range(10)], "custom_id string, prompt string")
    assert [r.file for r in topicgen.request_files(rows, 4, 35).orderBy("custom_id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
