from __future__ import annotations

import json

import pytest

from lexigrove.sources import corpus


def rows(df):
    return [(r.doc_id, r.text) for r in df.orderBy("ord").collect()]


def test_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('﻿id,text\nx," a, ""b"""\ny,   \nz,"two\nlines"\n')
    assert rows(corpus.load_corpus(spark, str(p), "text", "id")) == [("x", 'a, "b"'), ("z", "two\nlines")]
    assert rows(corpus.load_corpus(spark, str(p), "text")) == [("0", 'a, "b"'), ("2", "two\nlines")]
    with pytest.raises(ValueError, match="no column"):
        corpus.load_corpus(spark, str(p), "body")
    with pytest.raises(ValueError, match="csv"):
        corpus.load_corpus(spark, "a.xml", "text")


def test_json(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"id": 7, "text": " a "}, {"text": ""}, "plain", ""]))
    assert rows(corpus.load_corpus(spark, str(p), "text")) == [("7", "a"), ("2", "plain"), ("3", "")]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"text": "a"}\n\n[1]\n{"id": "k", "text": "b"}\nnot json\n{"text": " "}\n{"other": 1}\n')
    assert rows(corpus.load_corpus(spark, str(p), "text")) == [("0", "a"), ("k", "b")]


def test_dataset_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("d-test-000000", "t", -1, "__none__", True, "test", 0)], corpus.DOCUMENT)
    corpus.write_dataset(d, str(tmp_path))
    assert corpus.read_dataset(spark, str(tmp_path)).collect() == d.collect()


def test_agent_outputs(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.json").write_text(json.dumps({"clusters": [{"name": "A", "text_ids": ["1", "2"]}, {"name": "B", "text_ids": ["2"]}]}))
    got = corpus.read_proposals(spark, str(tmp_path / "p")).orderBy("ord").collect()
    assert [(r.proposal, r.text_id, r.cluster) for r in got] == [("one", "1", "A"), ("one", "2", "A"), ("one", "2", "B")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps({"cluster_definitions_version": 2, "assignments": [{"text_id": "1", "cluster_id": "c1", "confidence": 4}]}))
    r = corpus.read_audits(spark, str(tmp_path / "a")).first()
    assert (r.audit_id, r.cluster_version, r.confidence) == ("x", 2, "4")


def test_cells_and_logs(spark, tmp_path):
    cell = tmp_path / "r" / "lda" / "bank"
    cell.mkdir(parents=True)
    (cell / "seed=3.meta.json").write_text(json.dumps({"metrics": {"ari": 0.5}}))
    r = corpus.read_cells(spark, str(tmp_path / "r")).first()
    assert (r.method, r.dataset, r.seed) == ("lda", "bank", 3)
    log = tmp_path / "log.jsonl"
    log.write_text('{"a":1}\nbad\n{"a":2}\n{"a":3}\n')
    assert [x.value for x in corpus.log_tail(spark, str(log), 2).collect()] == ['{"a":3}', '{"a":2}']
