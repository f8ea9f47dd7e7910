from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import annotate, audits, corpus, evaluation, sampling, taxonomy, tfidf
from lexigrove.plans import reports, runners
from lexigrove.sources.state import Workspace, workspace_root

CLUSTERS = [("c1", "Billing", "d1", ["1", "2"], 4, 4.5, "audited"), ("c2", "Login", "d2", ["2", "3"], 2, 2.0, "audited")]


def test_states_survive_their_driver(spark, tmp_path, monkeypatch):
    w = Workspace(spark, f"file://{tmp_path}/w")
    assert w.init().clusters.count() == 0
    with pytest.raises(Exception):  # noqa: B017
        w.init()
    w.save(taxonomy.Taxonomy(spark.createDataFrame(CLUSTERS, taxonomy.SCHEMA), 1, 0.5, 3.0), "set", "two")
    w.apply({"type": "merge", "merge_into": "c1", "targets": ["c1", "c2"]})
    now = Workspace(spark, w.root).load()
    assert (now.version, now.coverage) == (2, None)
    assert [r.evidence for r in now.clusters.collect()] == [["1", "2", "3"]]
    assert w.load(2).clusters.count() == 2
    assert w.apply({"type": "no_change", "rejected_hypothesis": "h"}).rejected == ("h",)
    assert [r.action for r in w.log().orderBy("ts").collect()] == ["init", "set", "merge", "no_change"]
    for _ in range(2):
        w.mark_seen(spark.createDataFrame([(1,), (2,), (2,)], "doc_id long"))
    assert sorted(r.doc_id for r in w._rows("seen", "doc_id string").collect()) == ["1", "2"]
    w.log().write.parquet(f"{w.root}/proposals")
    assert w.archive(["proposals", "audits", "saves"]) == ["proposals"]
    assert spark.read.parquet(f"{w.root}/archive/proposals").count() == 4
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("LEXIGROVE_WORKSPACE", raising=False)
    assert workspace_root("d") == "d"
    (tmp_path / ".lexigrove_workspace").write_text("p\n")
    assert workspace_root("d") == "p"
    monkeypatch.setenv("LEXIGROVE_WORKSPACE", "e")
    assert workspace_root("d") == "e"


def test_reports(spark):
    clusters = spark.createDataFrame(CLUSTERS, taxonomy.SCHEMA)
    rows = spark.createDataFrame([("a", "1", "c1", 5.0, 1), ("a", "2", "c2", 1.0, 1), ("a", "3", "", None, 1)], "audit_id string, text_id string, cluster_id string, confidence double, cluster_version int")
    text = reports.audit_report(rows, clusters, 1)
    assert "67% (2 of 3, 1 unclustered), mean confidence 3.00" in text and "Weak clusters: c2" in text
    assert "| c1 | Billing | d1 | 2 | 4 | 4.50 | high | audited |" in reports.taxonomy_summary(taxonomy.Taxonomy(clusters, 3, rejected=("no",)))
    cells = spark.createDataFrame([("p", "m_1", "d", "ari", 0.5, True), ("p", "m2", "d", "ari", 0.25, False)], "panel string, method string, dataset string, metric string, value double, best boolean")
    tex = reports.latex_results(cells, ["d"], ["ari", "nmi"])
    assert r"m\_1 & \underline{0.500} & -- \\" in tex and r"m2 & 0.250 & -- \\" in tex
    pairs = spark.createDataFrame([("p", "q", str(i), "x" if i < 2 else "y", "u" if i < 2 else "v") for i in range(4)], "a string, b string, text_id string, ca string, cb string")
    assert "strong" in reports.agreement_report(pairs)


def test_datasets_and_cells_run_end_to_end(spark, tmp_path):
    rows = [(f"d-{i}", f" text {i} ", i % 2, f"l{i % 2}", False, "train", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, gold_label_id int, gold_label_name string, is_none boolean, source_split string, source_row_index int")
    meta = runners.process_dataset(docs, f"{tmp_path}/set", 2)
    assert (meta["n_docs"], meta["has_none_class"]) == (6, False)
    with pytest.raises(ValueError, match="labels_missing"):
        runners.process_dataset(docs, f"{tmp_path}/bad", 3)
    v = spark.createDataFrame([(f"d-{i}", [1.0, float(i % 2) * 9 - 4.5 + i / 100]) for i in range(6)], "doc_id string, embedding array<double>")
    gold = docs.select("doc_id", F.col("gold_label_id").alias("label"))
    got = runners.run_array([("kmeans", "set", 0)], 0, lambda m, d, s: runners.run_cell(v, gold, m, d, s, 2, f"{tmp_path}/runs"))
    assert (got["ari"], got["acc"], got["predicted_k"], got["n"]) == (1.0, 1.0, 2, 6)
    with pytest.raises(ValueError):
        runners.run_array([], 0, None)


def test_stored_index_searches_as_the_other(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = tfidf.StoredIndex.write(docs, f"{tmp_path}/i")
    q = docs.filter("doc_id = 3").first().text
    want = [(r.doc_id, round(r.similarity, 9)) for r in tfidf.TfidfIndex(docs).search(q, 9).collect()]
    assert [(r.doc_id, round(r.similarity, 9)) for r in made.search(q, 9).collect()] == want
    assert tfidf.StoredIndex(spark, f"{tmp_path}/i").search("", 5).count() == 0


def test_small_operators(spark):
    df = spark.createDataFrame([("a.txt", "en", ["x"]), ("b", "de", []), (".txt", "en", None)], "name string, locale string, labels array<string>")
    assert [r[0] for r in df.select(corpus.without_suffix(F.col("name"))).collect()] == ["a", "b", ""]
    assert corpus.in_locale(df).count() == 2 and corpus.first_present(df, ["text", "name"]) == "name"
    assert tuple(corpus.single_label_counts(df, "labels").first()) == (1, 2)
    with pytest.raises(ValueError, match="none of"):
        corpus.first_present(df, ["q"])
    assert sampling.capped(9, 5) == 5 and sampling.sample_entry(spark, "random", 5).first().seed is not None
    assert evaluation.topics_asked(5, False) == (6, True)
    docs = spark.createDataFrame([(1,)], "doc_id int")
    bad = spark.createDataFrame([(1, "7", 2.0, 0)], "doc_id int, cluster string, confidence double, ord int")
    with pytest.raises(Exception, match="unknown cluster id"):
        evaluation.predictions(docs, bad, k=3).collect()
    given = spark.createDataFrame([(1, "{", ["p"])], "id int, text string, given array<string>")
    assert annotate.merged_or_given(given, "id", "text", "given").first().labels == ["p"]
    rows = spark.createDataFrame([(None, 0.5), (None, 0.25)], "audit_id string, confidence double")
    assert sorted(r.normalised for r in audits.normalise_confidence(rows).collect()) == [1.0, 2.0]


@pytest.mark.parametrize("fold", [1, 2, 16])
def test_diverse_sample_does_not_hang_on_folds(spark, monkeypatch, fold):
    monkeypatch.setattr(sampling, "FOLD", fold)
    v = spark.createDataFrame([(i, [float(i % 5) - 2, float(i % 3) - 1, 1.0]) for i in range(15)], "vec_id int, embedding array<double>")
    got = [(r.vec_id, round(r.distance, 9)) for r in sampling.diverse_sample(v, 6, 0).orderBy("pick").collect()]
    monkeypatch.setattr(sampling, "FOLD", 99)
    assert got == [(r.vec_id, round(r.distance, 9)) for r in sampling.diverse_sample(v, 6, 0).orderBy("pick").collect()]
