from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import agreement_label, confidence_label, first_json_block, preview, python_strip, topic_names
from lexigrove.operators import agreement, annotate, audits, corpus, density, evaluation, sampling, taxonomy

CLUSTERS = [("c1", "Billing", "d1", ["1", "2"], 4, 4.5, "audited"), ("c2", "Login", "d2", ["2", "3"], 2, 3.0, "audited"), ("c3", "Other", "d3", ["5", "6"], 0, None, "proposed")]


def one(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def test_strip_is_pythons(spark):
    texts = [" a b　", "\t\x1ca\x1f", "\u0085a\n", "", "  ", "a"]
    got = [r.x for r in one(spark, texts).select("i", python_strip(F.col("x")).alias("x")).orderBy("i").collect()]
    assert got == [t.strip() for t in texts]


def test_small_functions(spark):
    assert one(spark, ["[1] Café & co: x\n[2] B: y"]).select(topic_names(F.col("x"))).first()[0] == ["Café & co", "B"]
    assert one(spark, ["so {\"a\": {\"b\": 1}} ok"]).select(first_json_block(F.col("x"))).first()[0] == '{"a": {"b": 1}}'
    assert one(spark, ["é" * 301]).select(preview(F.col("x"))).first()[0] == "é" * 300 + "..."
    got = [r[0] for r in one(spark, [4.0, 3.0, 2.99, None], "double").orderBy("i").select(confidence_label(F.col("x"))).collect()]
    assert got == ["high", "medium", "low", "unaudited"]
    assert [r[0] for r in one(spark, [0.66, 0.65, 0.25], "double").orderBy("i").select(agreement_label(F.col("x"))).collect()] == ["strong", "moderate", "weak"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([1, 1, 1], [1, 1, 1]), ([0.85, 0.4], [4, 2]), ([0, 1, 1], [1, 5, 5]), ([0, 0], [1, 1]), ([-1, 0, 1], [1, 1, 1]),
        ([7, 3.5, -0.5], [5, 4, 1]), ([None, None], [None, None]), ([2, 5], [2, 5]), ([0.5, None], [2, None]), (["high", "2"], [None, 2]), (["0.5"], [2]),
    ],
)
def test_confidence_scales(spark, given, want):
    rows = spark.createDataFrame([("a", i, None if v is None else str(v)) for i, v in enumerate(given)], "audit_id string, i int, confidence string")
    assert [r.normalised for r in audits.normalise_confidence(rows).orderBy("i").collect()] == want


def test_stale_audits_are_refused(spark):
    rows = spark.createDataFrame([(1, 2)], "text_id int, cluster_version int")
    assert audits.reject_stale(rows, 2).count() == 1
    with pytest.raises(Exception, match="not of version"):
        audits.reject_stale(rows, 3).collect()


def test_audit_update_counts_an_audit_once(spark):
    c = spark.createDataFrame(CLUSTERS, taxonomy.SCHEMA)
    rows = spark.createDataFrame([("x", 1, "1", "c3", 5.0), ("x", 1, "2", "c3", 2.0), ("x", 1, "9", "", None)], "audit_id string, cluster_version int, text_id string, cluster_id string, confidence double")
    got = {r.cluster_id: r for r in audits.update_from_audits(c, rows.union(rows), 1).collect()}
    assert (got["c3"].audit_assignments, got["c3"].audit_mean_confidence, got["c3"].status) == (2, 3.5, "audited")
    assert got["c1"].audit_mean_confidence == 4.5


def cells(spark, a, b):
    rows = [("a", "b", x, y) for x, y in zip(a, b)]
    return agreement.contingency(spark.createDataFrame(rows, "a string, b string, ca int, cb int"), ["a", "b"])


def test_scores_of_equal_and_crossed_partitions(spark):
    same = cells(spark, [0, 0, 1, 1, 2], [5, 5, 7, 7, 9])
    s = agreement.partition_scores(same, ["a", "b"]).first()
    assert s.ari == pytest.approx(1) and s.nmi == pytest.approx(1)
    assert agreement.cluster_entropy(same, ["a", "b"]).count() == 0
    crossed = cells(spark, [0, 0, 1, 1], [0, 1, 0, 1])
    assert agreement.partition_scores(crossed, ["a", "b"]).first().ari <= 0
    assert agreement.cluster_entropy(crossed, ["a", "b"]).count() == 4
    assert agreement.partition_scores(cells(spark, [0, 0], [1, 1]), ["a", "b"]).first().ari == 1


def test_last_cluster_of_a_text_counts(spark):
    rows = spark.createDataFrame([("p", 1, "x", 0), ("p", 1, "y", 1)], "proposal string, text_id int, cluster string, ord int")
    assert agreement.membership(rows).first().cluster == "y"


def test_assignment_equals_permutations():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        w = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        got = evaluation.best_assignment(w)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used)) == min(n, m)
        short, long = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum(w[i][j] if n <= m else w[j][i] for i, j in zip(short, p)) for p in itertools.permutations(long, len(short)))
        assert sum(w[i][j] for i, j in enumerate(got) if j >= 0) == best


def test_accuracy_of_nothing(spark):
    assert evaluation.hungarian_accuracy(cells(spark, [], []) if False else spark.createDataFrame([], "ca int, cb int, n long")).first().acc == 0.0


def test_taxonomy_changes(spark):
    state = taxonomy.Taxonomy(spark.createDataFrame(CLUSTERS, taxonomy.SCHEMA), 3, 0.9, 4.0)
    merged = state.apply({"type": "merge", "targets": ["c2", "c77"], "merge_into": "c1"})
    row = {r.cluster_id: r for r in merged.clusters.collect()}
    assert merged.version == 4 and merged.coverage is None and set(row) == {"c1", "c3"}
    assert row["c1"].evidence == ["1", "2", "3"] and row["c1"].audit_assignments == 6 and row["c1"].audit_mean_confidence == pytest.approx(4.0)
    with pytest.raises(KeyError):
        state.apply({"type": "merge", "targets": ["c2"], "merge_into": "c9"})
    split = state.apply({"type": "split", "targets": ["c1"], "split_into": [{"name": "a", "text_ids": [1]}, {"name": "b", "text_ids": [2]}]})
    assert {r.cluster_id: r.evidence for r in split.clusters.collect()}["c4"] == ["2"]
    for ids in ([[1], [1, 2]], [[1]], [[1], [2, 9]]):
        with pytest.raises(ValueError, match="exactly once"):
            state.apply({"type": "split", "targets": ["c1"], "split_into": [{"name": "x", "text_ids": i} for i in ids]})
    renamed = state.apply({"type": "rename", "targets": ["c1"], "rename_to": "Money"})
    assert renamed.version == 3 and renamed.coverage == 0.9
    assert state.apply({"type": "add", "new_cluster": {"name": "n", "example_ids": [7]}}).clusters.filter("cluster_id = 'c4'").count() == 1
    assert state.apply({"type": "remove", "targets": ["c3"]}).clusters.count() == 2
    assert state.apply({"type": "no_change", "rejected_hypothesis": "h"}).rejected == ("h",)
    with pytest.raises(ValueError):
        state.apply({"type": "other"})


def test_descriptions_match_by_id_then_by_unique_name(spark):
    c = spark.createDataFrame([*CLUSTERS, ("c5", "other ", "d5", [], 0, None, "")], taxonomy.SCHEMA)
    u = spark.createDataFrame([("c1", "New", "x"), (None, " LOGIN", "y"), (None, "Other", "z")], "cluster_id string, name string, description string")
    got = {r.cluster_id: (r.name, r.description) for r in taxonomy.update_descriptions(c, u).collect()}
    assert got == {"c1": ("New", "x"), "c2": ("Login", "y"), "c3": ("Other", "d3"), "c5": ("other ", "d5")}


def test_files_fill_greedily(spark):
    r = spark.createDataFrame([(f"k{i:02d}", "x" * n) for i, n in enumerate([4, 4, 9, 1, 1, 1])], "custom_id string, request string")
    assert [x.file for x in annotate.byte_chunks(r, 2, 10).orderBy("custom_id").collect()] == [0, 0, 1, 2, 2, 3]


def test_responses(spark):
    lines = ['{"custom_id":"a","response":{"status_code":200,"body":{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":9,"completion_tokens":2,"prompt_tokens_details":{"cached_tokens":4}}}}}', '{"custom_id":"b","response":{"status_code":500}}', "not json"]
    got = {r.custom_id: r for r in annotate.parse_responses(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert (got["a"].content, got["a"].input_tokens, got["a"].cache_tokens, got["a"].failed) == ("hi", 5, 4, False)
    assert got["b"].failed and got[None].failed


def test_offline_provider(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "i int, prompt string")
    assert {r.i: r.content for r in annotate.annotate(df, lambda s: s.str.upper(), "prompt").collect()} == {1: "AB", 2: "C"}


def test_fallback_none(spark):
    r = spark.createDataFrame([(0, 3), (1, None)], "ord int, cid int")
    assert sorted(x.cid for x in annotate.with_fallback(r, F.col("cid").isNotNull(), "cid", "ord", "none").collect()) == [-1, 3]


def test_farthest_first(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in sampling.diverse_sample(v, 3, 0).orderBy("pick").collect()] == [0, 3, 2]
    assert sampling.diverse_sample(v, 9, 0).count() == 4


def test_density(spark):
    rng = random.Random(1)
    rows = [(i, [c[0] + rng.gauss(0, 0.01), c[1] + rng.gauss(0, 0.01), c[2]]) for i, c in enumerate([(1.0, 0.0, 0.0)] * 40 + [(0.0, 1.0, 0.0)] * 40 + [(0.5, 0.5, 0.9)])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in density.density_topics(v, least=15).collect()}
    assert len({got[i] for i in range(40)}) == 1 and len({got[i] for i in range(40, 80)}) == 1 and got[0] != got[41]


def test_single_label_and_blank(spark):
    assert corpus.single_label(spark.createDataFrame([([1],), ([1, 2],), ([],)], "labels array<int>"), "labels").count() == 1
    assert [r.text for r in corpus.drop_blank(spark.createDataFrame([(" a ",), (" ",)], "text string")).collect()] == ["a"]


def test_one_text_has_its_length_as_p95(spark):
    r = corpus.length_stats(spark.createDataFrame([("abcd",)], "text string")).first()
    assert (r.p95_length, r.min_length, r.max_length) == (4, 4, 4)


def test_running_mean_keeps_its_history(spark):
    c = spark.createDataFrame([("c1", "Billing", "", [], 10, 5.0, "audited"), ("c2", "Login", "", [], 3, 2.0, "proposed")], taxonomy.SCHEMA)
    rows = spark.createDataFrame([("x", 1, "1", "c1", 1.0), ("x", 1, "2", "c1", None), ("x", 1, "3", "c2", None)], "audit_id string, cluster_version int, text_id string, cluster_id string, confidence double")
    got = {r.cluster_id: (r.audit_assignments, r.audit_mean_confidence, r.confidence, r.status) for r in audits.update_from_audits(c, rows, 1).collect()}
    assert got == {"c1": (11, 4.64, "high", "audited"), "c2": (3, 2.0, "low", "proposed")}


def test_responses_resolve_by_json_values(spark):
    labels = one(spark, ["art", "sport"]).withColumnRenamed("i", "ord").withColumnRenamed("x", "label")
    given = {'{"x":"sport","a":"artful"}': "sport", '{"art":"none"}': "<hallucinated>", "not json here": "<unparseable>", "about sport": "sport", '"art"': "art", "null": "<unparseable>", '{"a":"artful"}': "art", "": "<unparseable>", '["sport"]': "sport", "7": "<hallucinated>", None: "<unparseable>", "{}": "<hallucinated>"}
    got = annotate.resolve_labels(one(spark, list(given)), labels, "i", "x").orderBy("i").collect()
    assert [r.label for r in got] == list(given.values())


def test_merged_labels(spark):
    given = ['ok {"l": ["a", "b", "a"]} bye', '{"l": [["a", "b"], "c", ""], "m": ["z"]}', "none", '{"l": "a"}', '{"l": [', None]
    got = annotate.merged_labels(one(spark, given), "i", "x").orderBy("i").collect()
    assert [r.labels for r in got] == [["a", "b"], ["a", "b", "c"], None, None, None, None]


def test_merge_counts_only_sources_with_a_mean(spark):
    c = spark.createDataFrame([("c1", "A", "", ["1"], 4, 4.0, "audited"), ("c2", "B", "", ["2"], 5, None, "proposed"), ("c3", "C", "", [], 2, 1.0, "audited")], taxonomy.SCHEMA)
    r = taxonomy.merge_clusters(c, "c1", ["c2", "c3"]).first()
    assert (r.audit_assignments, r.audit_mean_confidence, r.evidence) == (6, 3.0, ["1", "2"])
