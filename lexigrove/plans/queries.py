"""One query per operator, over tables that stand in for corpora, proposals, audits and predictions.

Proposals are labelings of ``documents``, each with gaps; audits are ``labels``; gold is ``embeddings.label`` and the
prediction its nearest centroid. All derivations are arithmetic that SQL shares. Doubles are rounded to 6 digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import agreement_label, doc_id_format, preview, token_cap
from lexigrove.operators import agreement, annotate, audits, corpus, density, evaluation, methods, sampling, taxonomy, tfidf, topicgen, topics
from lexigrove.session import shared_folder

PROPOSALS = (("p1", "lang", 0), ("p2", "source", 1), ("p3", "concat('b', cast(n_chars div 1000 as string))", 2))
PRICES = (0.125, 0.0125, 1.0)
VERSION = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """One scan: each document is a row a proposal, but for those in its gap."""
    each = F.array(*(F.struct(F.lit(p).alias("p"), F.expr(c).alias("c"), F.lit(gap).alias("gap")) for p, c, gap in PROPOSALS))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.explode(each).alias("x"))
    rows = rows.filter("text_id % 5 <> x.gap").select(F.col("x.p").alias("proposal"), "text_id", F.col("x.c").alias("cluster"), F.lit(0).alias("ord"))
    return agreement.membership(rows)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return agreement.paired(proposals(spark, d))


def assignments(spark: SparkSession, d: str) -> DataFrame:
    cluster = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), (F.col("quality") * 2 + F.col("toxic")).cast("string")))
    confidence = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(1 + F.col("doc_id") % 5)
    return table(spark, d, "labels").select((F.col("doc_id") % 4).alias("audit_id"), (F.col("doc_id") % 4 % 2).cast("int").alias("cluster_version"), F.col("doc_id").alias("text_id"), cluster.alias("cluster_id"), confidence.cast("double").alias("confidence"))


def clusters(spark: SparkSession) -> DataFrame:
    rows = [("c0", "junk", "poor and clean"), ("c1", "rude junk", "poor and toxic"), ("c2", "prose", "good and clean"), ("c9", "none such", "never assigned")]
    return spark.createDataFrame([(a, b, c, [], 0, None, "proposed") for a, b, c in rows], taxonomy.SCHEMA)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, predicted, seed): the nearest label centroid; a seventh are outliers (-1)."""
    v = vectors(spark, d)
    near = evaluation.nearest_centroid(v, evaluation.centroids(v, "label"), "vec_id").select("vec_id", F.col("label").alias("near"))
    guess = F.when(F.col("vec_id") % 7 == 0, F.lit(-1)).otherwise(F.when(F.col("vec_id") % 3 == 0, F.col("near") % 4).otherwise(F.col("near")))
    return v.select("vec_id", "label").join(near, "vec_id").select("vec_id", "label", guess.cast("int").alias("predicted"), (F.col("vec_id") % 2).cast("int").alias("seed"))


# ---------------------------------------------------------------- corpus


def q01_doc_id_format(spark, d):
    return table(spark, d, "documents").select("doc_id", doc_id_format("docs", F.col("lang"), F.col("doc_id")).alias("name"))


def q02_none_mapping(spark, d):
    rows = table(spark, d, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("k")).withColumn("n", F.concat(F.lit("k"), F.col("k").cast("string")))
    return corpus.map_none(rows, "k", "n", 1).select("doc_id", "gold_label_id", "gold_label_name", "is_none")


def q02b_label_compaction(spark, d):
    return corpus.compact_labels(table(spark, d, "documents").select(F.when(F.col("source") == "src3", corpus.NONE_NAME).otherwise(F.col("source")).alias("source"), "doc_id"), "source", "doc_id")


def q03_token_cap(spark, d):
    text, cut = token_cap(F.col("text"), 50)
    return table(spark, d, "documents").select("doc_id", text.alias("capped"), cut.alias("truncated"))


def q04_dataset_validation(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic") - 1).cast("int").alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id", "left").withColumn("is_none", F.coalesce(F.col("label") == -1, F.lit(False)))
    return corpus.validate_dataset(docs, "doc_id", "text", "label", "is_none", 4)


def q05_corpus_alignment(spark, d):
    return corpus.check_aligned(table(spark, d, "documents").withColumnRenamed("doc_id", "i"), table(spark, d, "benchmark").withColumnRenamed("item_id", "i"), "i", "text")


def q06_corpus_length_stats(spark, d):
    return corpus.length_stats(table(spark, d, "documents"))


def q07_unseen_candidates(spark, d):
    return sampling.unseen(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"))


def q07b_seen_union(spark, d):
    return sampling.seen_union(table(spark, d, "labels"), table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")))


def q08_fetch_by_ids(spark, d):
    return sampling.fetch_by_ids(table(spark, d, "documents"), [5, 3, 5, 99_999_999, 42])


def q09_dataset_meta(spark, d):
    return rounded(corpus.dataset_meta(table(spark, d, "documents"), ["lang"], F.col("source") == "src3"), "mean_text_chars", "share_none")


# ---------------------------------------------------------------- audits


def q10_confidence_normalise(spark, d):
    i = F.col("doc_id")
    k = F.floor(i / 8)
    scale = F.when(i % 8 == 0, 1.0 + k % 5).when(i % 8 == 1, k % 5 / 4.0).when(i % 8 == 2, F.lit(1.0)).when(i % 8 == 3, k % 2 + 0.0).when(i % 8 == 4, F.lit(0.0)).when(i % 8 == 5, k % 3 - 1.0).when(i % 8 == 6, k % 15 / 2.0)
    rows = table(spark, d, "labels").select((i % 8).alias("audit_id"), i.alias("text_id"), scale.cast("double").alias("confidence"))
    return audits.normalise_confidence(rows)


def q11_assignment_stats(spark, d):
    return rounded(audits.assignment_stats(assignments(spark, d), ["audit_id"]), "mean_confidence", "coverage")


def q12_size_distribution(spark, d):
    return rounded(audits.size_distribution(audits.cluster_counts(assignments(spark, d), ["audit_id"]), ["audit_id"]), "mean_size")


def q13_audit_metrics_report(spark, d):
    return rounded(audits.metrics_report(audits.current_version(assignments(spark, d), VERSION), clusters(spark)), "mean_confidence")


def q13b_confidence_histogram(spark, d):
    return audits.confidence_histogram(assignments(spark, d))


def q14_audit_update(spark, d):
    """Clusters with audits before (a mean and a count, or none) and new ones."""
    before = spark.createDataFrame([("c0", 10, 5.0), ("c2", 4, 2.5), ("c9", 7, 3.0)], "cluster_id string, audit_assignments long, audit_mean_confidence double")
    old = clusters(spark).drop("audit_assignments", "audit_mean_confidence").join(before, "cluster_id", "left").fillna(0, ["audit_assignments"])
    return audits.update_from_audits(old, assignments(spark, d), VERSION)


# ---------------------------------------------------------------- agreement


def q15_common_texts(spark, d):
    return pairs(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_common"), F.count_if(F.col("ca") < F.col("cb")).alias("n_less"))


def q16_contingency(spark, d):
    return agreement.contingency(pairs(spark, d), ["a", "b"])


def q16b_agreement_rate(spark, d):
    return rounded(agreement.agreement_rate(agreement.contingency(pairs(spark, d), ["a", "b"]), ["a", "b"]), "agreement")


def q17_high_entropy_clusters(spark, d):
    e = agreement.cluster_entropy(agreement.contingency(pairs(spark, d), ["a", "b"]), ["a", "b"])
    return rounded(agreement.top_entropy(e, ["a", "b"], 10), "entropy")


def q18_ari_nmi(spark, d):
    return rounded(agreement.partition_scores(agreement.contingency(pairs(spark, d), ["a", "b"]), ["a", "b"]), "ari", "nmi")


def q19_hungarian_acc(spark, d):
    cells = agreement.contingency(predicted(spark, d), [], "label", "predicted")
    return rounded(evaluation.hungarian_accuracy(cells, "label", "predicted"), "acc")


def q20_agreement_summary(spark, d):
    s = agreement.agreement_summary(agreement.partition_scores(agreement.contingency(pairs(spark, d), ["a", "b"]), ["a", "b"]))
    return rounded(s.withColumn("label", agreement_label(F.col("mean_ari"))), "mean_ari")


def q21_element_similarity(spark, d):
    return rounded(agreement.element_similarity(pairs(spark, d)), "similarity")


def q22_inconsistent_preview(spark, d):
    least = agreement.element_similarity(pairs(spark, d)).orderBy(F.round("similarity", 10), "text_id").limit(20)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), preview(F.col("text")).alias("preview"))
    return rounded(texts.join(F.broadcast(least), "text_id").select("text_id", "similarity", "preview"), "similarity")


# ---------------------------------------------------------------- sampling and search


def q23_diverse_sample(spark, d):
    return rounded(sampling.diverse_sample(vectors(spark, d), 8, 0), "distance")


def _query(spark, d) -> str:
    return table(spark, d, "documents").filter("doc_id = 7").select(F.col("text").alias("q")).first().q


def q24_tfidf_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rounded(tfidf.TfidfIndex(docs).search(_query(spark, d), 20), "similarity")


def q24b_targeted_sample(spark, d):
    candidates = sampling.unseen(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))
    return rounded(tfidf.targeted_sample(candidates, _query(spark, d), 15), "similarity")


def q44_random_sample(spark, d):
    return sampling.random_sample(table(spark, d, "documents"), 25, 42).select("doc_id", "source")


def q45_cluster_sample(spark, d):
    rows = audits.current_version(assignments(spark, d), VERSION)
    return sampling.cluster_sample(table(spark, d, "documents"), rows, "c2", 10, 7).select("doc_id", "lang")


# ---------------------------------------------------------------- taxonomy


def q25_set_clusters(spark, d):
    docs = table(spark, d, "documents")
    new = docs.groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("ord")).withColumn("description", F.concat(F.lit("from "), F.col("name"))).withColumn("ids", F.when(F.col("ord") % 2 == 0, F.array(F.col("ord").cast("string"))))
    old = spark.createDataFrame([("c4", " SRC2 ", "", ["7", "8"], 0, None, ""), ("c11", "src5", "", ["9"], 0, None, ""), ("c6", "gone", "", [], 0, None, "")], taxonomy.SCHEMA)
    return taxonomy.set_clusters(old, new).select("ord", "cluster_id", "name", "description", F.array_join("evidence", ",").alias("evidence"))


def q26_finalize_examples(spark, d):
    rows = audits.current_version(assignments(spark, d), VERSION)
    return taxonomy.finalize(clusters(spark), audits.audit_examples(rows, 5), table(spark, d, "documents"), 5).select("cluster_id", "name", "pos", "text_id", F.length("text").alias("n_chars"))


def _evidence(spark, d) -> DataFrame:
    """Clusters c0..c3 of labels, with ids as evidence and counters from audits."""
    rows = table(spark, d, "labels").withColumn("cluster_id", F.concat(F.lit("c"), (F.col("quality") * 2 + F.col("toxic")).cast("string")))
    c = rows.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")).alias("evidence"), F.count(F.lit(1)).alias("audit_assignments"), F.avg(1.0 + F.col("doc_id") % 5).alias("audit_mean_confidence"))
    return c.select("cluster_id", F.concat(F.lit("name "), "cluster_id").alias("name"), F.lit("").alias("description"), "evidence", "audit_assignments", "audit_mean_confidence", F.lit("audited").alias("status"))


def q27_merge_clusters(spark, d):
    m = taxonomy.merge_clusters(_evidence(spark, d), "c3", ["c1", "c0"], "merged")
    return rounded(m.select("cluster_id", "name", F.array_join("evidence", ",").alias("evidence"), "audit_assignments", "audit_mean_confidence", "status"), "audit_mean_confidence")


def q28_split_check(spark, d):
    labels = table(spark, d, "labels")
    parent = labels.filter("quality = 1 and toxic = 1").select(F.col("doc_id").alias("text_id"))
    i = F.col("doc_id")
    buckets = labels.filter("toxic = 1").select(i.alias("text_id"), F.explode(F.when(i % 6 == 0, F.array(F.lit(0), F.lit(1))).when(i % 5 != 0, F.array((i % 2).cast("int")))).alias("bucket"))
    return taxonomy.check_split(parent, buckets)


# ---------------------------------------------------------------- annotation


def q29_chat_requests(spark, d):
    chunks = annotate.numbered_chunks(table(spark, d, "documents").select("doc_id", "text"), 15, 0)
    return annotate.chat_requests(chunks, "small-model", "Name a topic for each text.")


def q29b_request_files(spark, d):
    """Files of few requests, so that there are many on small tables too."""
    return annotate.byte_chunks(q29_chat_requests(spark, d), 10, 2_500_000)


def q30_label_union(spark, d):
    labels = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 9 == 0, F.lit("unknown_topic 1")).otherwise(F.concat_ws("/", "lang", "source")).alias("label"))
    return annotate.label_union(labels)


def _answers(spark, d) -> DataFrame:
    """conversations as responses: (id, text, ord)."""
    c = table(spark, d, "conversations")
    k = F.col("turn") % 5
    objects = F.when(F.col("conv_id") % 2 == 0, F.lit('{"x": "artful theme", "a": "qu"}')).otherwise(F.concat(F.lit('{"the": "'), "role", F.lit('"}')))
    text = F.when(k == 4, F.lit("")).when(k == 3, objects).when(k == 2, F.concat(F.lit('"'), "role", F.lit('"'))).otherwise(F.col("text"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", text.alias("text"))


def _names(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(["the", "th", "de", "en", "er", "qu"])), "ord int, label string")


def q31_response_resolution(spark, d):
    return annotate.resolve_labels(_answers(spark, d), _names(spark), "id", "text")


def q30b_merged_labels(spark, d):
    """Label lists as a merge step answers them: in prose, nested, with repeats, or broken."""
    k = F.col("conv_id") % 4
    said = F.when(k == 0, F.concat(F.lit('Sure: {"labels": ["b", "'), "role", F.lit('", "b"]} done'))).when(k == 1, F.concat(F.lit('{"a": [["x", "'), "role", F.lit('"], "x", ""], "b": 1}')))
    said = said.when(k == 2, F.lit('{"a": "no list"}')).otherwise(F.lit('{"a": [broken'))
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), said.alias("text"))
    return annotate.merged_labels(rows, "id", "text").select("id", F.array_join("labels", "|").alias("labels"))


def q31b_correction_targets(spark, d):
    r = annotate.resolve_labels(_answers(spark, d), _names(spark), "id", "text")
    return annotate.correction_counts(r, F.col("label") == annotate.UNPARSEABLE, F.col("label") == annotate.HALLUCINATED)


def q31c_topic_fallback(spark, d):
    rows = _answers(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.lit("no topic")).otherwise(F.concat(F.lit("[1] "), F.when(F.col("id") % 4 == 1, F.lit("Zzz")).otherwise(F.col("role")), F.lit(": it is\n[2] Café & co: no"))).alias("text"))
    names = spark.createDataFrame([(0, "user"), (1, "assistant"), (2, "Café & co")], "ord int, label string")
    topics = annotate.first_valid_topic(rows, names, "id", "text")
    return annotate.with_fallback(topics, F.col("topic").isNotNull(), "topic", "id")


def _triplets(spark, d) -> DataFrame:
    i = F.col("vec_id")
    return vectors(spark, d).select(i.alias("query_idx"), ((i * 7 + 1) % 100).alias("choice1_idx"), ((i * 3 + 2) % 100).alias("choice2_idx"))


def q32_triplet_resume(spark, d):
    t = _triplets(spark, d)
    return annotate.pending(t, t.join(table(spark, d, "labels").select(F.col("doc_id").alias("query_idx")), "query_idx", "left_semi"))


def q32b_triplet_convert(spark, d):
    q = F.col("query_idx")
    said = F.when(q % 4 == 0, F.array(F.lit("Choice 1"))).when(q % 4 == 1, F.array(F.lit("I say Choice 2."))).when(q % 4 == 2, F.array(F.lit("Choice 1 or Choice 2"))).otherwise(F.array(F.lit("Choice 1"), F.lit("Choice 1")))
    return annotate.training_triplets(_triplets(spark, d).withColumn("prediction", said))


def q33_output_validation(spark, d):
    e = table(spark, d, "events")
    body = F.when(F.col("event_id") % 10 == 0, F.lit("not json")).otherwise(F.col("props"))
    kind = F.when(F.col("event_id") % 3 == 0, "audits").when(F.col("event_id") % 3 == 1, "proposals").otherwise("other")
    v = annotate.validate_outputs(e.select("event_id", kind.alias("kind"), body.alias("body")), {"audits": ["k"], "proposals": ["k", "clusters"]})
    return v.select("event_id", "valid", "missing")


def q34_predictions(spark, d):
    i = F.col("doc_id")
    cluster = F.when(i % 5 == 0, F.lit("none")).when(i % 5 == 1, F.lit("")).otherwise((F.col("quality") * 2 + F.col("toxic")).cast("string"))
    rows = table(spark, d, "labels").select("doc_id", cluster.alias("cluster"), (1 + i % 5).cast("double").alias("confidence"), F.lit(0).alias("ord"))
    again = rows.filter("doc_id % 10 = 7").withColumn("cluster", F.lit("3")).withColumn("ord", F.lit(1))
    return rounded(evaluation.predictions(table(spark, d, "documents").select("doc_id", "lang"), rows.union(again), "ord").select("doc_id", "lang", "predicted_cluster_id", "confidence"), "confidence")


def q46_match_responses(spark, d):
    a = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("custom_id"))
    b = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("custom_id")).distinct()
    return annotate.match_responses(a, b)


# ---------------------------------------------------------------- tables and methods


def q35_best_cells(spark, d):
    p = predicted(spark, d)
    runs = None
    for method, guess in (("nearest", F.col("predicted")), ("fixed", (F.col("vec_id") % 4).cast("int"))):
        cells = agreement.contingency(p.select("seed", "label", guess.alias("g")), ["seed"], "label", "g")
        scores = agreement.partition_scores(cells, ["seed"], "label", "g").select(F.lit("given-k").alias("panel"), F.lit(method).alias("method"), F.lit("embeddings").alias("dataset"), "seed", "ari", "nmi")
        runs = scores if runs is None else runs.union(scores)
    return rounded(evaluation.best_cells(runs, ["ari", "nmi"]), "value")


def q36_predicted_k(spark, d):
    return evaluation.predicted_k(predicted(spark, d), ["seed"], "predicted")


def q37_token_cost(spark, d):
    n = F.length("text").cast("long")
    rows = table(spark, d, "conversations").select("role", n.alias("input_tokens"), F.when(F.col("turn") > 0, n).otherwise(F.lit(0)).alias("cache_tokens"), F.floor(n / 3).alias("output_tokens"))
    return rounded(evaluation.token_cost(annotate.usage_totals(rows, ["role"]), PRICES), "usd", "cache_hit_rate")


def q38_texts_sha256(spark, d):
    return corpus.texts_sha256(table(spark, d, "documents"), ["lang"], "text", "doc_id")


def q39_recent_log(spark, d):
    return evaluation.recent(table(spark, d, "events").select("event_id", "ts", "event_type"), ["ts", "event_id"], 5).select("event_id", "event_type")


def q40_lda(spark, d):
    return rounded(methods.lda(table(spark, d, "documents").select("doc_id", "text"), 5), "confidence")


def q41_kmeans(spark, d):
    return methods.kmeans(vectors(spark, d), 10)


def q42_c_tf_idf(spark, d):
    return rounded(tfidf.class_tfidf(table(spark, d, "documents").select("lang", "text"), "lang", 10), "score")


def q43_nearest_centroid(spark, d):
    v = vectors(spark, d)
    return rounded(evaluation.nearest_centroid(v, evaluation.centroids(v, "label"), "vec_id"), "similarity")


def q47_density_clusters(spark, d):
    return density.density_topics(vectors(spark, d))


def q47b_reduced_topics(spark, d):
    """Topics by language and source, brought down to six with the outliers."""
    name = F.concat_ws("/", "lang", "source")
    topic = F.when(F.col("source") == "src3", F.lit(-1)).otherwise(F.pmod(F.crc32(name), F.lit(1000))).cast("int")
    return topics.reduce_topics(table(spark, d, "documents").select("doc_id", "text", topic.alias("cluster")), 6)


def q47c_assigned_outliers(spark, d):
    """Every seventh vector an outlier, given to the nearest label."""
    v = vectors(spark, d)
    return topics.assign_outliers(v.select("vec_id", F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).alias("cluster")), v, "vec_id")


def q48_entropy_triplets(spark, d):
    v = vectors(spark, d)
    return methods.entropy_triplets(v, v.select("vec_id", "label"), cap=0.05)  # unit vectors


# ---------------------------------------------------------------- corpora, tables and checks


def q24c_stored_search(spark, d):
    root = f"{shared_folder(spark)}/lexigrove/tfidf-{uuid.uuid4().hex}"
    return rounded(tfidf.StoredIndex.write(table(spark, d, "documents").select("doc_id", "text"), root).search(_query(spark, d), 20), "similarity")


def q50_label_space(spark, d):
    docs = table(spark, d, "documents")
    return corpus.label_space([docs.select(F.col("lang").alias("name")), docs.select(F.col("source").alias("name")), table(spark, d, "conversations").select(F.col("role").alias("name"))], "name")


def q51_concatenated_splits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    return corpus.concatenated({"train": docs, "test": table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")})


def q52_single_label_counts(spark, d):
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("labels"))
    return corpus.single_label_counts(roles, "labels")


def q53_triplet_texts(spark, d):
    return annotate.triplet_texts(_triplets(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text"))


def q54_label_ids(spark, d):
    rows = annotate.resolve_labels(_answers(spark, d), _names(spark), "id", "text")
    return evaluation.label_ids(rows, _names(spark), {annotate.UNPARSEABLE: "unparseable", annotate.HALLUCINATED: "hallucinated"}).select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "status")


def q55_results_table(spark, d):
    return evaluation.results_table(q35_best_cells(spark, d), ["embeddings"], ["ari", "nmi"])


def q56_cost_totals(spark, d):
    cells = table(spark, d, "documents").select(F.col("source").alias("method"), (F.col("n_chars") / 8).alias("usd"), F.when(F.col("lang") == "en", F.col("n_chars") / 16).alias("subscription_usd"))
    return evaluation.cost_totals(cells.select("method").union(spark.createDataFrame([("none run",)], "method string")), cells)


def q57_accumulated_usage(spark, d):
    n = F.length("text").cast("long")
    rows = table(spark, d, "conversations").select("conv_id", "turn", n.alias("input_tokens"), F.when(F.col("turn") > 0, n).otherwise(F.lit(0)).alias("cache_tokens"), F.floor(n / 3).alias("output_tokens"))
    out = evaluation.accumulated_usage(rows, "conv_id", "turn").withColumn("passes", F.array_join(F.transform("passes", lambda p: p.input_tokens.cast("string")), ","))
    return rounded(out, "cache_hit_rate")


def q58_display_labels(spark, d):
    return predicted(spark, d).select("vec_id", evaluation.display_label(F.col("predicted")).alias("display"))


def q59_weak_clusters(spark, d):
    rows = assignments(spark, d).withColumn("confidence", F.when(F.col("cluster_id") == "c2", F.lit(2.0)).otherwise(F.col("confidence")))
    return rounded(audits.weak_clusters(audits.metrics_report(rows, clusters(spark))), "mean_confidence")


def q60_cluster_problems(spark, d):
    k = F.col("doc_id") % 5
    body = F.when(k == 0, F.lit("[1]")).when(k == 1, F.concat(F.lit('{"name": "'), "lang", F.lit('", "description": "d"}'))).when(k == 2, F.lit('{"name": "  ", "description": "d"}')).when(k == 3, F.lit('{"name": "n", "description": 3}')).otherwise(F.lit("{broken"))
    return annotate.cluster_problems(table(spark, d, "documents").select("doc_id", body.alias("body")), "body").select("doc_id", "problem")


def q61_first_rows(spark, d):
    return sampling.first_rows(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 20)


def q62_merged_or_given(spark, d):
    """Answers of which every second is a list; the rest keep the list that was to be merged."""
    said = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"l": ["m", "'), "role", F.lit('"]}'))).otherwise(F.lit("sorry"))
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), said.alias("text"), F.array(F.lit("a"), F.col("role")).alias("given"))
    return annotate.merged_or_given(rows, "id", "text", "given").select("id", F.array_join("labels", "|").alias("labels"))


def q63_topic_words(spark, d):
    return rounded(methods.topic_words(table(spark, d, "documents").select("doc_id", "text"), 5), "weight")


# ---------------------------------------------------------------- topics by a provider


def _length_topic(asked: list[str]) -> list[str]:
    """A provider without a model: a text's topic is its length in thousands."""
    sizes = [len(p.partition("\nText:\n")[2]) // 1000 for p in asked]
    return [f"[1] Length {k}: texts of {k} thousand characters" for k in sizes]


def q64_topic_generation(spark, d):
    root = f"{shared_folder(spark)}/generation-{uuid.uuid4().hex}"
    made = topicgen.TopicGeneration(spark, root, "Topics:\n{Topics}\nText:\n{Document}", _length_topic, early_stop=200, size=500)
    made.run(table(spark, d, "documents"))
    return made.topics()


def q65_refined_topics(spark, d):
    k = F.floor(F.length("text") / 1000)
    rows = table(spark, d, "documents").filter("text is not null").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    every = rows.agg(F.max("k").alias("most")).select(F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("k"))
    name = lambda x: F.concat(F.lit("Length "), x.cast("string"))
    merges = every.filter("k % 3 <> 0").select(name(F.col("k")).alias("old"), name(F.col("k") - 1).alias("new"), F.lit("merged").alias("description"))
    kept, _ = topicgen.refined(rows.select(name(F.col("k")).alias("topic"), F.lit("own").alias("description"), "n", "first"), merges, 0.01)
    return kept.select("topic", "n", "first")


def q66_topic_correction(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    i, cid = F.col("doc_id"), F.col("doc_id").cast("string").alias("custom_id")
    named = lambda x: F.concat(F.lit("[1] T"), x.cast("string"), F.lit(": why"))
    known = docs.select(F.concat(F.lit("T"), (i % 5).cast("string")).alias("topic")).distinct()
    said = docs.filter("doc_id % 6 <> 0").select(cid, F.when(i % 11 == 0, "no line").otherwise(named(i % 7)).alias("response"))
    rows = topicgen.to_correct(topicgen.assigned(docs, said), known)
    again = rows.filter("error or hallucinated").filter("doc_id % 3 <> 1").select(cid, F.when(i % 2 == 0, named(i % 2)).otherwise(topicgen.ERROR).alias("response"))
    return topicgen.to_correct(topicgen.corrected(rows.drop("error", "hallucinated"), again), known)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}
