"""Datasets and method cells end to end: read, check, run, score, write."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.operators import agreement, corpus, density, evaluation, methods, topics
from lexigrove.sources.corpus import write_dataset

#: Method -> (documents or vectors, k, seed) -> (key, cluster).
METHODS: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {
    "lda": lambda df, k, seed: methods.lda(df, k, seed).select("doc_id", F.col("topic").alias("cluster")),
    "kmeans": lambda df, k, seed: methods.kmeans(df, k, seed, key="doc_id"),
    "density": lambda df, k, seed: density.density_topics(df, key="doc_id"),
    "density-given-k": lambda df, k, seed: topics.density_method(df, k),
}


def process_dataset(docs: DataFrame, root: str, k: int, none: Column | None = None) -> dict:
    """Documents (columns of a dataset) stripped, checked, written to ``root`` and described. Fails on violations.

    The written rows are read back and compared with the input, as ids and texts must line up.
    """
    ready = corpus.drop_blank(docs)
    corpus.require_valid(corpus.validate_dataset(ready, "doc_id", "text", "gold_label_id", "is_none", k))
    write_dataset(ready, root)
    back = docs.sparkSession.read.schema(ready.schema).json(f"{root}/documents.jsonl")
    aligned = corpus.check_aligned(ready, back, "doc_id", "text").first()
    if aligned.mismatches:
        raise ValueError(f"{aligned.mismatches} rows of {root} differ from their source")
    meta = corpus.dataset_meta(back, [], F.col("is_none") if none is None else none).first().asDict()
    meta["has_none_class"] = meta["n_none"] > 0
    docs.sparkSession.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{root}/meta.json")
    return meta


def run_cell(df: DataFrame, gold: DataFrame, method: str, dataset: str, seed: int, k: int, root: str) -> dict:
    """One method on one dataset: predictions under ``root`` and a meta row with scores, predicted k and seconds.

    ``df`` holds doc_id and text or embedding; ``gold`` (doc_id, label). Documents without a prediction count as outliers.
    """
    began = time.monotonic()
    path = f"{root}/{method}/{dataset}/seed={seed}"
    guess = METHODS[method](df, k, seed).select("doc_id", F.col("cluster").alias("predicted_cluster_id"))
    guess = guess.withColumn("display", evaluation.display_label(F.col("predicted_cluster_id")))
    guess.write.mode("overwrite").json(path)
    spent = time.monotonic() - began
    made = df.sparkSession.read.schema(guess.schema).json(path)
    both = gold.join(made, "doc_id", "left").withColumn("predicted_cluster_id", F.coalesce("predicted_cluster_id", F.lit(-1)))
    scores = evaluation.metrics_bundle(agreement.contingency(both, [], "label", "predicted_cluster_id"), "label", "predicted_cluster_id")
    found = evaluation.predicted_k(made, []).first().predicted_k
    meta = {"panel": "given-k", "method": method, "dataset": dataset, "seed": seed, "k": k, "predicted_k": found, "seconds": spent, **scores}
    schema = "panel string, method string, dataset string, seed int, k int, predicted_k long, seconds double, n long, ari double, nmi double, acc double"
    one = df.sparkSession.createDataFrame([tuple(meta[c.split()[0]] for c in schema.split(", "))], schema)
    one.coalesce(1).write.mode("overwrite").json(f"{path}.meta")
    return meta


def run_array(cells: list[tuple[str, str, int]], task: int, run: Callable[[str, str, int], dict]) -> dict:
    """The cell of a task number in an array of jobs."""
    if not 0 <= task < len(cells):
        raise ValueError(f"task {task} of {len(cells)} cells")
    return run(*cells[task])
