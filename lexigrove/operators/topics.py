"""Topics of a density method brought to a number that was asked for, and outliers given to their nearest topic."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators import density, evaluation, tfidf

#: Terms of a topic that count when topics are compared, and the most topics that are merged: the driver holds a matrix of
#: their similarities.
TERMS, MOST_TOPICS = 200, 4_000


def merge_order(distance: np.ndarray, until: int, complete: bool = False, reach: float = float("inf")) -> list[int]:
    """For each row of a distance matrix the least row of its group, when groups are joined until ``until`` are left or the
    next two are farther apart than ``reach``.

    The two groups of the least mean distance (``complete``: the least largest one) join first, ties by the smaller rows. A heap holds a candidate a pair; a
    candidate of a group that has grown since is dropped when it comes up, so nothing in the heap is ever changed.
    """
    n = len(distance)
    far, size, alive, grown = distance.astype(float).copy(), [1] * n, [True] * n, [0] * n
    group = list(range(n))
    heap = [(far[i, j], i, j, 0, 0) for i in range(n) for j in range(i + 1, n)]
    heapq.heapify(heap)
    left = n
    while left > max(until, 1):
        apart, i, j, gi, gj = heapq.heappop(heap)
        if not (alive[i] and alive[j] and grown[i] == gi and grown[j] == gj):
            continue
        if apart > reach:
            break
        both = np.maximum(far[i], far[j]) if complete else (size[i] * far[i] + size[j] * far[j]) / (size[i] + size[j])
        far[i], far[:, i] = both, both
        size[i], alive[j], grown[i], left = size[i] + size[j], False, grown[i] + 1, left - 1
        group = [i if g == j else g for g in group]
        for k in range(n):
            if alive[k] and k != i:
                a, b = min(i, k), max(i, k)
                heapq.heappush(heap, (far[a, b], a, b, grown[a], grown[b]))
    return group


def topic_distances(docs: DataFrame, label: str = "cluster") -> tuple[list[int], np.ndarray]:
    """(topics in order, 1 - cosine of their class-based term weights) of texts (label, text), outliers left out."""
    rows = tfidf.class_tfidf(docs.filter(F.col(label) >= 0), label, TERMS).select(label, "term", "score").collect()  # TERMS a topic
    known = sorted(r[label] for r in docs.filter(F.col(label) >= 0).select(label).distinct().limit(MOST_TOPICS + 1).collect())
    if len(known) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics; raise the least size of a topic")
    at, terms = {t: i for i, t in enumerate(known)}, {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    order = np.argsort([at[r[label]] * len(terms) + terms[r.term] for r in rows])
    norms, dots = np.zeros(len(known)), np.zeros((len(known), len(known)))
    by_term: dict[int, list[tuple[int, float]]] = {}
    for i in order:
        r = rows[i]
        norms[at[r[label]]] += r.score**2
        by_term.setdefault(terms[r.term], []).append((at[r[label]], r.score))
    for held in by_term.values():
        t, w = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        dots[np.ix_(t, t)] += w[:, None] * w
    norms = np.sqrt(np.where(norms > 0, norms, 1.0))
    return known, np.round(1 - dots / norms[:, None] / norms, 12)


def by_size(labels: DataFrame, key: str, label: str = "cluster") -> DataFrame:
    """``labels`` (key, label) with topics numbered from 0 by size, ties by the smallest key; -1 stays."""
    sizes = labels.filter(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    names = sizes.select(F.col(label).alias("old"), (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("new"))
    return labels.join(F.broadcast(names), F.col(label) == F.col("old"), "left").select(key, F.coalesce("new", F.lit(-1)).cast("int").alias(label))


def reduce_topics(docs: DataFrame, asked: int, key: str = "doc_id", label: str = "cluster") -> DataFrame:
    """(key, label): the topics of ``docs`` (key, text, label) joined until ``asked`` are left, outliers counted as one.

    Topics join by the mean distance of their class-based term weights. Fewer topics than asked for stay as they are.
    """
    known, far = topic_distances(docs.select(label, "text"), label)
    group = merge_order(far, asked - 1)
    names = docs.sparkSession.createDataFrame([(t, known[g]) for t, g in zip(known, group, strict=True)], "old int, to int")
    both = docs.select(key, label).join(F.broadcast(names), F.col(label) == F.col("old"), "left")
    return by_size(both.select(key, F.coalesce("to", F.lit(-1)).alias(label)), key, label)


def assign_outliers(labels: DataFrame, vectors: DataFrame, key: str = "doc_id", vector: str = "embedding", label: str = "cluster") -> DataFrame:
    """(key, label): outliers get the topic whose mean vector has the largest cosine with theirs."""
    rows = labels.join(vectors.select(key, vector), key)
    means = evaluation.centroids(rows.filter(F.col(label) >= 0), label, vector)
    near = evaluation.nearest_centroid(rows.filter(F.col(label) < 0).select(key, vector), means, key, vector).select(key, F.col("label").alias("near"))
    return labels.join(near, key, "left").select(key, F.coalesce(F.when(F.col(label) >= 0, F.col(label)), "near", F.lit(-1)).cast("int").alias(label))


def density_method(docs: DataFrame, k: int | None = None, has_none: bool = False, least: int = 10) -> DataFrame:
    """(doc_id, cluster) of ``docs`` (doc_id, text, embedding): the topics found or, given ``k``, brought down to ``k``.

    Without a class for texts of no topic, outliers go to their nearest topic.
    """
    found = density.density_topics(docs, least, key="doc_id")
    asked, assign = evaluation.topics_asked(k or 0, has_none)
    if k is not None:
        found = reduce_topics(docs.select("doc_id", "text").join(found, "doc_id"), asked)
    return assign_outliers(found, docs) if assign else found
