"""Clustering methods: topic model, k-means, entropy-ranked triplets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import tokens
from lexigrove.operators.blocks import matrix, named, nearest, numbered, sound
from lexigrove.operators.evaluation import centroids
from lexigrove.operators.ordered import running
from lexigrove.operators.summed import drawn_starts, fit_topics, lloyd, narrow, topic_of, widened
from lexigrove.operators.tfidf import STOP_WORDS
from lexigrove.operators.topics import merge_order
from lexigrove.scratch import arrow_map, kept, staged


#: Texts of a packed row of words.
PACKED_TEXTS = 4096


def word_counts(docs: DataFrame) -> DataFrame:
    """The words of each row's text but for stop words, each once, and how often they come, ``PACKED_TEXTS`` rows as one.

    (ids, size: how many words each has, code: their places in ``t``, n, t: all words of these texts, df: in how many of
    them, total); size, code and n are bytes of ``narrow``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = pa.array(STOP_WORDS)
        for b in batches:
            for lo in range(0, b.num_rows, PACKED_TEXTS):
                part = b.slice(lo, PACKED_TEXTS)
                lists = part.column("w")
                coded = lists.flatten().dictionary_encode()
                some = max(len(coded.dictionary), 1)
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                both, n = np.unique(owner * some + coded.indices.to_numpy(), return_counts=True)
                owner, code = np.divmod(both, some)
                ok = ~pc.is_in(coded.dictionary, value_set=stop).to_numpy(zero_copy_only=False)
                place = np.cumsum(ok) - 1
                held = ok[code]
                owner, code, n = owner[held], place[code[held]], n[held]
                df, total = np.bincount(code, minlength=int(ok.sum())), np.bincount(code, weights=n, minlength=int(ok.sum())).astype(np.int64)
                bytes_ = [pa.array([narrow(x)], pa.binary()) for x in (np.bincount(owner, minlength=len(lists)), code, n)]
                one = [_lists(np.zeros(len(x), int), 1, x)[0] for x in (part.column("doc_id"), coded.dictionary.filter(pa.array(ok)), pa.array(df), pa.array(total))]
                yield pa.RecordBatch.from_arrays([one[0], *bytes_, *one[1:]], ["ids", "size", "code", "n", "t", "df", "total"])

    schema = f"ids array<{kind}>, size binary, code binary, n binary, t array<string>, df array<bigint>, total array<bigint>"
    return arrow_map(docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("w")), run, schema)


def _lists(owner: np.ndarray, rows: int, *values: pa.Array) -> list[pa.Array]:
    """``values``, whose rows are ``owner`` in order, as a list a row."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def counted(docs: DataFrame, vocabulary: int = 10_000, least: int = 2, share: float = 0.95) -> tuple[DataFrame, list[str]]:
    """((doc_id, term, n): the known terms of each text and how often they come, terms in order).

    Terms are in at least ``least`` texts (1 if that leaves none) and in no more than ``share`` of them, the ``vocabulary``
    most frequent; stop words are left out. Texts without terms have empty lists. Each row is a text of its own.
    """
    each, drop = kept(word_counts(docs), "topic_counts")
    n = each.agg(F.sum(F.size("ids"))).first()[0] or 0
    seen = each.select(F.inline(F.arrays_zip("t", "df", "total"))).groupBy("t").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    for fewest in (least, 1):
        known = seen.filter((F.col("df") >= fewest) & (F.col("df") <= max(share * n, 1))).orderBy(F.desc("total"), "t").limit(vocabulary).select("t").collect()
        if known:
            break
    terms = sorted(r.t for r in known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for b in batches:
            for i in range(b.num_rows):
                ids, words = b.column("ids")[i].values, b.column("t")[i].values
                size, code, n = (widened(b.column(c)[i].as_py()) for c in ("size", "code", "n"))
                term = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()[code]
                owner, ok = np.repeat(np.arange(len(ids)), size), term >= 0
                owner, term, n = owner[ok], term[ok], n[ok]
                order = np.argsort(owner * max(len(terms), 1) + term)
                yield pa.RecordBatch.from_arrays([ids, *_lists(owner, len(ids), pa.array(term[order]), pa.array(n[order]))], ["doc_id", "term", "n"])

    rows = staged(arrow_map(each.select("ids", "size", "code", "n", "t"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term array<int>, n array<bigint>"), "topic_rows")
    drop()
    return rows, terms


def topic_words(docs: DataFrame, k: int, most: int = 10, seed: int = 0, iterations: int = 20, vocabulary: int = 10_000) -> DataFrame:
    """(topic, rank, term, weight): the heaviest words of each topic, weights as shares of the topic."""
    rows, terms = counted(docs, vocabulary)
    topics = fit_topics(rows, k, len(terms), seed, iterations)
    shares = topics / topics.sum(axis=1, keepdims=True) if terms else topics
    best = [(t, r + 1, terms[i], float(shares[t, i])) for t in range(k) for r, i in enumerate(np.argsort(-shares[t], kind="stable")[:most])]
    return docs.sparkSession.createDataFrame(best, "topic int, rank int, term string, weight double")


def lda(docs: DataFrame, k: int, seed: int = 0, iterations: int = 20, vocabulary: int = 10_000) -> DataFrame:
    """(doc_id, topic, confidence): the first largest topic of each text, by batch variational Bayes."""
    rows, terms = counted(docs, vocabulary)
    return topic_of(rows, fit_topics(rows, k, len(terms), seed, iterations), "doc_id")


def kmeans(vectors: DataFrame, k: int, seed: int = 0, starts: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster) on unit vectors: of ``starts`` starts, all computed together, the one of the least cost.

    Rows without a sound vector of the common length, and zero vectors, are left out.
    """
    v = named(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    good = vectors.filter(sound(v) & (norm > 0)).select(named(key).alias("id"), F.transform(v, lambda x: x / norm).alias("v"))
    rows, n, dim = numbered(good, "kmeans_rows")
    if not n:
        return vectors.select(named(key).alias(key), F.lit(0).alias("cluster")).limit(0)
    drawn = drawn_starts(rows.select(F.xxhash64("id", "rid").alias("id"), "v"), dim, min(k, n), seed, starts)
    centers, cost = lloyd(rows, dim, drawn)
    best = centers[int(np.argmin(cost))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(nearest(matrix(b.column("v"), dim), best).astype(np.int32))], ["id", "cluster"])

    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows.select("id", "v"), run, f"id {kind}, cluster int").select(F.col("id").alias(key), "cluster")


def _draw(seed: int, *parts: str | Column) -> Column:
    """A number from 0 to 16^12 - 1 by the digest of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.lit(p) if p.startswith("=") else F.col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def joined_centers(centroids: list[tuple[int, int, list[float]]], cap: float) -> tuple[dict[int, int], list[int], np.ndarray]:
    """(cluster of each label, clusters, their centers) of centroids (label, size, vector), joined while no two of a cluster
    are farther apart than ``cap``."""
    x = np.array([c[2] for c in centroids], float).reshape(len(centroids), -1)
    far = np.round(np.sqrt(np.maximum(((x[:, None] - x) ** 2).sum(axis=2), 0)), 12)
    group = merge_order(far, 1, complete=True, reach=cap)
    kept = sorted(set(group))
    size = np.array([c[1] for c in centroids], float)
    mean = np.array([np.average(x[[i for i, g in enumerate(group) if g == k]], axis=0, weights=size[[i for i, g in enumerate(group) if g == k]]) for k in kept])
    return {c[0]: kept.index(g) for c, g in zip(centroids, group, strict=True)}, kept, mean


def entropy_triplets(
    vectors: DataFrame, labels: DataFrame, most: int = 1024, share: float = 0.2, near: float = 0.02, cap: float = 67.0, seed: int = 100, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(query_idx, choice1_idx, choice2_idx, entropy): rows unsure of their cluster, each with members of two close ones.

    ``labels`` is (key, label). Their centroids are joined up to a distance of ``cap``. A row's chance of a cluster falls as
    1 / (1 + squared distance); of the ``near`` share of clusters, two at least, that are closest, the chances make its
    entropy. ``most`` rows are drawn from the ``share`` of highest entropy (rounded to 10 digits, ties by key), for each two
    of its close clusters and a member of either, all by digests of ``seed`` and keys. Keys must be unique. Rows that are the
    only member of a cluster drawn for them give none, and there are none where all is one cluster. The number of labels
    is bounded by the driver, where their centroids are joined.
    """
    spark = vectors.sparkSession
    v = named(vector).cast("array<double>")
    good = vectors.filter(sound(v) & (F.size(v) > 0)).select(named(key).alias("id"), v.alias("v")).join(labels.select(named(key).alias("id"), named(label).alias("label")), "id")
    rows, n, dim = numbered(good, "triplet_rows")
    means = centroids(rows, "label", "v").join(rows.groupBy("label").count(), "label").orderBy("label").collect() if n else []
    of, kept, centers = joined_centers([(r.label, r["count"], r.centroid) for r in means], cap) if n else ({}, [], np.zeros((0, 0)))
    if len(kept) < 2:
        return spark.createDataFrame([], "query_idx long, choice1_idx long, choice2_idx long, entropy double")
    close = min(len(kept), max(2, math.ceil(len(kept) * near)))

    def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), dim)
            chance = 1 / (1 + ((x[:, None] - centers) ** 2).sum(axis=2))
            order = np.argsort(-np.round(chance, 12), axis=1, kind="stable")[:, :close]
            p = np.take_along_axis(chance, order, axis=1)
            p /= p.sum(axis=1, keepdims=True)
            own = [of[k] for k in b.column("label").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.int32()), pa.array(np.round(-(p * np.log(p)).sum(axis=1), 10)), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "cluster", "entropy", "close"])

    found = staged(arrow_map(rows.select("id", "v", "label"), unsure, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, entropy double, close array<int>"), "triplet_entropy")
    ranked = running(found.select("id", "entropy", "close", (-F.col("entropy")).alias("least")), ["least", "id"], F.lit(1), "triplet_ranks")
    pool = ranked.filter(F.col("pos") < math.ceil(share * n)).withColumn("h", _draw(seed, "=query", "id"))
    asked = pool.orderBy("h", "id").limit(most)
    first = _draw(seed, "=first", "id") % close
    second = (first + 1 + _draw(seed, "=second", "id") % (close - 1)) % close
    asked = staged(asked.select("id", "entropy", *(F.get("close", i.cast("int")).alias(c) for c, i in (("one", first), ("two", second)))), "triplet_queries")
    members = running(found.select("id", "cluster", _draw(seed, "=member", "id").alias("h")), ["cluster", "h", "id"], F.lit(1), "triplet_members")
    starts = members.groupBy("cluster").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("size"))
    for c in ("one", "two"):
        at = starts.select(F.col("cluster").alias(c), "first", "size")
        spot = F.col("first") + _draw(seed, f"={c}", "id") % F.col("size")
        after = F.col("first") + (F.col("spot") - F.col("first") + 1) % F.col("size")
        places = asked.join(F.broadcast(at), c).withColumn("spot", spot).withColumn("after", after)
        pick = lambda to, name: members.select(F.col("pos").alias(to), F.col("id").alias(name))
        both = places.join(pick("spot", "a"), "spot").join(pick("after", "b"), "after")
        asked = both.withColumn(f"{c}_id", F.when(F.col("a") != F.col("id"), F.col("a")).otherwise(F.col("b"))).filter(F.col(f"{c}_id") != F.col("id")).drop("first", "size", "spot", "after", "a", "b")
    return asked.select(F.col("id").alias("query_idx"), F.col("one_id").alias("choice1_idx"), F.col("two_id").alias("choice2_idx"), "entropy")
