"""Candidates, seen ids and samples."""

from __future__ import annotations

import logging
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.session import with_checkpoint

FOLD = 16


def unseen(corpus: DataFrame, seen: DataFrame) -> DataFrame:
    return corpus.join(seen.select("doc_id"), "doc_id", "left_anti")


def seen_union(seen: DataFrame, new: DataFrame) -> DataFrame:
    return seen.select("doc_id").union(new.select("doc_id")).distinct()


def random_sample(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows by the order of a keyed hash: the same whatever the partitioning."""
    return candidates.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), "doc_id").limit(n)


def fetch_by_ids(corpus: DataFrame, ids: list) -> DataFrame:
    """(pos, doc_id, text) in request order, repeats kept; a null text where the id is unknown."""
    spark = corpus.sparkSession
    asked = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], f"pos long, doc_id {corpus.schema['doc_id'].dataType.simpleString()}")
    # The request list is what a caller typed: it is the side to broadcast.
    hit = corpus.join(F.broadcast(asked.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")
    return asked.join(hit, "doc_id", "left").select("pos", "doc_id", "text")


def cluster_sample(corpus: DataFrame, audits: DataFrame, cluster: str, n: int, seed: int) -> DataFrame:
    """Texts that current audits assign to a cluster, a random ``n`` of them if there are more."""
    ids = audits.filter(F.col("cluster_id") == cluster).select(F.col("text_id").alias("doc_id")).distinct()
    return random_sample(corpus.join(ids, "doc_id", "left_semi"), n, seed)


def diverse_sample(vectors: DataFrame, n: int, start: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Farthest-first traversal from id ``start``: (pick, key, distance to the picks before it). Ties: the smaller id.

    Each pick is one distributed pass; only the picked vectors, ``n`` at most, come to the driver. Every ``FOLD`` picks
    the distances so far are written, so neither the plan nor the work of a pass grows with ``n``.
    """
    spark = vectors.sparkSession
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    unit = vectors.select(key, F.col(vector).alias("v"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("len"))
    first = unit.filter(F.col(key) == start).limit(1).collect()
    picks, fresh, held = [], [], unit.withColumn("d", F.lit(None).cast("double"))
    if first:
        picks, fresh = [(first[0][key], 0.0)], [first[0]]
    while fresh and len(picks) < n:
        far = [1 - dot(F.col("v"), F.array(*(F.lit(float(x)) for x in p["v"]))) / F.nullif(F.col("len") * F.lit(p["len"]), F.lit(0.0)) for p in fresh]
        rest = held.filter(~F.col(key).isin([p[key] for p in fresh])).withColumn("d", F.least("d", *far))
        if len(fresh) == FOLD:
            held, fresh = with_checkpoint(rest), []
            rest = held
        best = rest.withColumn("d", F.coalesce("d", F.lit(1.0))).orderBy(F.round("d", 10).desc(), key).limit(1).collect()
        if not best:
            break
        picks.append((best[0][key], best[0]["d"]))
        fresh.append(best[0])
    kind = vectors.schema[key].dataType.simpleString()
    return spark.createDataFrame([(k, p[0], float(p[1])) for k, p in enumerate(picks)], f"pick long, {key} {kind}, distance double")


def capped(n: int, most: int) -> int:
    """``n`` or the configured cap on a sample; a notice goes to the log."""
    if n > most:
        logging.getLogger(__name__).warning("sample of %d cut to the cap of %d", n, most)
    return min(n, most)


def sample_entry(spark: SparkSession, strategy: str, n: int, seed: int | None = None) -> DataFrame:
    """The log row of a sample: (strategy, n, seed); a seed is drawn if none is given."""
    drawn = secrets.randbelow(1 << 31) if seed is None else seed
    return spark.createDataFrame([(strategy, n, drawn)], "strategy string, n long, seed long")


def first_rows(rows: DataFrame, order: str, most: int) -> DataFrame:
    return rows.orderBy(order).limit(most)
