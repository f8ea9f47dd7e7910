"""Audit assignments: confidence scales, coverage, cluster counts, reports and the running update."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions import confidence_label


def normalise_confidence(rows: DataFrame, audit: str = "audit_id", confidence: str = "confidence") -> DataFrame:
    """``confidence`` on the 1..5 scale, judged per audit from its least and largest value and any fraction.

    An audit with a value that is no number stays as it is.
    """
    c = F.expr(f"try_cast({confidence} as double)")
    # A row an audit, joined back: an audit of any size never meets in one task.
    scale = rows.groupBy(F.col(audit).alias("__audit")).agg(
        F.min(c).alias("__low"), F.max(c).alias("__high"), F.coalesce(F.max(c != F.floor(c)), F.lit(False)).alias("__fraction"),
        F.max(F.col(confidence).isNotNull() & c.isNull()).alias("__bad"), F.max((c < 1) | (c > 5)).alias("__outside"),
    )
    low, high, fraction, bad, outside = (F.col(f"__{x}") for x in ("low", "high", "fraction", "bad", "outside"))
    clamp = lambda x: F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.rint(x)))
    scaled = (
        F.when(c.isNull() | bad, c)
        .when((high <= 1) & fraction, clamp(c * 5))
        .when((low == 1) & (high == 1), c)
        .when((low == 0) & (high == 1), clamp(c * 5))
        .when((low == 0) & (high == 0), F.lit(1.0))
        .when(high <= 1, clamp(c))
        .when(outside | fraction, clamp(c))
        .otherwise(c)
    )
    both = rows.join(scale, F.col(audit).eqNullSafe(F.col("__audit")))
    return both.withColumn("normalised", scaled).drop("__audit", "__low", "__high", "__fraction", "__bad", "__outside")


def current_version(rows: DataFrame, version: int, column: str = "cluster_version") -> DataFrame:
    return rows.filter(F.col(column) == version)


def reject_stale(rows: DataFrame, version: int, column: str = "cluster_version") -> DataFrame:
    """Rows as they are; computing them fails on a missing or other version."""
    fail = F.raise_error(F.concat(F.lit(f"audit is not of version {version}: "), F.coalesce(F.col(column).cast("string"), F.lit("none"))))
    return rows.filter(F.when(F.col(column).eqNullSafe(F.lit(version)), F.lit(True)).otherwise(fail.cast("boolean")))


def assignment_stats(rows: DataFrame, by: list[str], cluster: str = "cluster_id", confidence: str = "confidence") -> DataFrame:
    """total, assigned, unclustered, coverage (0 for none) and the mean of given confidences."""
    given = F.nullif(F.col(cluster), F.lit("")).isNotNull()
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(given).alias("assigned"), F.avg(confidence).alias("mean_confidence"))
    return out.withColumn("unclustered", F.col("total") - F.col("assigned")).withColumn("coverage", F.coalesce(F.col("assigned") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))


def cluster_counts(rows: DataFrame, by: list[str], cluster: str = "cluster_id", confidence: str = "confidence") -> DataFrame:
    return rows.filter(F.nullif(F.col(cluster), F.lit("")).isNotNull()).groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("sum_confidence"), F.count(confidence).alias("n_confidence"))


def size_distribution(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.coalesce(F.min("n"), F.lit(0)).alias("min_size"), F.coalesce(F.max("n"), F.lit(0)).alias("max_size"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_size"))


def confidence_histogram(rows: DataFrame, confidence: str = "confidence") -> DataFrame:
    return rows.filter(F.col(confidence).isNotNull()).groupBy(confidence).agg(F.count(F.lit(1)).alias("n"))


def metrics_report(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row a cluster that was assigned: name (unknown if it is no more), count, mean confidence and label."""
    counts = cluster_counts(rows, [])
    mean = F.col("sum_confidence") / F.nullif(F.col("n_confidence"), F.lit(0))
    named = counts.join(clusters.select("cluster_id", "name"), "cluster_id", "left")
    return named.select("cluster_id", F.coalesce("name", F.lit("unknown")).alias("name"), "n", mean.alias("mean_confidence"), confidence_label(mean).alias("label"))


def weak_clusters(report: DataFrame) -> DataFrame:
    """Rows of a metrics report whose mean confidence is low."""
    return report.filter(F.col("label") == "low")


def update_from_audits(clusters: DataFrame, rows: DataFrame, version: int) -> DataFrame:
    """Clusters with the confidences of the current version's audits added to their running mean (two decimals).

    Only given confidences count. Clusters that have none here keep count, mean and status. An audit that comes twice
    in ``rows`` counts once; audits already in a cluster's mean must not come again.
    """
    fresh = current_version(rows, version).dropDuplicates(["audit_id", "text_id"])
    counts = cluster_counts(fresh, []).filter("n_confidence > 0").select("cluster_id", "sum_confidence", "n_confidence")
    both = clusters.join(counts, "cluster_id", "left")
    heard = F.col("n_confidence").isNotNull()
    before = F.when(F.col("audit_mean_confidence").isNotNull() & (F.col("audit_assignments") > 0), F.col("audit_assignments")).otherwise(F.lit(0))
    total = before + F.col("n_confidence")
    mean = F.when(heard, (F.coalesce(F.col("audit_mean_confidence") * before, F.lit(0.0)) + F.col("sum_confidence")) / total).otherwise(F.col("audit_mean_confidence"))
    return both.select(
        "cluster_id", "name", F.when(heard, total).otherwise(F.col("audit_assignments")).alias("audit_assignments"), F.when(heard, F.round(mean, 2)).otherwise(mean).alias("audit_mean_confidence"),
        confidence_label(mean).alias("confidence"), F.when(heard, "audited").otherwise(F.col("status")).alias("status"),
    )


def audit_examples(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` best assigned texts of each cluster: (cluster_id, text_id, best, rank)."""
    best = rows.filter(F.nullif(F.col("cluster_id"), F.lit("")).isNotNull()).groupBy("cluster_id", "text_id").agg(F.max("confidence").alias("best"))
    w = Window.partitionBy("cluster_id").orderBy(F.col("best").desc_nulls_last(), "text_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
