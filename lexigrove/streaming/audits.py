"""Audit assignments as a stream: coverage and means kept up as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrove.sources.corpus import AUDIT


def audit_stream(spark: SparkSession, root: str) -> DataFrame:
    """(audit_id, cluster_version, text_id, cluster_id, confidence) of audit files as they appear."""
    raw = spark.readStream.schema(AUDIT).option("multiLine", "true").json(root)
    raw = raw.withColumn("audit_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    rows = raw.select("audit_id", F.col("cluster_definitions_version").alias("cluster_version"), F.explode("assignments").alias("x"))
    return rows.select("audit_id", "cluster_version", "x.text_id", "x.cluster_id", F.expr("try_cast(x.confidence as double)").alias("confidence"))


def running_stats(rows: DataFrame) -> DataFrame:
    """Counts and mean confidence a version and cluster. The state is a row a group."""
    return rows.groupBy("cluster_version", F.coalesce(F.nullif("cluster_id", F.lit("")), F.lit("")).alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


def watch(spark: SparkSession, root: str, checkpoint: str, name: str) -> StreamingQuery:
    """Keeps an in-memory table ``name`` of running_stats up to date."""
    return running_stats(audit_stream(spark, root)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
