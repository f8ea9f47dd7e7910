"""Session factory used by tests, the bench and ad-hoc runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrove.scratch import scratch_root


def get_session(app: str = "lexigrove", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, AQE and Arrow on; ``master`` and partitions are left to the cluster when not given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, local mode takes a folder of its own, a cluster an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(scratch_root(spark))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def with_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
