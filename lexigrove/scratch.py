"""The shared scratch folder, tables written there, and Arrow functions with this package at hand in the workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, local mode takes a folder of its own, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            root = f"file://{tempfile.mkdtemp(prefix='lexigrove_')}"
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/lexigrove/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written as Parquet in the shared folder and read again, and what deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: drop_path(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    return kept(df, name)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_lexigrove_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexigrove_ship_")) / "lexigrove_workers.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(str(target))
    sc._lexigrove_shipped = True


def arrow_map(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table of ``buckets`` buckets of ``key`` in the shared folder, and what drops it again.

    Joins of such tables on ``key`` need no shuffle. ``df`` should be dealt by ``repartition(buckets, key)`` or come from
    a join of such tables, else each task writes to many buckets.
    """
    spark = df.sparkSession
    path, table_name = scratch_path(spark, name), f"lexigrove_{name}_{uuid.uuid4().hex}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).format("parquet").saveAsTable(table_name)

    def drop() -> None:
        spark.sql(f"drop table if exists {table_name}")
        drop_path(spark, path)

    return spark.table(table_name), drop


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
