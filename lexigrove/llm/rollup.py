"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A batch is a set of changes: an insert adds a document and its tokens, a delete takes both away, a revision changes
tokens only. A batch is aggregated to one row a group before it is written under its own id; it counts once its files
are complete, and committing an id again does nothing, so a retried driver cannot count twice. Totals are the sum of
the latest snapshot and of the batches it does not hold.

Null sources, languages and versions are groups of their own; null counts are 0; a change of unknown kind is an error.
Groups whose documents and tokens are all gone drop out. An empty batch is a commit without rows. A source with a third
of all rows is a row a task after partial aggregation. Only the named columns are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import scratch_path

GROUP = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"


def changes(df: DataFrame, kind: Column, version: Column, tokens: Column, before: Column | None = None) -> DataFrame:
    """Rows as signed changes. ``kind``: insert, delete or revise; ``before``: tokens counted so far, for a revision."""
    n, old = F.coalesce(tokens, F.lit(0)).cast("long"), F.coalesce(before if before is not None else F.lit(0), F.lit(0)).cast("long")
    unknown = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(unknown.cast("int"))
    delta = F.when(kind == "insert", n).when(kind == "delete", -n).otherwise(n - old)
    return df.select("source", "lang", version.alias("tokenizer_version"), docs.cast("long").alias("docs"), delta.alias("tokens"))


class TokenRollup:
    """Totals in a folder that all executors share. One driver commits at a time."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or scratch_path(spark, "rollup")).rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _complete(self, path: str) -> bool:
        return self._fs.exists(self._path(f"{path}/_SUCCESS"))

    def _children(self, name: str) -> list[str]:
        top = self._path(f"{self.root}/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(x for x in found if self._complete(f"{self.root}/{name}/{x}"))

    def committed(self) -> set[str]:
        return {x.removeprefix("id=") for x in self._children("batches")} | self._snapshot()[1]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch; False, and no effect, if that id was committed before."""
        if batch_id in self.committed():
            return False
        totals = deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batches/id={batch_id}")
        return True

    def _snapshot(self) -> tuple[str | None, set[str]]:
        names = self._children("snapshots")
        if not names:
            return None, set()
        path = f"{self.root}/snapshots/{names[-1]}"
        held = self.spark.read.schema("ids string").json(f"{self.root}/held/{names[-1]}").first()
        return path, set(json.loads(held.ids)) if held else set()

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens."""
        path, held = self._snapshot()
        parts = [f"{self.root}/batches/{x}" for x in self._children("batches") if x.removeprefix("id=") not in held] + ([path] if path else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        summed = rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.filter("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds all batches into a snapshot. It counts once complete; until then the batches do."""
        ids, number = sorted(self.committed()), len(self._children("snapshots"))
        name = f"{number:08d}"
        self.spark.createDataFrame([(json.dumps(ids),)], "ids string").coalesce(1).write.mode("overwrite").json(f"{self.root}/held/{name}")
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{self.root}/snapshots/{name}")
