"""Persistent taxonomies: a workspace folder with saved states, seen ids, action log and archive."""

from __future__ import annotations

import os
import time
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.operators.taxonomy import SCHEMA, Taxonomy

SAVES = "folder string, version long, coverage double, mean_confidence double, rejected array<string>"
LOG = "ts timestamp, action string, detail string"
SEEN = "doc_id string"


def workspace_root(default: str, pointer: str = ".lexigrove_workspace") -> str:
    """The folder named by LEXIGROVE_WORKSPACE, else by the pointer file here, else ``default``."""
    named = os.environ.get("LEXIGROVE_WORKSPACE", "").strip()
    if not named and Path(pointer).is_file():
        named = Path(pointer).read_text(encoding="utf-8").strip()
    return named or default


class Taken(Exception):
    """Another save has this number."""

    def __init__(self, number: int):
        super().__init__(f"save {number} is another's")
        self.number = number


class Workspace:
    """Tables under ``root``, on any file system that Spark writes to.

    A save writes clusters and a row about them, then takes its number by making a file of that name, which must not exist
    yet and names the save. So readers never see half a state, a save that breaks off leaves the one before in force, and of
    several drivers one gets each number: ``apply`` starts anew from the state of whoever was first. Earlier saves stay. An
    empty file, whose driver died within that step, is passed over after ``patience`` seconds.
    """

    patience = 30.0

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def init(self) -> Taxonomy:
        """Empty tables and a first state without clusters. Fails if there is a workspace."""
        for name, schema in (("saves", SAVES), ("seen", SEEN), ("log", LOG)):
            self.spark.createDataFrame([], schema).write.mode("error").parquet(f"{self.root}/{name}/first")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/numbers")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        empty = Taxonomy(self.spark.createDataFrame([], SCHEMA))
        self.save(empty, "init", "")
        return empty

    def _rows(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def _add(self, rows: DataFrame, name: str) -> None:
        """Adds rows in a folder of their own: writers to one folder would clear away each other's files."""
        rows.write.parquet(f"{self.root}/{name}/{uuid.uuid4().hex}")

    def _saves(self) -> DataFrame:
        """Rows of saves that have a number."""
        files = self.spark.read.text(f"{self.root}/numbers").select(F.col("_metadata.file_name").cast("long").alias("save"), F.col("value").alias("folder"))
        return self._rows("saves", SAVES).join(files, "folder").select("save", "folder", "version", "coverage", "mean_confidence", "rejected")

    def _published(self, number: int, folder: str) -> bool:
        """Takes a number for the save in ``folder``, unless it is taken."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.root}/numbers/{number:020d}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            return False
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(folder.encode()))
        out.close()
        return True

    def _latest(self) -> int:
        return self._saves().agg(F.max("save")).first()[0] or 0

    def save(self, state: Taxonomy, action: str, detail: str, after: int | None = None) -> int:
        """The number of the save; the action goes to the log. Given ``after``, the save that ``state`` comes from, it fails
        with ``Taken`` if another save follows that one."""
        folder = uuid.uuid4().hex
        state.clusters.write.mode("error").parquet(f"{self.root}/clusters/{folder}")
        row = [(folder, state.version, state.coverage, state.mean_confidence, list(state.rejected))]
        self._add(self.spark.createDataFrame(row, SAVES).coalesce(1), "saves")
        number = (self._latest() if after is None else after) + 1
        while not self._published(number, folder):
            if after is not None:
                raise Taken(number)
            number += 1
        self.record(action, detail)
        return number

    def load(self, save: int | None = None) -> Taxonomy:
        """The latest state, or that of a save number."""
        rows = self._saves() if save is None else self._saves().filter(F.col("save") == save)
        r = rows.orderBy(F.col("save").desc(), "folder").first()
        if r is None:
            raise ValueError(f"no saved state in {self.root}")
        clusters = self.spark.read.parquet(f"{self.root}/clusters/{r.folder}")
        return Taxonomy(clusters, r.version, r.coverage, r.mean_confidence, tuple(r.rejected or ()))

    def apply(self, change: dict) -> Taxonomy:
        """A recommendation applied to the latest state and saved, again if another save comes in between."""
        after = self._latest()
        while True:
            base = self._saves().filter(F.col("save") <= after).agg(F.max("save")).first()[0]
            try:
                number = self.save(self.load(base).apply(change), change["type"], str(change.get("targets") or change.get("merge_into") or ""), after)
                return self.load(number)
            except Taken as taken:
                until = time.monotonic() + self.patience
                while self._latest() < taken.number and time.monotonic() < until:
                    time.sleep(0.2)
                after = max(self._latest(), taken.number)

    def record(self, action: str, detail: str) -> None:
        one = self.spark.range(1).select(F.current_timestamp().alias("ts"), F.lit(action).alias("action"), F.lit(detail).alias("detail"))
        self._add(one, "log")

    def log(self) -> DataFrame:
        return self._rows("log", LOG)

    def seen(self) -> DataFrame:
        return self._rows("seen", SEEN).distinct()

    def mark_seen(self, ids: DataFrame) -> None:
        """Appends the ids of ``ids`` (doc_id) that are not seen yet."""
        new = ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(self.seen(), "doc_id", "left_anti")
        self._add(new, "seen")

    def archive(self, names: list[str]) -> list[str]:
        """Moves folders or files of the workspace to archive/; those that exist. The state stays."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(path(f"{self.root}/archive"))
        kept = {"saves", "clusters", "numbers", "seen", "log", "archive"}
        there = [n for n in names if n not in kept and fs.exists(path(f"{self.root}/{n}"))]
        for n in there:
            if not fs.rename(path(f"{self.root}/{n}"), path(f"{self.root}/archive/{n}")):
                raise OSError(f"cannot move {n} to the archive")
        return there
