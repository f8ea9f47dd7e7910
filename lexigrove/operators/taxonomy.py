"""Versioned taxonomy: every change is a function from one state of clusters to the next.

A cluster is (cluster_id, name, description, evidence array<string>, audit_assignments, audit_mean_confidence, status).
``Taxonomy`` carries the version and the metrics that structural changes void.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions import confidence_label, name_key

SCHEMA = "cluster_id string, name string, description string, evidence array<string>, audit_assignments long, audit_mean_confidence double, status string"


def _number(x: str = "cluster_id"):
    return F.regexp_extract(x, r"^c(\d+)$", 1).try_cast("int")


def set_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (ord, name, description, ids or null) with ids reused by normalised name, else minted after the largest.

    Evidence stays where the input has none. Of equal old names the last counts.
    """
    known = old.groupBy(name_key(F.col("name")).alias("k")).agg(F.max_by("cluster_id", _number()).alias("old_id"), F.max_by("evidence", _number()).alias("old_evidence"))
    top = old.agg(F.coalesce(F.max(_number()), F.lit(0)).alias("top"))
    both = new.withColumn("k", name_key(F.col("name"))).join(known, "k", "left").crossJoin(F.broadcast(top))
    fresh = F.when(F.col("old_id").isNull(), F.row_number().over(Window.partitionBy(F.col("old_id").isNull()).orderBy("ord")))
    cid = F.coalesce("old_id", F.concat(F.lit("c"), (F.col("top") + fresh).cast("string")))
    return both.select("ord", cid.alias("cluster_id"), "name", "description", F.coalesce("ids", "old_evidence", F.array().cast("array<string>")).alias("evidence"))


def merge_clusters(clusters: DataFrame, target: str, sources: list[str], name: str | None = None) -> DataFrame:
    """Sources folded into the target: evidence in order without repeats, counts summed, means weighted. Sources without
    a mean add nothing to the counts."""
    into = F.when(F.col("cluster_id").isin([target, *sources]), F.lit(target)).otherwise(F.col("cluster_id"))
    rank = F.when(F.col("cluster_id") == target, 0).otherwise(1 + F.coalesce(F.array_position(F.array(*(F.lit(s) for s in sources)), F.col("cluster_id")), F.lit(0)))
    n = F.when((F.col("id") == F.col("cluster_id")) | F.col("audit_mean_confidence").isNotNull(), F.col("audit_assignments")).otherwise(F.lit(0))
    rows = clusters.select(into.alias("id"), rank.alias("r"), "*")
    head = lambda c: F.min_by(c, "r").alias(c)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("r", "evidence"))), lambda x: x.evidence)
    out = rows.groupBy("id").agg(
        head("name"), head("description"), F.array_distinct(F.flatten(parts)).alias("evidence"), F.sum(n).alias("audit_assignments"),
        (F.sum(F.col("audit_mean_confidence") * n) / F.nullif(F.sum(F.when(F.col("audit_mean_confidence").isNotNull(), n)), F.lit(0))).alias("audit_mean_confidence"),
        F.when(F.count(F.lit(1)) > 1, "modified").otherwise(F.max("status")).alias("status"),
    ).withColumnRenamed("id", "cluster_id")
    return out.withColumn("name", F.when(F.col("cluster_id") == target, F.lit(name)).otherwise(F.col("name"))) if name else out


def check_split(parent: DataFrame, buckets: DataFrame) -> DataFrame:
    """(problem, text_id): overlap, missing or extra ids of buckets (bucket, text_id) against the parent (text_id)."""
    overlap = buckets.groupBy("text_id").agg(F.countDistinct("bucket").alias("n")).filter("n > 1").select(F.lit("overlap").alias("problem"), "text_id")
    missing = parent.join(buckets, "text_id", "left_anti").select(F.lit("missing").alias("problem"), "text_id")
    extra = buckets.join(parent, "text_id", "left_anti").select(F.lit("extra").alias("problem"), "text_id")
    return overlap.union(missing).union(extra).distinct()


def split_cluster(clusters: DataFrame, target: str, buckets: DataFrame) -> DataFrame:
    """The target replaced by ``buckets`` (pos, name, description, ids): the first keeps the id, counters start anew."""
    top = clusters.agg(F.coalesce(F.max(_number()), F.lit(0)).alias("top"))
    cid = F.when(F.col("pos") == 0, F.lit(target)).otherwise(F.concat(F.lit("c"), (F.col("top") + F.col("pos")).cast("string")))
    made = buckets.crossJoin(F.broadcast(top)).select(cid.alias("cluster_id"), "name", "description", F.col("ids").alias("evidence"), F.lit(0).cast("long").alias("audit_assignments"), F.lit(None).cast("double").alias("audit_mean_confidence"), F.lit("modified").alias("status"))
    return clusters.filter(F.col("cluster_id") != target).unionByName(made)


def rename_cluster(clusters: DataFrame, target: str, name: str | None = None, description: str | None = None) -> DataFrame:
    is_it = F.col("cluster_id") == target
    for column, value in (("name", name), ("description", description)):
        if value:
            clusters = clusters.withColumn(column, F.when(is_it, F.lit(value)).otherwise(F.col(column)))
    return clusters.withColumn("status", F.when(is_it, "modified").otherwise(F.col("status")))


def add_cluster(clusters: DataFrame, name: str, description: str, ids: list[str]) -> DataFrame:
    if not name or not name.strip():
        raise ValueError("a cluster needs a name")
    spark = clusters.sparkSession
    one = spark.createDataFrame([(0, name, description, ids)], "pos int, name string, description string, ids array<string>")
    top = clusters.agg(F.coalesce(F.max(_number()), F.lit(0)).alias("top"))
    made = one.crossJoin(F.broadcast(top)).select(F.concat(F.lit("c"), (F.col("top") + 1).cast("string")).alias("cluster_id"), "name", "description", F.col("ids").alias("evidence"), F.lit(0).cast("long").alias("audit_assignments"), F.lit(None).cast("double").alias("audit_mean_confidence"), F.lit("proposed").alias("status"))
    return clusters.unionByName(made)


def remove_clusters(clusters: DataFrame, targets: list[str]) -> DataFrame:
    return clusters.filter(~F.col("cluster_id").isin(targets))


def update_descriptions(clusters: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` (cluster_id, name, description): matched by id, else by normalised name if only one cluster has it."""
    by_id = updates.filter("cluster_id is not null").select("cluster_id", F.col("name").alias("n1"), F.col("description").alias("d1")).dropDuplicates(["cluster_id"])
    lone = clusters.groupBy(name_key(F.col("name")).alias("k")).agg(F.count(F.lit(1)).alias("c"), F.min("cluster_id").alias("cid")).filter("c = 1")
    loose = updates.join(clusters.select("cluster_id"), "cluster_id", "left_anti")
    by_name = loose.withColumn("k", name_key(F.col("name"))).join(lone, "k").select(F.col("cid").alias("cluster_id"), F.col("description").alias("d2")).dropDuplicates(["cluster_id"])
    both = clusters.join(by_id, "cluster_id", "left").join(by_name, "cluster_id", "left")
    return both.withColumn("name", F.coalesce("n1", "name")).withColumn("description", F.coalesce("d1", "d2", "description")).drop("n1", "d1", "d2")


def finalize(clusters: DataFrame, examples: DataFrame, corpus: DataFrame, most: int) -> DataFrame:
    """(cluster_id, name, pos, text_id, text): evidence texts in order, audit examples for clusters without evidence.

    ``examples`` is (cluster_id, text_id, rank). Ids without a text are left out.
    """
    own = clusters.select("cluster_id", "name", F.posexplode(F.slice("evidence", 1, most)).alias("pos", "text_id"))
    bare = clusters.filter(F.size("evidence") == 0).select("cluster_id", "name")
    lent = bare.join(examples, "cluster_id").filter(F.col("rank") <= most).select("cluster_id", "name", (F.col("rank") - 1).alias("pos"), F.col("text_id").cast("string").alias("text_id"))
    texts = corpus.select(F.col("doc_id").cast("string").alias("text_id"), "text")
    return own.union(lent).join(texts, "text_id").select("cluster_id", "name", F.col("pos").cast("int").alias("pos"), "text_id", "text")


@dataclass(frozen=True)
class Taxonomy:
    """A state: clusters, version, and metrics of the current version (null once it changes)."""

    clusters: DataFrame
    version: int = 0
    coverage: float | None = None
    mean_confidence: float | None = None
    rejected: tuple[str, ...] = field(default=())

    def _structural(self, clusters: DataFrame) -> "Taxonomy":
        return replace(self, clusters=clusters, version=self.version + 1, coverage=None, mean_confidence=None)

    def _ids(self) -> set[str]:
        return {r.cluster_id for r in self.clusters.select("cluster_id").collect()}

    def apply(self, change: dict) -> "Taxonomy":
        """A recommendation {type, ...}: merge, split, rename, add, remove or no_change."""
        kind, spark = change.get("type"), self.clusters.sparkSession
        if kind == "merge":
            target, known = change["merge_into"], self._ids()
            if target not in known:
                raise KeyError(f"no such cluster: {target}")
            sources = [x for x in change["targets"] if x in known and x != target]
            return self._structural(merge_clusters(self.clusters, target, sources, change.get("rename_to")))
        if kind == "split":
            target = change["targets"][0]
            if target not in self._ids():
                raise KeyError(f"no such cluster: {target}")
            rows = [(k, b["name"], b.get("description", ""), [str(i) for i in b["text_ids"]]) for k, b in enumerate(change["split_into"])]
            buckets = spark.createDataFrame(rows, "pos int, name string, description string, ids array<string>")
            parent = self.clusters.filter(F.col("cluster_id") == target).select(F.explode("evidence").alias("text_id"))
            found = {r.problem for r in check_split(parent, buckets.select(F.col("pos").alias("bucket"), F.explode("ids").alias("text_id"))).select("problem").distinct().collect()}
            if found:
                raise ValueError(f"split does not cover the cluster exactly once: {sorted(found)}")
            return self._structural(split_cluster(self.clusters, target, buckets))
        if kind == "rename":
            return replace(self, clusters=rename_cluster(self.clusters, change["targets"][0], change.get("rename_to"), change.get("description")))
        if kind == "add":
            new = change["new_cluster"]
            return self._structural(add_cluster(self.clusters, new.get("name", ""), new.get("description", ""), [str(i) for i in new.get("example_ids", [])]))
        if kind == "remove":
            missing = set(change["targets"]) - self._ids()
            if missing:
                raise KeyError(f"no such clusters: {sorted(missing)}")
            return self._structural(remove_clusters(self.clusters, change["targets"]))
        if kind == "no_change":
            return replace(self, rejected=(*self.rejected, change.get("rejected_hypothesis", "")))
        raise ValueError(f"unknown recommendation: {kind}")


def labelled(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("confidence", confidence_label(F.col("audit_mean_confidence")))
