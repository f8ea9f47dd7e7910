"""Corpora from CSV, JSON and JSON lines; datasets, proposals, audits, prediction cells and logs."""

from __future__ import annotations

from pathlib import PurePosixPath
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions import python_strip
from lexigrove.sources.split import csv_records, json_items

DOCUMENT = "doc_id string, text string, gold_label_id int, gold_label_name string, is_none boolean, source_split string, source_row_index int"
PROPOSAL = "timestamp string, sample_size int, sample_strategy string, style string, clusters array<struct<name string, description string, text_ids array<string>, reasoning string>>, unclustered_ids array<string>, observations string"
AUDIT = "timestamp string, n_texts int, sample_method string, cluster_definitions_version int, assignments array<struct<text_id string, cluster_id string, confidence string, note string>>, summary struct<weak_clusters array<string>, observations string>"
BOM = "﻿"


def load_corpus(spark: SparkSession, path: str, text_col: str, id_col: str | None = None) -> DataFrame:
    """(ord, doc_id, text) by the file's suffix; blank texts are gone, ids without a column are row numbers before that."""
    suffix = PurePosixPath(path).suffix.lower()
    readers = {".csv": read_csv, ".json": read_json, ".jsonl": read_jsonl}
    if suffix not in readers:
        raise ValueError(f"cannot read {suffix or 'a file without a suffix'}: csv, json or jsonl")
    return readers[suffix](spark, path, text_col, id_col)


def numbered(df: DataFrame) -> DataFrame:
    """``ord``: 0-based position in the file. Partition totals first, so no task holds all rows."""
    df = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    counts = df.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    within = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return df.join(F.broadcast(before), "__p").withColumn("ord", F.col("__b") + within).drop("__p", "__i", "__n", "__b")


def _finish(df: DataFrame, text, row_id) -> DataFrame:
    out = df.select("ord", F.coalesce(row_id, F.col("ord").cast("string")).alias("doc_id"), python_strip(text).alias("text"))
    return out.filter(F.coalesce(F.col("text"), F.lit("")) != "")


def read_csv(spark: SparkSession, path: str, text_col: str, id_col: str | None = None) -> DataFrame:
    """Quoted fields may hold line ends. Of columns of one name the last counts; lines end with a line feed."""
    names, rows = csv_records(spark, path)
    if text_col not in names:
        raise ValueError(f"no column {text_col}; there are {', '.join(names)}")
    field = lambda c: F.col(f"row.c{len(names) - 1 - names[::-1].index(c)}")
    row_id = python_strip(field(id_col)) if id_col is not None and id_col in names else F.lit(None).cast("string")
    return _finish(rows, field(text_col), row_id)


def read_json(spark: SparkSession, path: str, text_col: str, id_col: str | None = None) -> DataFrame:
    """A list of objects or of strings; strings stay even if blank."""
    value = F.get(F.from_json(F.concat(F.lit("["), "item", F.lit("]")), "array<string>"), F.lit(0))
    rows = json_items(spark, path).select("ord", value.alias("v"), F.substring("item", 1, 1).alias("kind"))
    field = lambda c: F.get_json_object("v", f"$['{c}']")
    objects = _finish(rows.filter("kind = '{'"), field(text_col), field(id_col or "id"))
    return objects.union(rows.filter("kind = '\"'").select("ord", F.col("ord").cast("string"), python_strip(F.col("v"))))


def read_jsonl(spark: SparkSession, path: str, text_col: str, id_col: str | None = None) -> DataFrame:
    """Lines that are no object with a text are skipped; ids without a field are line numbers over all lines."""
    rows = numbered(spark.read.text(path)).withColumn("v", F.try_parse_json(F.regexp_replace("value", f"^{BOM}", "")))
    field = lambda c: F.try_variant_get("v", f"$['{c}']", "string")
    return _finish(rows.filter("v is not null"), field(text_col), field(id_col or "id"))


def read_dataset(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(f"{root}/documents.jsonl")


def write_dataset(docs: DataFrame, root: str) -> None:
    docs.select(*(f.name for f in T._parse_datatype_string(DOCUMENT).fields)).write.mode("overwrite").json(f"{root}/documents.jsonl")


def read_proposals(spark: SparkSession, root: str) -> DataFrame:
    """(proposal, text_id, cluster, ord): one row a membership, in file order. A proposal is named by its path below
    ``root``, without the extension."""
    below = F.substring_index(F.col("_metadata.file_path"), f"{quote(root.split('://', 1)[-1].rstrip('/'))}/", -1)
    raw = spark.read.schema(PROPOSAL).option("recursiveFileLookup", "true").json(root, multiLine=True).withColumn("proposal", F.regexp_replace(below, r"\.json$", ""))
    clusters = raw.select("proposal", F.posexplode("clusters").alias("c", "cluster"))
    return clusters.select("proposal", "c", F.col("cluster.name").alias("cluster"), F.posexplode("cluster.text_ids").alias("t", "text_id")).select("proposal", "text_id", "cluster", (F.col("c") * 1_000_000_000 + F.col("t")).cast("long").alias("ord"))


def read_audits(spark: SparkSession, root: str) -> DataFrame:
    """(audit_id, cluster_version, text_id, cluster_id, confidence, note)."""
    raw = spark.read.schema(AUDIT).json(root, multiLine=True).withColumn("audit_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    return raw.select("audit_id", F.col("cluster_definitions_version").alias("cluster_version"), F.explode("assignments").alias("x")).select("audit_id", "cluster_version", "x.*")


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """Run metadata with method, dataset and seed from the path <method>/<dataset>/seed=<n>.meta.json."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").json(root, multiLine=True)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/seed(?:=|%3D)(\d+)\.meta\.json$", k)
    return raw.withColumns({"method": part(1), "dataset": part(2), "seed": part(3).cast("int")})


def write_predictions(rows: DataFrame, root: str) -> None:
    rows.write.mode("overwrite").partitionBy("method", "dataset", "seed").json(root)


def append_log(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").json(root)


def write_requests(requests: DataFrame, root: str) -> None:
    requests.select("request").write.mode("overwrite").text(root)


def log_tail(spark: SparkSession, path: str, most: int) -> DataFrame:
    """The last ``most`` lines that parse, newest first."""
    rows = numbered(spark.read.text(path)).withColumn("v", F.try_parse_json("value")).filter("v is not null")
    return rows.orderBy(F.col("ord").desc()).limit(most).select("ord", "value")
