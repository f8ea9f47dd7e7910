"""Datasets: none mapping, label compaction, validation, alignment, statistics, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions import python_strip
from lexigrove.operators.ordered import folded_sha256

NONE_ID, NONE_NAME = -1, "__none__"


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts stripped, blank ones gone."""
    return df.withColumn(text, python_strip(F.col(text))).filter(F.col(text) != "")


def map_none(df: DataFrame, label: str, name: str, none_label: int) -> DataFrame:
    """gold_label_id, gold_label_name and is_none, the source's none class as -1."""
    is_none = F.col(label) == none_label
    return df.withColumns({
        "gold_label_id": F.when(is_none, F.lit(NONE_ID)).otherwise(F.col(label)).cast("int"),
        "gold_label_name": F.when(is_none, F.lit(NONE_NAME)).otherwise(F.col(name)),
        "is_none": is_none,
    })


def compact_labels(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, label_id): 0..k-1 in order of first appearance. Only the k names meet in one task."""
    first = df.filter(F.col(name) != NONE_NAME).groupBy(name).agg(F.min(order).alias("first"))
    return first.select(name, (F.row_number().over(Window.orderBy("first", name)) - 1).cast("int").alias("label_id"))


def single_label(df: DataFrame, labels: str) -> DataFrame:
    return df.filter(F.size(labels) == 1)


def validate_dataset(docs: DataFrame, doc_id: str, text: str, label: str, is_none: str, k: int) -> DataFrame:
    """One row of violation counts."""
    per_id = docs.groupBy(doc_id).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(python_strip(F.col(text)), F.lit("")) == "").alias("blank"),
        F.count_if((F.col(label) < NONE_ID) | (F.col(label) >= k)).alias("range"),
        F.count_if(F.col(is_none) != (F.col(label) == NONE_ID)).alias("none"),
        F.collect_set(F.when(F.col(label) >= 0, F.col(label))).alias("labels"),
    )
    counts = per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).cast("long").alias("duplicate_ids"),
        F.coalesce(F.sum("blank"), F.lit(0)).cast("long").alias("blank_texts"), F.coalesce(F.sum("range"), F.lit(0)).cast("long").alias("labels_out_of_range"),
        F.coalesce(F.sum("none"), F.lit(0)).cast("long").alias("none_mismatches"),
        (F.lit(k) - F.size(F.array_distinct(F.flatten(F.collect_set("labels"))))).cast("long").alias("labels_missing"),
    )
    return counts


def check_aligned(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """One row: rows of either side, and row numbers at which the texts differ or one is missing."""
    x, y = a.select(key, F.col(text).alias("ta"), F.lit(1).alias("ia")), b.select(key, F.col(text).alias("tb"), F.lit(1).alias("ib"))
    both = x.join(y, key, "full_outer")
    return both.agg(F.count("ia").alias("n_left"), F.count("ib").alias("n_right"), F.count_if(F.col("ia").isNull() | F.col("ib").isNull() | ~F.col("ta").eqNullSafe(F.col("tb"))).alias("mismatches"))


def length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """avg, median, p95, min, max of lengths as integers, half to even."""
    n = F.length(text)
    rint = lambda c: F.rint(c).cast("long")
    return df.agg(rint(F.avg(n)).alias("avg_length"), rint(F.percentile(n, 0.5)).alias("median_length"), rint(F.percentile(n, 0.95)).alias("p95_length"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"))


def dataset_meta(df: DataFrame, by: list[str], is_none: Column, text: str = "text") -> DataFrame:
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(is_none).alias("n_none"), F.coalesce(F.avg(F.length(text)), F.lit(0.0)).alias("mean_text_chars"))
    return rows.withColumn("share_none", F.coalesce(F.col("n_none") / F.col("n_docs"), F.lit(0.0)))


def texts_sha256(df: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """The hash of each group's texts in order, each followed by a NUL. A group goes by as a stream."""
    return folded_sha256(df, by, text, order, "\0", "texts_sha256")


def require_valid(counts: DataFrame) -> None:
    """Raises if a row of ``validate_dataset`` counts any violation."""
    found = {k: v for k, v in counts.first().asDict().items() if k != "n_docs" and v}
    if found:
        raise ValueError(f"dataset is not valid: {found}")


def single_label_counts(df: DataFrame, labels: str) -> DataFrame:
    """One row: kept (rows of exactly one label) and rejected (all others, null lists too)."""
    one = F.coalesce(F.size(labels) == 1, F.lit(False))
    return df.agg(F.count_if(one).alias("kept"), F.count_if(~one).alias("rejected"))


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of ``names`` that is a column."""
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(names)} is a column; there are {', '.join(df.columns)}")
    return found


def in_locale(df: DataFrame, locale: str = "en", column: str = "locale") -> DataFrame:
    return df.filter(F.col(column) == locale)


def without_suffix(x: Column, suffix: str = ".txt") -> Column:
    return F.when(F.endswith(x, F.lit(suffix)), F.substring(x, F.lit(1), F.length(x) - len(suffix))).otherwise(x)


def concatenated(splits: dict[str, DataFrame]) -> DataFrame:
    """Rows of all splits under each other, named in ``source_split``; columns that a split lacks are null there."""
    parts = [df.withColumn("source_split", F.lit(k)) for k, df in splits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def label_space(splits: list[DataFrame], name: str) -> DataFrame:
    """(name, label_id): the distinct names of all splits, numbered in order. Only distinct names meet in one task."""
    names = splits[0].select(name)
    for s in splits[1:]:
        names = names.union(s.select(name))
    names = names.filter(F.col(name).isNotNull()).distinct()
    return names.select(name, (F.row_number().over(Window.orderBy(name)) - 1).cast("int").alias("label_id"))
