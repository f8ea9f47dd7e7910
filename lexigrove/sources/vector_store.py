"""Embeddings kept by content: a text is embedded once for each model, whatever corpora it is in."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "hash string, vector array<float>"


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class VectorStore:
    """Vectors of one model under ``root``, a row a text's SHA-256. Models have folders of their own.

    Runs only add rows. A run that breaks off has added nothing; two runs at a time may add a text twice, of which readers
    take the least vector, so results don't hang on who was first.
    """

    def __init__(self, spark: SparkSession, root: str, model: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/model={model}"
        self._add(spark.createDataFrame([], SCHEMA))

    def _add(self, rows: DataFrame) -> None:
        """Adds rows in a folder of their own: writers to one folder would clear away each other's files."""
        rows.write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def stored(self) -> DataFrame:
        """(hash, vector), a row a text."""
        return self._rows().groupBy("hash").agg(F.min("vector").alias("vector"))

    def missing(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(hash, text): distinct texts that have no vector yet. Null is the empty text."""
        each = docs.select(text_hash(F.col(text)).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        return each.groupBy("hash").agg(F.first("text").alias("text")).join(self._rows().select("hash"), "hash", "left_anti")

    def fill(self, docs: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64, text: str = "text") -> int:
        """Embeds what is missing and returns how many texts that were.

        ``encoder`` makes the model, once a task; the model maps texts to a row each. It gets ``batch`` texts at a time.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = encoder()
            for b in batches:
                for lo in range(0, len(b), batch):
                    part = b.iloc[lo : lo + batch]
                    yield pd.DataFrame({"hash": part["hash"], "vector": list(np.asarray(model(part["text"].tolist()), np.float32))})

        before = self._rows().count()
        self._add(self.missing(docs, text).mapInPandas(run, SCHEMA))
        return self._rows().count() - before

    def vectors(self, docs: DataFrame, key: str, text: str = "text", out: str = "embedding") -> DataFrame:
        """(key, out) of texts that have a vector."""
        asked = docs.select(F.col(key), text_hash(F.col(text)).alias("hash"))
        return asked.join(self.stored(), "hash").select(key, F.col("vector").alias(out))
