"""TF-IDF index, cosine search and class-based weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions import tokens

MAX_FEATURES = 10_000
#: Words that carry no topic.
STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how if in into is it its just more most no not "
    "of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your"
).split()


class TfidfIndex:
    """Weights of ``docs`` (doc_id, text). The vocabulary is MAX_FEATURES rows at most, so joins to it broadcast."""

    def __init__(self, docs: DataFrame, max_features: int = MAX_FEATURES):
        terms = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).filter(~F.col("term").isin(STOP_WORDS))
        self.tf = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        vocab = self.tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
        self.vocab = vocab.orderBy(F.col("total").desc(), "term").limit(max_features)
        self.docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))

    def weights(self) -> DataFrame:
        """(doc_id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), not yet of unit length."""
        idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
        return self.tf.join(F.broadcast(self.vocab), "term").crossJoin(F.broadcast(self.docs)).select("doc_id", "term", (F.col("tf") * idf).alias("weight"), idf.alias("idf"))

    def search(self, query: str, n: int) -> DataFrame:
        """(doc_id, similarity) of the ``n`` most similar texts with anything in common. Ties: the smaller id."""
        spark = self.tf.sparkSession
        asked = spark.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("qtf"))
        rows = self.weights().join(F.broadcast(asked), "term", "left")
        dot = F.sum(F.col("weight") * F.coalesce(F.col("qtf"), F.lit(0)) * F.col("idf"))
        sums = rows.groupBy("doc_id").agg(dot.alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("norm"))
        one = F.broadcast(self.vocab).join(F.broadcast(asked), "term").crossJoin(F.broadcast(self.docs))
        length = one.agg(F.sum(F.pow(F.col("qtf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1), 2)).alias("length"))
        sim = F.col("dot") / F.sqrt(F.col("norm") * F.col("length"))
        found = sums.crossJoin(F.broadcast(length)).filter("dot > 0").select("doc_id", sim.alias("similarity"))
        return found.orderBy(F.round("similarity", 10).desc(), "doc_id").limit(n)


class StoredIndex:
    """A TF-IDF index as tables: weights in order of term, a norm a text, and the vocabulary.

    ``write`` tokenises the corpus once. ``search`` reads the files whose terms the query has, by the statistics of
    sorted files, and joins norms only to texts that hold one of them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.vocab, self.weights, self.norms = (spark.read.parquet(f"{root}/{x}") for x in ("vocabulary", "weights", "norms"))

    @classmethod
    def write(cls, docs: DataFrame, root: str, max_features: int = MAX_FEATURES) -> StoredIndex:
        spark = docs.sparkSession
        index = TfidfIndex(docs, max_features)
        idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
        index.tf.write.mode("overwrite").parquet(f"{root}/counts")
        index.tf = spark.read.parquet(f"{root}/counts")
        vocab = index.tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.col("total").desc(), "term").limit(max_features)
        vocab.crossJoin(F.broadcast(index.docs)).select("term", idf.alias("idf")).write.mode("overwrite").parquet(f"{root}/vocabulary")
        held = F.broadcast(spark.read.parquet(f"{root}/vocabulary"))
        weights = index.tf.join(held, "term").select("term", "doc_id", (F.col("tf") * F.col("idf")).alias("weight"))
        # Texts too: a frequent term spans several ranges.
        weights.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{root}/weights")
        norms = spark.read.parquet(f"{root}/weights").groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        norms.write.mode("overwrite").parquet(f"{root}/norms")
        return cls(spark, root)

    def search(self, query: str, n: int) -> DataFrame:
        """(doc_id, similarity) as ``TfidfIndex.search`` gives it."""
        spark = self.vocab.sparkSession
        asked = spark.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("qtf"))
        terms = self.vocab.join(F.broadcast(asked), "term").select("term", (F.col("qtf") * F.col("idf")).alias("q")).collect()  # of one query
        length = math.sqrt(sum(r.q * r.q for r in terms)) or 1.0
        held = F.broadcast(spark.createDataFrame([(r.term, r.q / length) for r in terms], "term string, q double"))
        hits = self.weights.filter(F.col("term").isin([r.term for r in terms])).join(held, "term")
        dots = hits.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot")).filter("dot > 0")
        found = dots.join(self.norms, "doc_id").select("doc_id", (F.col("dot") / F.col("norm")).alias("similarity"))
        return found.orderBy(F.round("similarity", 10).desc(), "doc_id").limit(n)


def targeted_sample(candidates: DataFrame, query: str, n: int) -> DataFrame:
    """Search over an index that holds the query as one more text, as sampling by a query does."""
    spark = candidates.sparkSession
    asked = spark.createDataFrame([(None, query)], candidates.select("doc_id", "text").schema)
    return TfidfIndex(candidates.select("doc_id", "text").union(asked)).search(query, n + 1).filter("doc_id is not null").orderBy(F.round("similarity", 10).desc(), "doc_id").limit(n)


def class_tfidf(docs: DataFrame, label: str, most: int) -> DataFrame:
    """(label, term, score, rank): tf in the class * ln(1 + mean words a class / tf overall), the best ``most``."""
    terms = docs.select(label, F.explode(tokens(F.col("text"))).alias("term")).filter(~F.col("term").isin(STOP_WORDS))
    tf = terms.groupBy(label, "term").agg(F.count(F.lit(1)).alias("tf"))
    total = tf.groupBy("term").agg(F.sum("tf").alias("all"))
    size = tf.groupBy(label).agg(F.sum("tf").alias("words"))
    mean = size.agg(F.avg("words").alias("mean_words"))
    rows = tf.join(total, "term").join(F.broadcast(size), label).crossJoin(F.broadcast(mean))
    score = F.col("tf") / F.col("words") * F.log(1 + F.col("mean_words") / F.col("all"))
    w = Window.partitionBy(label).orderBy(F.round("score", 10).desc(), "term")
    return rows.select(label, "term", score.alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
