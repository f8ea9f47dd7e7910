"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import bpe, decontaminate, neardup, pages, quality, rollup, shards, substrings, toxicity, warc
from lexigrove.llm.common import staged, table


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the capture index."""
    root = warc.write(table(spark, sf_dir, "pages"))
    return warc.read_all(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version, over four batches of signed changes.

    Every document is inserted with an estimate, replayed to no effect, revised to its real counts, and taken away
    again if it has no text.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), quality.SPACE), "")).cast("long")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = docs.select("source", "lang", words.alias("words"), size.alias("size"), "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counted = staged(bpe.count_tokens(docs, path, public_tokenizers.PATTERN, keep=["source", "lang", "words", "size"]), "counts")
    versions = F.array(F.struct(F.lit("words").alias("v"), F.col("words").alias("n")), F.struct(F.lit("byte_bpe_50k").alias("v"), F.col("n_tokens").alias("n")))
    rows = counted.withColumn("x", F.explode(versions)).select("source", "lang", "size", "x.v", "x.n", F.ceil(F.col("size") / 4).alias("guess"))
    book = rollup.TokenRollup(spark)
    first = rollup.changes(rows, F.lit("insert"), F.col("v"), F.col("guess"))
    book.commit("load", first)
    book.commit("load", first)
    book.commit("revise", rollup.changes(rows, F.lit("revise"), F.col("v"), F.col("n"), F.col("guess")))
    book.commit("empty", rollup.changes(rows.filter("size = 0"), F.lit("delete"), F.col("v"), F.col("n")))
    return book.totals()


def op10_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's BPE token ids (the next id after the vocabulary between documents) in training order, in binary
    shards of 16-bit ids, which hold the vocabulary of 50,256."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = len(bpe.loaded(path, public_tokenizers.PATTERN).piece)
    docs = staged(bpe.encode(table(spark, sf_dir, "documents").select("text"), path, public_tokenizers.PATTERN, keep=[], width=2).select("ids"), "ids")
    return shards.write(docs, "ids", width=2, separator=end)[1]


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; labels of a fifth of the ids are held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that start more than once in the corpus."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.main_text(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of the weakly supervised quality rules for every document."""
    m = F.col(quality.HELD)
    return quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id", m.n_words.alias("n_words"), m.word_chars.alias("word_chars"), m.n_symbols.alias("n_symbols"), m.n_dup_lines.alias("n_dup_lines"),
        m.n_repeat_words.alias("n_repeat_words"), m.base_failed.alias("base_failed"), m.kept.alias("kept"), m.probability.alias("probability"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, on two-word shingles at a similarity of 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, threshold=0.8)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an occurrence of a window of a benchmark item."""
    found = decontaminate.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_minhash_neardup": op2_minhash_neardup, "op3_decontamination": op3_decontamination, "op4_warc": op4_warc, "op5_token_counts": op5_token_counts, "op6_toxicity": op6_toxicity, "op7_substring_dedup": op7_substring_dedup, "op8_html_extraction": op8_html_extraction, "op9_quality_rules": op9_quality_rules, "op10_training_shards": op10_training_shards}
ORACLE_SQL: dict[str, str] = {}
