"""The relational shell round bulk annotation: requests, chunks, parsing, resolution, correction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions import python_strip, topic_names
from lexigrove.operators.ordered import filled

NOISE = ("unknown_topic", "new_label")
HALLUCINATED, UNPARSEABLE = "<hallucinated>", "<unparseable>"


def numbered_chunks(rows: DataFrame, size: int, seed: int, total: int | None = None, key: str = "doc_id") -> DataFrame:
    """``chunk`` and ``pos`` after a seeded shuffle. Ranks come from buckets of the hash, so no task sees all rows."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = rows.withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)) - 1 + F.col("before")
    return rows.join(F.broadcast(before), "bucket").withColumn("r", rank).withColumn("chunk", F.floor(F.col("r") / size).cast("long")).withColumn("pos", (F.col("r") % size).cast("long")).drop("h", "bucket", "before", "r")


def chat_requests(chunks: DataFrame, model: str, system: str, json_mode: bool = False, limit: int = 4000) -> DataFrame:
    """(custom_id, request): one chat request a chunk (chunk, pos, text), its texts in order as a list."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: F.concat(F.lit("- "), x.text))
    rows = chunks.groupBy("chunk").agg(F.array_join(texts, "\n").alias("user"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = [F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", F.col("user"))).alias("messages"), F.lit(limit).alias("max_completion_tokens")]
    body += [F.struct(F.lit("json_object").alias("type")).alias("response_format")] if json_mode else []
    cid = F.format_string("chunk-%06d", F.col("chunk"))
    return rows.select(cid.alias("custom_id"), F.to_json(F.struct(cid.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(*body).alias("body"))).alias("request"))


def byte_chunks(requests: DataFrame, most_rows: int, most_bytes: int, group: str = "custom_id", text: str = "request") -> DataFrame:
    """``file`` number by greedy filling up to rows and bytes, in order of the id; only ids and sizes are shuffled."""
    sizes = requests.select(group, (F.octet_length(text) + 1).cast("long").alias("size"))
    return filled(sizes, group, most_rows, most_bytes)


def parse_responses(lines: DataFrame, column: str = "value") -> DataFrame:
    """(custom_id, content, failed, prompt_tokens net of cached, cached_tokens, completion_tokens)."""
    schema = "custom_id string, error string, response struct<status_code int, body struct<choices array<struct<message struct<content string>>>, usage struct<prompt_tokens long, completion_tokens long, prompt_tokens_details struct<cached_tokens long>>>>"
    r = lines.select(F.from_json(column, schema).alias("r")).select("r.*")
    use, cached = F.col("response.body.usage"), F.coalesce(F.col("response.body.usage.prompt_tokens_details.cached_tokens"), F.lit(0))
    failed = F.col("custom_id").isNull() | F.col("error").isNotNull() | ~F.col("response.status_code").eqNullSafe(F.lit(200))
    return r.select(
        "custom_id", F.when(~failed, F.get("response.body.choices", F.lit(0)).getField("message").getField("content")).alias("content"), failed.alias("failed"),
        (F.coalesce(use.prompt_tokens, F.lit(0)) - cached).alias("input_tokens"), cached.alias("cache_tokens"), F.coalesce(use.completion_tokens, F.lit(0)).alias("output_tokens"),
    )


def usage_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = rows.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "cache_tokens", "output_tokens")), F.count(F.lit(1)).alias("n_responses"))
    return sums.withColumn("cache_hit_rate", F.coalesce(F.col("cache_tokens") / F.nullif(F.col("cache_tokens") + F.col("input_tokens"), F.lit(0)), F.lit(0.0)))


def label_union(labels: DataFrame, order: str = "ord", label: str = "label") -> DataFrame:
    """(label, ord): distinct labels by first appearance, without placeholder names."""
    noise = F.lit(False)
    for n in NOISE:
        noise = noise | F.contains(F.col(label), F.lit(n))
    return labels.filter(~noise & (F.trim(label) != "")).groupBy(label).agg(F.min(order).alias("first"))


def resolve_labels(responses: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label) of responses that should be JSON.

    Of an object, the first value that is a label, else the first value that holds one, labels in list order; keys never
    count. Of anything else the first label that its text holds. Else a sentinel: hallucinated if it was JSON other than
    null, unparseable if not. ``labels`` is (label, ord), a taxonomy of some hundreds: one array in each task.
    """
    names = F.broadcast(labels.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x.label).alias("names")))
    rows = responses.crossJoin(names)
    t, parsed = F.col(text), F.try_parse_json(text)
    nothing = parsed.isNull() | F.is_variant_null(parsed)
    held = lambda x: F.filter("names", lambda n: F.contains(x, n))
    values = F.map_values(F.from_json(t, "map<string,string>"))
    exact = F.get(F.filter(values, lambda v: F.array_contains("names", v)), F.lit(0))
    within = F.get(F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), held)), F.lit(0))
    loose = F.get(held(F.when(nothing, t).otherwise(F.coalesce(F.try_variant_get(parsed, "$", "string"), t))), F.lit(0))
    label = (
        F.when(t.isNull(), UNPARSEABLE)
        .when(parsed.isNotNull() & F.json_object_keys(t).isNotNull(), F.coalesce(exact, within, F.lit(HALLUCINATED)))
        .otherwise(F.coalesce(loose, F.when(nothing, UNPARSEABLE).otherwise(HALLUCINATED)))
    )
    return rows.select(key, label.alias("label"))


def merged_labels(responses: DataFrame, key: str, text: str) -> DataFrame:
    """(key, labels): of the first {...} block's first value, a list, the names without repeats, lists in it flattened by
    one level. Null where there is no such block, it is not JSON, or its first value is no list.
    """
    block = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    first = F.get(F.map_values(F.from_json(block, "map<string,string>")), F.lit(0))
    items = F.from_json(first, "array<string>")
    flat = F.flatten(F.transform(items, lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))))
    ok = F.try_parse_json(block).isNotNull() & first.startswith("[")
    return responses.select(key, F.when(ok, F.array_distinct(F.filter(flat, lambda x: x != ""))).alias("labels"))


def first_valid_topic(responses: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, topic): the first listed topic that is valid, else null."""
    names = F.broadcast(labels.agg(F.collect_set("label").alias("names")))
    rows = responses.crossJoin(names)
    return rows.select(key, F.get(F.filter(topic_names(F.col(text)), lambda x: F.array_contains(F.col("names"), x)), F.lit(0)).alias("topic"))


def with_fallback(rows: DataFrame, valid: Column, cluster: str, order: str, fallback: str = "largest") -> DataFrame:
    """``cluster`` of rows that are not valid: the largest valid cluster (ties: seen first), or -1 for 'none'."""
    if fallback == "none":
        return rows.withColumn(cluster, F.when(valid, F.col(cluster)).otherwise(F.lit(-1)))
    sizes = rows.filter(valid).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    largest = sizes.agg(F.max_by(cluster, F.struct("n", (-F.col("first")).alias("f"))).alias("largest"))
    return rows.crossJoin(F.broadcast(largest)).withColumn(cluster, F.when(valid, F.col(cluster)).otherwise(F.col("largest"))).drop("largest")


def correction_counts(rows: DataFrame, error: Column, hallucinated: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(error).alias("n_error"), F.count_if(hallucinated).alias("n_hallucinated"), F.count_if(error | hallucinated).alias("n_to_correct"))


def pending(triplets: DataFrame, done: DataFrame) -> DataFrame:
    return triplets.join(done, ["query_idx", "choice1_idx", "choice2_idx"], "left_anti")


def training_triplets(judged: DataFrame) -> DataFrame:
    """(query_idx, pos_idx, neg_idx) of judgements that name one choice only."""
    p = F.get("prediction", F.lit(0))
    one, two = F.contains(p, F.lit("Choice 1")), F.contains(p, F.lit("Choice 2"))
    clear = judged.filter((F.size("prediction") == 1) & (one != two))
    return clear.select("query_idx", F.when(one, F.col("choice1_idx")).otherwise(F.col("choice2_idx")).alias("pos_idx"), F.when(one, F.col("choice2_idx")).otherwise(F.col("choice1_idx")).alias("neg_idx"))


def match_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """custom_id, status: ok, missing (no response) or unknown (no request)."""
    a, b = requests.select("custom_id", F.lit(1).alias("asked")), responses.select("custom_id", F.lit(1).alias("got"))
    status = F.when(F.col("got").isNull(), "missing").when(F.col("asked").isNull(), "unknown").otherwise("ok")
    return a.join(b, "custom_id", "full_outer").select("custom_id", status.alias("status"))


def annotate(df: DataFrame, provider: Callable[[pd.Series], pd.Series], prompt: str, out: str = "content") -> DataFrame:
    """``out`` from a provider that answers a batch of prompts. A provider is any function of a pandas Series."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: provider(b[prompt])})

    return df.mapInPandas(run, schema)


def validate_outputs(files: DataFrame, required: dict[str, list[str]], kind: str = "kind", body: str = "body") -> DataFrame:
    """(…, valid, missing): is the body a JSON object with the keys that its kind requires."""
    wanted = F.lit(None).cast("array<string>")
    for k, keys in required.items():
        wanted = F.when(F.col(kind) == k, F.array(*(F.lit(x) for x in keys))).otherwise(wanted)
    keys = F.json_object_keys(body)
    missing = F.array_sort(F.array_except(wanted, F.coalesce(keys, F.array().cast("array<string>"))))
    return files.withColumn("missing", F.array_join(missing, ",")).withColumn("valid", keys.isNotNull() & wanted.isNotNull() & (F.size(missing) == 0))


def merged_or_given(responses: DataFrame, key: str, text: str, given: str) -> DataFrame:
    """(key, labels): ``merged_labels``, or the list that was to be merged (column ``given``) where the answer has none."""
    merged = merged_labels(responses.select(F.struct(key, given).alias("__k"), text), "__k", text)
    return merged.select(f"__k.{key}", F.coalesce("labels", f"__k.{given}").alias("labels"))


def triplet_texts(triplets: DataFrame, texts: DataFrame) -> DataFrame:
    """Triplets with the texts (idx, text) of their three indices: query, choice1, choice2."""
    for c in ("query", "choice1", "choice2"):
        triplets = triplets.join(texts.select(F.col("idx").alias(f"{c}_idx"), F.col("text").alias(c)), f"{c}_idx")
    return triplets.select("query_idx", "choice1_idx", "choice2_idx", "query", "choice1", "choice2")


def cluster_problems(rows: DataFrame, body: str) -> DataFrame:
    """``rows`` with ``problem``: of a cluster as JSON, whether it is no object or lacks a name or a description that is
    a non-blank string; null if it is sound."""
    v = F.try_parse_json(body)

    def lacks(field: str) -> Column:
        x = F.try_variant_get(v, f"$.{field}", "variant")
        return ~F.coalesce((F.schema_of_variant(x) == "STRING") & (python_strip(F.try_variant_get(v, f"$.{field}", "string")) != ""), F.lit(False))

    problem = F.when(v.isNull() | F.json_object_keys(body).isNull(), "no object").when(lacks("name"), "name").when(lacks("description"), "description")
    return rows.withColumn("problem", problem)
