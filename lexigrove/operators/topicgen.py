"""Topics that a provider finds in a corpus: generation until nothing new comes, refinement, assignment, correction.

Generation is sequential by its nature, as each prompt holds the topics so far. Its order is a key drawn from seed and id,
cut into rounds of a fixed number of texts; a round is one small table that one task reads in order. Topics and answers are
written after each round, so a run that stops goes on with the round it was in, and gives what a run without a stop gives.
Everything else is one job over the whole corpus.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrove.functions import topic_names
from lexigrove.operators.ordered import filled
from lexigrove.scratch import ship, staged

#: A line of an answer or of the topic list: ``[1] Name: description`` or ``[1] Name (Count: 3): description``.
TOPIC_LINE = re.compile(r"^\[(\d+)\] ([\w \t\-'&]+?)(?: \(Count: (\d+)\))?: ?(.*)$", re.MULTILINE)
ERROR = "Error"
#: Rounds whose texts are dealt together.
AHEAD = 64
#: ``attempt`` tells a round that was cut off from the one that took its place; ``quiet`` counts texts without news.
ROUNDS = "round int, attempt string, quiet int, done boolean"
TOPICS = "round int, attempt string, topic string, description string, n long, first long"
ANSWERS = "round int, attempt string, r long, doc_id string, response string, new int"

#: Answers prompts in the order they come; a failed one is None.
Ask = Callable[[list[str]], list[str | None]]


def fill(template: str, **values: str) -> str:
    """``template`` with each ``{name}`` replaced, in one pass: what a value holds is never replaced again."""
    missing = [k for k in values if "{" + k + "}" not in template]
    if missing:
        raise ValueError(f"the template lacks {', '.join(sorted(missing))}")
    return re.sub("|".join(re.escape("{" + k + "}") for k in values), lambda m: values[m[0][1:-1]], template)


def prompts(docs: DataFrame, template: str, topics: str, text: str = "text", prompt: str = "prompt") -> DataFrame:
    """``docs`` with a prompt each: what precedes the text is the same in all, so that a provider can keep it."""
    before, found, after = template.replace("{tree}", topics).partition("{Document}")
    if not found:
        raise ValueError("the template lacks Document")
    return docs.withColumn(prompt, F.concat(F.lit(before), F.coalesce(F.col(text), F.lit("")), F.lit(after)))


def ordered_rounds(docs: DataFrame, seed: int, size: int, first: int, rounds: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(round, r, doc_id, text) of ``rounds`` rounds from ``first``: ranks from 0 in the order of md5(seed:id), ties by id
    and text, ``size`` a round. Ids are counted by 4,096 stretches of the order; only stretches that the rounds reach are
    shuffled with their texts."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("doc_id", F.lit(""))))).withColumn("bucket", F.substring("h", 1, 3))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # 4,096 rows at most
    before = counts.select("bucket", "n", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    lo, hi = first * size, (first + rounds) * size
    reached = before.filter((F.col("before") < hi) & (F.col("before") + F.col("n") > lo)).select("bucket", "before")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "doc_id", "text")) - 1 + F.col("before")
    rows = rows.join(F.broadcast(reached), "bucket").withColumn("r", rank.cast("long")).filter((F.col("r") >= lo) & (F.col("r") < hi))
    return rows.select(F.floor(F.col("r") / size).cast("int").alias("round"), "r", "doc_id", "text")


class TopicGeneration:
    """Tables of one generation under ``root``: rounds done, topics after each, answers.

    ``early_stop``: generation ends with the text that is the so manieth in a row to bring no new topic. Failed answers
    count as texts without news. Names are told apart as they are written. One driver runs a generation at a time.
    """

    def __init__(self, spark: SparkSession, root: str, template: str, ask: Ask, early_stop: int = 200, size: int = 256, seed: int = 0):
        if early_stop < 1 or size < 1:
            raise ValueError("early_stop and size are at least 1")
        self.spark, self.root, self.template, self.ask = spark, root.rstrip("/"), template, ask
        self.early_stop, self.size, self.seed = early_stop, size, seed
        for name, schema in (("rounds", ROUNDS), ("topics", TOPICS), ("answers", ANSWERS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _done(self) -> DataFrame:
        return self._read("rounds", ROUNDS)

    def run(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int | None = None) -> bool:
        """Goes on until topics are saturated or texts end, or for ``rounds`` rounds. True if generation is over."""
        made = 0
        while True:
            last = self._done().orderBy(F.desc("round")).first()
            if last and last.done:
                return True
            k = last.round + 1 if last else 0
            rows = self._dealt(docs, k, doc_id, text)
            if not rows.limit(1).count():
                return True
            if rounds is not None and made >= rounds:
                return False
            self._round(rows, k, last.quiet if last else 0)
            made += 1

    def _dealt(self, docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
        """The texts of round ``k``. Rounds are dealt ``AHEAD`` at a time and written, so that a later run goes on with them."""
        first = k - k % AHEAD
        path = f"{self.root}/order-{first:09d}"
        if not self._exists(path):
            dealt = ordered_rounds(docs, self.seed, self.size, first, AHEAD, doc_id, text)
            dealt.repartition("round").sortWithinPartitions("round", "r").write.mode("overwrite").parquet(path)
        return self.spark.read.schema("round int, r long, doc_id string, text string").parquet(path).filter(F.col("round") == k)

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _round(self, rows: DataFrame, k: int, quiet: int) -> None:
        """One round in one task: at most ``size`` texts, and the topics so far, a list that fits a prompt."""
        known = [(t.topic, t.description, t.n, t.first) for t in self.topics().orderBy("first").collect()]
        ship(self.spark)
        template, ask, stop = self.template, self.ask, self.early_stop

        def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = {t: [d, n, f] for t, d, n, f in known}
            out, silent, over = [], quiet, False
            for b in batches:
                for r, i, x in zip(b["r"].tolist(), b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                    if over:
                        break
                    said = ask([fill(template, Topics=topic_list((t, d) for t, (d, _, _) in names.items()), Document=x)])[0]
                    fresh = 0
                    for name, about in named(said):
                        if name in names:
                            names[name][1] += 1
                        else:
                            names[name] = [about, 1, r]
                            fresh += 1
                    silent = 0 if fresh else silent + 1
                    over = silent >= stop
                    out.append(("answer", r, i, said, fresh))
            out += [("topic", f, t, d, n) for t, (d, n, f) in names.items()]
            out.append(("end", silent, None, None, int(over)))
            yield pd.DataFrame(out, columns=["kind", "r", "name", "value", "n"])

        ordered = rows.coalesce(1).sortWithinPartitions("r").select("r", "doc_id", "text")
        made = staged(ordered.mapInPandas(grow, "kind string, r long, name string, value string, n long"), "topic_round")
        one = lambda kind: made.filter(F.col("kind") == kind)
        which = [F.lit(k).cast("int").alias("round"), F.lit(uuid.uuid4().hex).alias("attempt")]
        one("answer").select(*which, "r", F.col("name").alias("doc_id"), F.col("value").alias("response"), F.col("n").cast("int").alias("new")).coalesce(1).write.mode("append").parquet(f"{self.root}/answers")
        one("topic").select(*which, F.col("name").alias("topic"), F.col("value").alias("description"), "n", F.col("r").alias("first")).coalesce(1).write.mode("append").parquet(f"{self.root}/topics")
        # Last, as it makes the round count.
        one("end").select(*which, F.col("r").cast("int").alias("quiet"), (F.col("n") == 1).alias("done")).coalesce(1).write.mode("append").parquet(f"{self.root}/rounds")

    def topics(self) -> DataFrame:
        """(topic, description, n, first) after the last whole round: texts that named it, rank of the first."""
        last = self._done().agg(F.max(F.struct("round", "attempt")).alias("x")).select("x.*")
        return self._read("topics", TOPICS).join(F.broadcast(last), ["round", "attempt"]).select("topic", "description", "n", "first")

    def answers(self) -> DataFrame:
        """(r, doc_id, response, new) of whole rounds."""
        rows = self._read("answers", ANSWERS).join(self._done(), ["round", "attempt"], "left_semi")
        return rows.select("r", "doc_id", "response", "new")


def named(answer: str | None) -> list[tuple[str, str]]:
    """(name, description) of an answer's topic lines, each name once, in order."""
    found: dict[str, str] = {}
    for m in TOPIC_LINE.finditer(answer or ""):
        found.setdefault(m[2], m[4])
    return list(found.items())


def topic_list(topics: Iterable[tuple[str, str]]) -> str:
    """(name, description) pairs as the lines that prompts and files hold."""
    return "\n".join(f"[1] {name}: {text}" for name, text in topics)


def refined(topics: DataFrame, merges: DataFrame, least_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Topics merged and rare ones dropped, and what became of each name.

    ``topics`` is (topic, description, n, first), ``merges`` (old, new, description) in any chain; a circle ends in its
    smallest name. Merged topics add their counts. A merged topic's description is that of the least merge that names it,
    else its own, else that of its earliest part. Topics with less than ``least_share`` of all counts are dropped.
    Returns (topic, description, n, first) and (topic, refined), where ``refined`` is null for dropped names.
    """
    step = merges.filter("old <> new").groupBy("old").agg(F.min(F.struct("new", "description")).alias("m")).select("old", F.col("m.new").alias("new"))
    texts = merges.groupBy("new").agg(F.min("description").alias("given"))
    at = staged(topics.select("topic", F.col("topic").alias("to"), F.array("topic").alias("seen")), "refined")
    done = at.select("topic", "to").limit(0)
    while at.limit(1).count():
        # A taxonomy of some hundreds of names: ``seen`` is as long as the longest chain of merges.
        go = at.join(step, at["to"] == step["old"], "left").select("topic", "to", "seen", "new")
        circle = F.array_contains("seen", F.col("new"))
        moved = F.col("new").isNotNull() & ~circle
        least = F.array_min(F.slice("seen", F.array_position("seen", F.col("new")).cast("int"), F.size("seen")))
        to, seen = F.when(circle, least).otherwise(F.coalesce("new", "to")), F.when(moved, F.array_append("seen", F.col("new"))).otherwise(F.col("seen"))
        nxt = staged(go.select("topic", to.alias("to"), seen.alias("seen"), moved.alias("moved")), "refined")
        ends = nxt.filter("not moved").select("topic", "to")
        at = nxt.filter("moved").select("topic", "to", "seen")
        done = staged(done.union(ends), "refined")
    own = topics.select(F.col("topic").alias("to"), F.col("description").alias("own"))
    parts = topics.join(done, "topic").groupBy("to").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min_by("description", "first").alias("part"))
    named = parts.join(own, "to", "left").join(texts, F.col("to") == F.col("new"), "left").drop("new")
    total = F.broadcast(parts.agg(F.sum("n").alias("total")))
    kept = named.crossJoin(total).filter(F.col("n") >= F.lit(least_share) * F.col("total"))
    kept = staged(kept.select(F.col("to").alias("topic"), F.coalesce("given", "own", "part").alias("description"), "n", "first"), "refined")
    fate = done.join(kept.select(F.col("topic").alias("to"), F.col("topic").alias("refined")), "to", "left").select("topic", "refined")
    return kept, fate


def assigned(docs: DataFrame, answers: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``response``: the answer (custom_id, response) under the id as text, or ``Error`` if there is none."""
    said = answers.groupBy("custom_id").agg(F.min("response").alias("response"))
    rows = docs.join(said, F.col(doc_id).cast("string") == F.col("custom_id"), "left").drop("custom_id")
    return rows.withColumn("response", F.coalesce("response", F.lit(ERROR)))


def to_correct(rows: DataFrame, topics: DataFrame, response: str = "response") -> DataFrame:
    """``rows`` with ``error`` and ``hallucinated``: no topic line at all, or only names that are no topics."""
    names = F.broadcast(topics.agg(F.collect_set("topic").alias("__names")))  # a taxonomy of some hundreds
    said = topic_names(F.col(response))
    error = (F.col(response) == ERROR) | F.col(response).isNull() | (F.size(said) == 0)
    none: Column = F.size(F.array_intersect(said, F.col("__names"))) == 0
    return rows.crossJoin(names).withColumn("error", error).withColumn("hallucinated", ~F.col("error") & none).drop("__names")


def corrected(rows: DataFrame, answers: DataFrame, doc_id: str = "doc_id", response: str = "response") -> DataFrame:
    """``rows`` with the new answer (custom_id, response) where there is one; failed corrections keep the old row."""
    said = answers.filter(F.col("response").isNotNull() & (F.col("response") != ERROR)).groupBy("custom_id").agg(F.min("response").alias("__new"))
    both = rows.join(said, F.col(doc_id).cast("string") == F.col("custom_id"), "left").drop("custom_id")
    return both.withColumn(response, F.coalesce("__new", response)).drop("__new")


def request_files(requests: DataFrame, most_rows: int = 25_000, most_bytes: int = 200_000_000) -> DataFrame:
    """(custom_id, file) of prompts (custom_id, prompt), filled in the order of ids."""
    return filled(requests.select("custom_id", (F.octet_length("prompt") + 1).cast("long").alias("size")), "custom_id", most_rows, most_bytes)
