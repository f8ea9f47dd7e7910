"""Requests to a provider as tables: what was asked, every attempt, and what is still to do.

A request is open until an attempt has succeeded, was refused for good or was the last allowed. ``run`` sends open ones in
waves; a wave is one write of attempts, so a run that is killed loses the answers of one wave at most and goes on where it
was. Attempts carry a key made of request and number, by which a provider can tell a repeated one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.operators.ordered import filled
from lexigrove.scratch import staged

REQUESTS = "custom_id string, request string"
ATTEMPTS = "custom_id string, attempt int, wave string, status string, response string, wait double"
#: What a provider may say: an answer, a failure that may pass, a limit that passes after ``wait`` seconds, a refusal.
OK, FAILED, LIMITED, REFUSED = "ok", "failed", "limited", "refused"

Provider = Callable[[pd.DataFrame], pd.DataFrame]


class Ledger:
    """Tables under ``root``. One driver runs a ledger at a time; any number may read it."""

    def __init__(self, spark: SparkSession, root: str, most_attempts: int = 5):
        self.spark, self.root, self.most = spark, root.rstrip("/"), most_attempts
        for name, schema in (("requests", REQUESTS), ("attempts", ATTEMPTS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.root}/{name}")

    def requests(self) -> DataFrame:
        return self.spark.read.schema(REQUESTS).parquet(f"{self.root}/requests")

    def attempts(self) -> DataFrame:
        return self.spark.read.schema(ATTEMPTS).parquet(f"{self.root}/attempts")

    def submit(self, requests: DataFrame) -> int:
        """Adds requests (custom_id, request) with ids that are new, and says how many. Of one id the least request counts."""
        new = requests.groupBy("custom_id").agg(F.min("request").alias("request")).join(self.requests().select("custom_id"), "custom_id", "left_anti")
        new = staged(new, "ledger_new")
        new.write.mode("append").parquet(f"{self.root}/requests")
        return new.count()

    def state(self) -> DataFrame:
        """(custom_id, attempts, status, response, wait): open, or how it ended, and the answer."""
        tried = self.attempts().groupBy("custom_id").agg(
            F.max("attempt").alias("attempts"), F.max_by("status", "attempt").alias("last"), F.max_by("response", F.when(F.col("status") == OK, 1).otherwise(0)).alias("response"), F.max(F.col("status") == OK).alias("done"), F.max_by("wait", "attempt").alias("wait")
        )
        status = F.when(F.col("done"), OK).when(F.col("last") == REFUSED, REFUSED).when(F.col("attempts") >= self.most, F.col("last")).otherwise("open")
        both = self.requests().select("custom_id").join(tried, "custom_id", "left")
        return both.select("custom_id", F.coalesce("attempts", F.lit(0)).alias("attempts"), status.alias("status"), F.when(F.col("done"), F.col("response")).alias("response"), F.coalesce("wait", F.lit(0.0)).alias("wait"))

    def run(self, provider: Provider, wave_rows: int = 50_000, wave_bytes: int = 200_000_000, base: float = 1.0, longest: float = 600.0, sleep: Callable[[float], None] = time.sleep, waves: int | None = None) -> int:
        """Sends open requests until none is left (or ``waves`` were sent) and returns how many attempts were made.

        ``provider`` maps (custom_id, key, request) to (custom_id, status, response, wait), a batch at a time, on the
        executors. Between rounds it waits: as long as the provider said, else ``base`` seconds doubled with each attempt.
        """
        sent = made = 0
        while True:
            open_rows = self.requests().join(self.state().filter("status = 'open'"), "custom_id").select("custom_id", "request", (F.col("attempts") + 1).cast("int").alias("attempt"), "wait")
            todo = staged(open_rows, "ledger_open")
            if not (first := todo.agg(F.count(F.lit(1)).alias("n"), F.min("attempt").alias("attempt"), F.max("wait").alias("wait")).first()).n:
                return made
            if first.attempt > 1:
                sleep(min(longest, max(first.wait, base * 2 ** (first.attempt - 2))))
            files = staged(filled(todo.select("custom_id", (F.octet_length("request") + 1).cast("long").alias("size")), "custom_id", wave_rows, wave_bytes), "ledger_waves")
            for k in range(int(files.agg(F.max("file")).first()[0]) + 1):
                if waves is not None and sent >= waves:
                    return made
                made += self._wave(todo.join(files.filter(F.col("file") == k), "custom_id"), provider)
                sent += 1

    def _wave(self, rows: DataFrame, provider: Provider) -> int:
        wave = uuid.uuid4().hex

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                asked = b[["custom_id", "request"]].assign(key=b["custom_id"] + "#" + b["attempt"].astype(str))
                said = {r["custom_id"]: r for r in provider(asked).to_dict("records")}
                out = []
                for i, n in zip(b["custom_id"].tolist(), b["attempt"].tolist(), strict=True):
                    r = said.get(i, {})
                    status = r.get("status") if r.get("status") in (OK, LIMITED, REFUSED) else FAILED
                    out.append((i, n, wave, status, r["response"] if status == OK else None, float(r.get("wait") or 0.0)))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ATTEMPTS.split(", ")])

        rows.select("custom_id", "request", "attempt").mapInPandas(ask, ATTEMPTS).write.mode("append").parquet(f"{self.root}/attempts")
        return self.attempts().filter(F.col("wave") == wave).count()

    def answers(self) -> DataFrame:
        """(custom_id, response) of requests that succeeded."""
        return self.state().filter(F.col("status") == OK).select("custom_id", "response")
