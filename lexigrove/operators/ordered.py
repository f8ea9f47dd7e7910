"""Totals, files and digests along an order, without one task that sees all rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.scratch import arrow_map, staged


def running(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """``rows``, without a column of such a name, with ``pos`` (from 0) and ``before``, the sum of ``amount`` over the rows before, in this order.

    Ranges of the order are sorted apart; what lies before a range is summed from a row a range. Written once, as ranges
    are drawn from samples.
    """
    dealt = rows.withColumn("__n", amount).repartitionByRange(*order).sortWithinPartitions(*order)
    held = staged(dealt.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), name)
    totals = held.groupBy("__p").agg(F.count(F.lit(1)).alias("c"), F.sum("__n").alias("s"))
    w = Window.orderBy("__p")  # one row a range
    start = totals.select(F.col("__p").alias("__q"), (F.sum("c").over(w) - F.col("c")).alias("c"), (F.sum("s").over(w) - F.col("s")).alias("s"))
    within = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    both = held.join(F.broadcast(start), F.col("__p") == F.col("__q"))
    out = both.withColumn("before", F.col("s") + F.coalesce(F.sum("__n").over(within), F.lit(0)))
    return out.withColumn("pos", F.col("c") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__q", "__i", "__n", "c", "s")


def filled(sizes: DataFrame, key: str, most_rows: int, most: int, size: str = "size") -> DataFrame:
    """(key, file): rows in order of ``key`` put into files, each filled until a row more would go beyond ``most_rows``
    rows or a total ``size`` of ``most``.

    For each row the first row of the next file, if a file began there, comes from running totals: how many rows end
    within ``most`` after it. Doubling these pointers (1, 2, 4, ... files on) and following them from the first row gives
    every row at which a file begins. A row larger than ``most`` is an error. Keys must be unique and not null.
    """
    too_large = F.raise_error(F.lit("one request is larger than a file may be")).cast("long")
    rows = staged(running(sizes.select(key, F.when(F.col(size) > most, too_large).otherwise(F.col(size)).alias("n")), [key], F.col("n"), "files_order"), "files_rows")
    total = rows.count()
    ends = rows.select((F.col("before") + F.col("n")).alias("at"), F.lit(1).alias("is_end"), F.lit(None).cast("long").alias("row"))
    asked = rows.select((F.col("before") + F.lit(most)).alias("at"), F.lit(0).alias("is_end"), F.col("pos").alias("row"))
    # of equal totals the ends come first
    count = running(ends.unionByName(asked).withColumn("second", 1 - F.col("is_end")), ["at", "second", "row"], F.col("is_end"), "files_reach").filter("is_end = 0")
    jump = staged(count.select(F.col("row").alias("pos"), F.least(F.col("before"), F.col("row") + most_rows, F.lit(total)).alias("to")).filter(F.col("to") < total), "files_jump")
    jumps = [jump]
    while True:  # as often as the number of files can be halved
        twice = staged(jump.join(jump.select(F.col("pos").alias("to"), F.col("to").alias("far")), "to").select("pos", F.col("far").alias("to")), "files_jump")
        if not twice.filter("pos = 0").limit(1).count():
            break
        jumps.append(twice)
        jump = twice
    starts = rows.filter("pos = 0").select("pos", F.lit(0).cast("long").alias("file"))
    for k in range(len(jumps) - 1, -1, -1):
        on = starts.join(jumps[k], "pos").select(F.col("to").alias("pos"), (F.col("file") + (1 << k)).alias("file"))
        starts = staged(starts.unionByName(on), "files_starts")
    # a row is in the file that began last: running count of beginnings
    marked = rows.select(key, "pos").join(starts, "pos", "left").select(key, F.col("pos").alias("row"), F.col("file").isNotNull().cast("long").alias("begins"))
    return running(marked, ["row"], F.col("begins"), "files_marked_order").select(key, (F.col("before") + F.col("begins") - 1).alias("file"))


def folded_sha256(rows: DataFrame, by: list[str], text: str, order: str, end: str = "\0", name: str = "sha256") -> DataFrame:
    """(by…, name): the digest of each group's texts in order, each followed by ``end``; null texts are left out.

    Rows are sorted by group and order, and one hash state goes along with them: no group is ever held, however large.
    """
    at = [f"b{i}" for i in range(len(by))]
    named = rows.select(*(F.col(c).alias(a) for c, a in zip(by, at, strict=True)), F.col(order).alias("o"), F.col(text).alias("t"))
    dealt = (named.repartition(*at) if by else named.repartition(1)).sortWithinPartitions(*at, "o", "t").select(*at, "t")
    schema = T.StructType([T.StructField(a, rows.schema[c].dataType) for c, a in zip(by, at, strict=True)] + [T.StructField("s", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, kinds = None, None, None

        def emit() -> pa.RecordBatch:
            values = [pa.array([v], k) for v, k in zip(group, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*values, pa.array([state.hexdigest()])], [*at, "s"])

        for b in batches:
            kinds = [b.column(a).type for a in at]
            keys = zip(*(b.column(a).to_pylist() for a in at), strict=True) if at else repeat((), b.num_rows)
            for k, t in zip(keys, b.column("t"), strict=True):
                if state is None or k != group:
                    if state is not None:
                        yield emit()
                    group, state = k, hashlib.sha256()
                if t.is_valid:
                    state.update(t.as_py().encode())
                    state.update(end.encode())
        if state is not None:
            yield emit()

    found = arrow_map(dealt, run, schema)
    return found.select(*(F.col(a).alias(c) for c, a in zip(by, at, strict=True)), F.col("s").alias(name))
