"""Files and digests along an order against plain loops."""

from __future__ import annotations

import hashlib
import random

import pytest
from lexigrove.operators import ordered
from pyspark.errors import PySparkException


def plain_files(sizes: list[int], most_rows: int, most: int) -> list[int]:
    out, file, n, held = [], 0, 0, 0
    for s in sizes:
        if n and (n + 1 > most_rows or held + s > most):
            file, n, held = file + 1, 0, 0
        n, held = n + 1, held + s
        out.append(file)
    return out


@pytest.mark.parametrize(("n", "most_rows", "most", "top"), [(400, 1_000, 100, 60), (300, 7, 10_000, 60), (257, 5, 120, 40), (60, 9, 50, 50), (40, 1, 99, 9), (1, 5, 5, 5), (120, 50, 30, 0)])
def test_files_equal_the_sequential_fill(spark, n, most_rows, most, top):
    rng = random.Random(n)
    sizes = [rng.randint(0, top) for _ in range(n)]
    df = spark.createDataFrame([(f"id-{i:05d}", s) for i, s in enumerate(sizes)], "custom_id string, size long").repartition(5)
    got = [r.file for r in ordered.filled(df, "custom_id", most_rows, most).orderBy("custom_id").collect()]
    assert got == plain_files(sizes, most_rows, most)


def test_no_stage_takes_all_rows_in_one_task(spark):
    df = spark.range(3_000).selectExpr("id", "1 + id % 9 as size")
    plan = ordered.filled(df, "id", 100, 500)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window", 1)[0]


def test_files_of_nothing_and_of_too_much(spark):
    none = spark.createDataFrame([], "custom_id string, size long")
    assert ordered.filled(none, "custom_id", 5, 5).count() == 0
    with pytest.raises(PySparkException):
        ordered.filled(spark.createDataFrame([("a", 6)], "custom_id string, size long"), "custom_id", 5, 5).count()


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    got = ordered.running(spark.createDataFrame(rows, "i long, n long").repartition(7), ["i"], ordered.F.col("n"), "t").orderBy("i").collect()
    total = 0
    for k, r in enumerate(got):
        assert (r.pos, r.before, r.i) == (k, total, k)
        total += r.n


def test_digests_fold_groups_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["en", "de", None]), rng.randint(0, 3), rng.randint(0, 99), rng.choice([None, "", "ß", "text " * 50])) for _ in range(300)]
    df = spark.createDataFrame(rows, "lang string, part int, i int, text string").repartition(6)
    want = {}
    for lang, part, _, text in sorted(rows, key=lambda r: (r[2], r[3] or "")):
        h = want.setdefault((lang, part), hashlib.sha256())
        if text is not None:
            h.update(text.encode() + b"\0")
    got = {(r.lang, r.part): r.sha256 for r in ordered.folded_sha256(df, ["lang", "part"], "text", "i").collect()}
    assert got == {k: h.hexdigest() for k, h in want.items()}
    assert [r.sha256 for r in ordered.folded_sha256(df.limit(0), ["lang"], "text", "i").collect()] == []
    one = hashlib.sha256(b"".join(t.encode() + b"\0" for *_, t in sorted(rows, key=lambda r: (r[2], r[3] or "")) if t is not None)).hexdigest()
    assert ordered.folded_sha256(df, [], "text", "i").first().sha256 == one
