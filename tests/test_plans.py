"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from lexigrove import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    text = lambda x: "NULL" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = plans.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL) - {"q40_lda", "q63_topic_words"}))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "similarity"]
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitioning_does_not_matter(spark, sf_dir, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("q17_high_entropy_clusters", "q24_tfidf_search", "q29_chat_requests", "q35_best_cells"):
            got = plans.QUERIES[name](spark, sf_dir).toPandas()
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            assert rows_of(got) == rows_of(plans.QUERIES[name](spark, sf_dir).toPandas())
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
