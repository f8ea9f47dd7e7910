"""The registered queries over ``embeddings`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import codes, negatives, postings
from lexigrove.llm.common import table


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every sound vector, with errors by row and label."""
    found = codes.compress(table(spark, sf_dir, "embeddings"), keep=["label"])
    totals = found.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    both = found.rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} as materialized (select rid, part, min(d) % {entries} as e, min(d) // {entries} as error from (
            select x.rid, x.part, b.e, sum((x.x - b.x) * (x.x - b.x))::bigint * {entries} + b.e as d from x join b{k} b using (part, j) group by x.rid, x.part, b.e) group by rid, part)""")
        steps.append(f"""b{k + 1} as materialized (select b.part, b.e, b.j, coalesce(s.x, b.x) as x from b{k} b left join (
            select part, e, j, (sum(x)::bigint - (sum(x)::bigint % count(*) + count(*)) % count(*)) // count(*) as x from x join a{k} using (rid, part) group by part, e, j) s using (part, e, j))""")
    return f"""with kept as materialized (select row_number() over () as rid, vec_id, label, embedding from embeddings
            where embedding is not null and list_count(embedding) = len(embedding) and list_bool_and([isfinite(c) for c in embedding])),
        x as materialized (select rid, vec_id, (j - 1) // (len(embedding) // {parts}) as part, (j - 1) % (len(embedding) // {parts}) as j, floor(embedding[j]::double * {scale})::bigint as x
            from (select rid, vec_id, embedding, unnest(range(1, len(embedding) + 1)) as j from kept)),
        first as (select vec_id, row_number() over (order by vec_id) - 1 as e from (select distinct vec_id from kept) order by vec_id limit {entries}),
        b0 as materialized (select part, e, j, x from x join first using (vec_id)), {", ".join(steps)},
        r as (select kept.rid, kept.vec_id, kept.label, string_agg(lpad(printf('%x', a.e), 2, '0'), '' order by a.part) as code, sum(a.error)::bigint as error
            from kept join a{rounds} a using (rid) group by kept.rid, kept.vec_id, kept.label)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
            (select sha256(string_agg(x::varchar, ',' order by part, e, j)) from b{rounds}) as codebooks_sha256 from r"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are moved on by one."""
    i = F.col("vec_id")
    label = F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


_NEGATIVES_SQL = """with k as materialized (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(c::double * 256) for c in embedding] as v
        from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and list_count(embedding) = len(embedding) and list_bool_and([isfinite(c) for c in embedding])),
    s as materialized (select a.rid, a.vec_id as anchor_id, a.label = k.label as same, k.rid as other, k.vec_id as id, list_dot_product(a.v, k.v)::bigint as score
        from k a join k on a.rid <> k.rid where a.vec_id % 100 = 0),
    p as (select * from s where same qualify row_number() over (partition by rid order by score desc, id) <= 5)
    select p.anchor_id, p.id as positive_id, (row_number() over (partition by p.rid, p.other order by s.score desc, s.id))::int as rank, s.id as negative_id, p.score as positive_score, s.score as negative_score
    from p join s on p.rid = s.rid and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score qualify rank <= 10"""


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every hundredth one."""
    return postings.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES = {"op11_vector_codes": op11_vector_codes, "op12_hard_negatives": op12_hard_negatives, "op13_posting_lists": op13_posting_lists}
ORACLE_SQL = {"op11_vector_codes": _codes_sql(), "op12_hard_negatives": _NEGATIVES_SQL}
