"""How far proposals, or a prediction and gold labels, agree. Everything is a sum over contingency cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def membership(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(proposal, text_id, cluster): of several clusters in one proposal the last one counts."""
    return rows.groupBy("proposal", "text_id").agg(F.max_by("cluster", F.struct(order, "cluster")).alias("cluster"))


def paired(members: DataFrame) -> DataFrame:
    """(a, b, text_id, ca, cb) of every two proposals: an equi-join on the text, with the order as a residual."""
    x = members.select("text_id", F.col("proposal").alias("a"), F.col("cluster").alias("ca"))
    y = members.select("text_id", F.col("proposal").alias("b"), F.col("cluster").alias("cb"))
    return x.join(y, "text_id").filter("a < b")


def contingency(pairs: DataFrame, by: list[str], left: str = "ca", right: str = "cb") -> DataFrame:
    return pairs.groupBy(*by, left, right).agg(F.count(F.lit(1)).alias("n"))


def _margins(table: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Cells with both margins and the total. Tables have clusters, not texts, so windows over them are small."""
    return table.withColumns({"na": F.sum("n").over(Window.partitionBy(*by, left)), "nb": F.sum("n").over(Window.partitionBy(*by, right)), "total": F.sum("n").over(Window.partitionBy(*by))})


def agreement_rate(table: DataFrame, by: list[str], left: str = "ca") -> DataFrame:
    top = table.groupBy(*by, left).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return top.groupBy(*by).agg(F.sum("n").cast("long").alias("n_common"), (F.sum("top") / F.sum("n")).alias("agreement"))


def partition_scores(table: DataFrame, by: list[str], left: str = "ca", right: str = "cb") -> DataFrame:
    """n, ari and nmi (natural logarithm, arithmetic mean); 1 where both partitions are trivial."""
    pick = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    p = lambda c: F.col(c) / F.col("total")
    cells = _margins(table, by, left, right)
    share = F.col("n") / F.col("na"), F.col("n") / F.col("nb")
    sums = cells.groupBy(*by).agg(
        F.max("total").alias("total"), F.sum(pick("n")).alias("sij"),
        # Margins repeat in each cell of their row: weighed by the cell's share, they count once.
        F.sum(pick("na") * share[0]).alias("sa"), F.sum(pick("nb") * share[1]).alias("sb"),
        F.sum(p("n") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"),
        F.sum(-p("na") * F.log(p("na")) * share[0]).alias("ha"), F.sum(-p("nb") * F.log(p("nb")) * share[1]).alias("hb"),
    )
    expected = F.col("sa") * F.col("sb") / F.nullif(pick("total"), F.lit(0.0))
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.coalesce((F.col("sij") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0))
    mean = (F.col("ha") + F.col("hb")) / 2
    nmi = F.when(mean < 1e-12, 1.0).otherwise(F.col("mi") / mean)
    return sums.select(*by, F.col("total").cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def cluster_entropy(table: DataFrame, by: list[str], left: str = "ca", right: str = "cb") -> DataFrame:
    """(by, side, cluster, entropy in bits) of clusters on either side that the other side splits."""
    def side(name: str, own: str) -> DataFrame:
        w = Window.partitionBy(*by, own)
        q = F.col("n") / F.sum("n").over(w)
        cells = table.select(*by, F.lit(name).alias("side"), F.col(own).alias("cluster"), (-q * F.log2(q)).alias("e"), "n")
        return cells.groupBy(*by, "side", "cluster").agg(F.sum("e").alias("entropy"), F.sum("n").cast("long").alias("n"))

    return side("a", left).union(side("b", right)).filter("entropy > 1e-12")


def top_entropy(entropies: DataFrame, by: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.round("entropy", 10).desc(), "side", "cluster")
    return entropies.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def agreement_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("ari").alias("mean_ari"), F.count(F.lit(1)).alias("pairs"))


def element_similarity(pairs: DataFrame) -> DataFrame:
    """(text_id, similarity): the share of other texts, over proposal pairs, whose company with it both agree on.

    Counts replace the comparison of every two texts: with N texts in common, na, nb and nab in the text's clusters
    and in both, N - na - nb + 2 nab - 1 of N - 1 agree.
    """
    cells = _margins(contingency(pairs, ["a", "b"]), ["a", "b"], "ca", "cb")
    at = pairs.join(cells, ["a", "b", "ca", "cb"])
    same = F.col("total") - F.col("na") - F.col("nb") + 2 * F.col("n") - 1
    sums = at.groupBy("text_id").agg(F.sum(same).alias("same"), F.sum(F.col("total") - 1).alias("of"))
    return sums.select("text_id", F.coalesce(F.col("same") / F.nullif(F.col("of"), F.lit(0)), F.lit(1.0)).alias("similarity"))
