"""Scoring of predictions: assignment accuracy, costs, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.operators.agreement import partition_scores


def best_assignment(weight: list[list[float]]) -> list[int]:
    """Row -> column (or -1) of a one-to-one assignment with the largest total weight, for any rectangle.

    Shortest augmenting paths with potentials on the negated matrix: a row at a time, O(rows^2 * columns).
    """
    if not weight or not weight[0]:
        return [-1] * len(weight)
    turned = len(weight) > len(weight[0])
    cost = [[-x for x in col] for col in zip(*weight, strict=True)] if turned else [[-x for x in row] for row in weight]
    n, m = len(cost), len(cost[0])
    row_price, col_price, holder = [0.0] * n, [0.0] * m, [-1] * m
    for start in range(n):
        reach, came, done = [float("inf")] * m, [-1] * m, [False] * m
        row, col, spent = start, -1, 0.0
        while True:
            nearest, least = -1, float("inf")
            for j in range(m):
                if done[j]:
                    continue
                through = spent + cost[row][j] - row_price[row] - col_price[j]
                if through < reach[j]:
                    reach[j], came[j] = through, col
                if reach[j] < least:
                    nearest, least = j, reach[j]
            done[nearest], col, spent = True, nearest, least
            if holder[col] < 0:
                break
            row = holder[col]
        row_price[start] += spent
        for j in range(m):
            if done[j] and holder[j] >= 0:
                row_price[holder[j]] += spent - reach[j]
            if done[j]:
                col_price[j] += reach[j] - spent
        while col >= 0:
            before = came[col]
            holder[col] = holder[before] if before >= 0 else start
            col = before
    out = [-1] * len(weight)
    for j, i in enumerate(holder):
        if i >= 0:
            if turned:
                out[j] = i
            else:
                out[i] = j
    return out


def hungarian_accuracy(table: DataFrame, left: str = "ca", right: str = "cb") -> DataFrame:
    """One row, n and acc. Only the contingency cells, clusters times labels, come to the driver."""
    cells = table.groupBy(left, right).agg(F.sum("n").cast("long").alias("n")).collect()
    rows, cols = sorted({c[left] for c in cells}), sorted({c[right] for c in cells})
    at = {(c[left], c[right]): c["n"] for c in cells}
    weight = [[at.get((r, c), 0) for c in cols] for r in rows]
    total = sum(at.values())
    hit = sum(weight[i][j] for i, j in enumerate(best_assignment(weight)) if j >= 0)
    return table.sparkSession.createDataFrame([(total, hit / total if total else 0.0)], "n long, acc double")


def predictions(docs: DataFrame, rows: DataFrame, order: str = "ord", k: int | None = None) -> DataFrame:
    """Documents with cluster (-1 for none, '' or missing) and confidence / 5; of repeated ids the last row counts.

    Computing it fails on an id that is no number or, given ``k``, not below it.
    """
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("cluster", "confidence"), order).alias("r")).select("doc_id", "r.*")
    none = F.coalesce(F.col("cluster"), F.lit("")).isin("", "none")
    number = F.expr("try_cast(cluster as int)")
    known = number.isNotNull() if k is None else (number >= 0) & (number < k)
    unknown = F.raise_error(F.concat(F.lit("unknown cluster id: "), F.col("cluster"))).cast("int")
    return docs.join(last, "doc_id", "left").withColumn("predicted_cluster_id", F.when(none, F.lit(-1)).when(known, number).otherwise(unknown)).withColumn("confidence", F.col("confidence") / 5)


def best_cells(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(panel, method, dataset, metric, value, best): means over seeds; all ties for the best are marked."""
    means = rows.groupBy("panel", "method", "dataset").agg(*(F.avg(m).alias(m) for m in metrics))
    long = means.unpivot(["panel", "method", "dataset"], metrics, "metric", "value").filter("value is not null")
    top = F.max(F.round("value", 6)).over(Window.partitionBy("panel", "dataset", "metric"))
    return long.withColumn("best", F.round("value", 6) == top)


def predicted_k(rows: DataFrame, by: list[str], cluster: str = "predicted_cluster_id") -> DataFrame:
    return rows.groupBy(*by).agg(F.nullif(F.countDistinct(F.when(F.col(cluster) >= 0, F.col(cluster))), F.lit(0)).alias("predicted_k"))


def token_cost(usage: DataFrame, prices: tuple[float, float, float]) -> DataFrame:
    """``usd`` from tokens in, cached and out, at prices a million."""
    parts = [F.col(c) * p for c, p in zip(("input_tokens", "cache_tokens", "output_tokens"), prices, strict=True)]
    return usage.withColumn("usd", (parts[0] + parts[1] + parts[2]) / 1e6)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, label, similarity): the centroid of the largest cosine. Centroids are one array in each task."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    held = F.broadcast(centroids.agg(F.collect_list(F.struct("label", "centroid")).alias("held")))
    v = F.col(vector)
    sims = F.transform("held", lambda c: F.struct(F.round(dot(v, c.centroid) / F.sqrt(dot(v, v) * dot(c.centroid, c.centroid)), 10).alias("s"), (-c.label).alias("l")))
    return vectors.crossJoin(held).withColumn("top", F.array_max(sims)).select(key, (-F.col("top.l")).alias("label"), F.col("top.s").alias("similarity"))


def centroids(vectors: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """(label, centroid): element-wise means, one partial sum a task and dimension."""
    each = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(F.col(label).alias("label")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("centroid"))


def recent(log: DataFrame, order: list[str], most: int) -> DataFrame:
    return log.orderBy(*(F.col(c).desc() for c in order)).limit(most)


def run_k_range(k: Column) -> tuple[Column, Column]:
    return F.rint(k * 0.8).cast("int"), F.rint(k * 1.2).cast("int")


def metrics_bundle(cells: DataFrame, left: str = "ca", right: str = "cb") -> dict[str, float]:
    """n, ari, nmi and acc of a contingency (left, right, n)."""
    scores = partition_scores(cells, [], left, right).first()
    return {"n": scores["n"], "ari": scores["ari"], "nmi": scores["nmi"], "acc": hungarian_accuracy(cells, left, right).first()["acc"]}


def display_label(cluster: Column) -> Column:
    return F.when(cluster == -1, F.lit("noise")).otherwise(F.concat(F.lit("cluster_"), cluster.cast("string")))


def topics_asked(k: int, has_none: bool) -> tuple[int, bool]:
    """(topics to ask a density method for, whether outliers must be assigned): it counts outliers as one topic."""
    return k + 1, not has_none


def label_ids(rows: DataFrame, labels: DataFrame, sentinels: dict[str, str]) -> DataFrame:
    """``rows`` (…, label) with cluster_id (``ord`` of the label in ``labels``, else null) and status: ok, missing (no
    label), the name that ``sentinels`` gives a label, or hallucinated for any other."""
    known = labels.groupBy("label").agg(F.max("ord").cast("int").alias("cluster_id"))
    status = F.when(F.col("label").isNull(), F.lit("missing"))
    for label, name in sentinels.items():
        status = status.when(F.col("label") == label, F.lit(name))
    both = rows.join(known, "label", "left")
    return both.withColumn("status", status.when(F.col("cluster_id").isNull(), F.lit("hallucinated")).otherwise("ok"))


def cost_totals(methods: DataFrame, cells: DataFrame) -> DataFrame:
    """A row a method: subscription and total usd over its cells, null if it has none."""
    sums = cells.groupBy("method").agg(F.sum(F.coalesce("subscription_usd", F.lit(0.0))).alias("subscription_usd"), F.sum(F.coalesce("usd", F.lit(0.0))).alias("usd"))
    return methods.select("method").distinct().join(sums, "method", "left")


def accumulated_usage(passes: DataFrame, by: str, order: str) -> DataFrame:
    """A row a run: tokens summed over its passes, n_passes, the passes in order and the share of cached input."""
    fields = ("input_tokens", "cache_tokens", "output_tokens")
    out = passes.groupBy(by).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in fields), F.count(F.lit(1)).alias("n_passes"), F.sort_array(F.collect_list(F.struct(order, *fields))).alias("passes")
    )
    return out.withColumn("cache_hit_rate", F.coalesce(F.col("cache_tokens") / F.nullif(F.col("cache_tokens") + F.col("input_tokens"), F.lit(0)), F.lit(0.0)))


def results_table(cells: DataFrame, datasets: list[str], metrics: list[str]) -> DataFrame:
    """(panel, method, <dataset>_<metric>…, <dataset>_<metric>_best…) of ``best_cells``; a cell that was not run is null."""
    names = [f"{d}_{m}" for d in datasets for m in metrics]
    named = cells.withColumn("cell", F.concat_ws("_", "dataset", "metric"))
    pick = lambda n, c: F.max(F.when(F.col("cell") == n, F.col(c)))
    return named.groupBy("panel", "method").agg(*(pick(n, "value").alias(n) for n in names), *(pick(n, "best").alias(f"{n}_best") for n in names))
