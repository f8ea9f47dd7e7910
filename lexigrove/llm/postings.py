"""Approximate nearest neighbours: balanced posting lists, a graph over their centroids, pruning by distance ratio.

Centroids are leaves of a balanced tree over a bounded sample. Every row lies in the list of its nearest centroid and of
those that are hardly farther. A query searches the graph over the centroids, takes the lists whose centroid is within a
ratio of the nearest one's distance, and scores all rows of these lists exactly. Lists lie in blocks of bounded size, so
a large list is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import arrow_map, bucketed, shuffle_width, spread, staged
from lexigrove.operators.blocks import Tree, block_of, block_starts, matrix, named, numbered, pack, sample, sound, whole

#: Rows a list should hold, and the most lists; centroids and graph are sent to every task (2,048 x 64 doubles: 1 MB).
LIST_ROWS, MOST_LISTS = 256, 2_048
#: Rows of a block, and queries that are scored against one at a time.
BLOCK_ROWS, QUERY_ROWS = 512, 256
#: Queries of which a task holds the nearest rows so far.
HELD_QUERIES = 20_000


@dataclass
class CentroidGraph:
    """Centroids, the neighbours of each, and the centroids at which searches start."""

    centers: np.ndarray
    links: np.ndarray
    entry: np.ndarray

    @classmethod
    def over(cls, centers: np.ndarray, degree: int = 16, entries: int = 8) -> CentroidGraph:
        """Each centroid's nearest others, and its neighbours in tree order, which make the graph connected."""
        n = len(centers)
        far = (centers**2).sum(axis=1) + (centers**2).sum(axis=1)[:, None] - 2 * centers @ centers.T
        np.fill_diagonal(far, np.inf)
        near = np.argsort(far, axis=1, kind="stable")[:, : min(degree, max(n - 1, 1))] if n > 1 else np.zeros((n, 1), np.int64)
        chain = np.stack([(np.arange(n) - 1) % max(n, 1), (np.arange(n) + 1) % max(n, 1)], axis=1)
        return cls(centers, np.concatenate([near, chain], axis=1), np.unique(np.linspace(0, n - 1, min(n, entries)).astype(int)))

    def within(self, x: np.ndarray, ratio: float, sizes: np.ndarray | None = None, need: int = 0, slack: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, distance) of centroids within (1 + ratio) of the nearest one's distance, all rows at once.

        Where their lists, of ``sizes`` rows, hold fewer than ``need`` rows, the next nearest come too. The search goes on
        from every centroid within the larger of ``ratio`` and ``slack`` until none is new."""
        n, c = len(x), len(self.centers)

        def limit(stretch: float) -> np.ndarray:
            most = far.min(axis=1) * (1 + stretch)
            if need:
                order = np.argsort(far, axis=1, kind="stable")
                near = np.take_along_axis(far, order, axis=1)
                held = np.cumsum(np.where(np.isfinite(near), sizes[order], 0), axis=1)
                enough = near[np.arange(n), (held >= need).argmax(axis=1)]
                most = np.maximum(most, np.where(held[:, -1] >= need, enough, np.inf))
            return most[:, None]

        far = np.full((n, c), np.inf)
        done = np.zeros((n, c), bool)
        far[:, self.entry] = np.sqrt(((x[:, None] - self.centers[self.entry]) ** 2).sum(axis=2))
        while True:
            rows, at = np.nonzero(~done & np.isfinite(far) & (far <= limit(max(ratio, slack))))
            if not len(rows):
                break
            done[rows, at] = True
            new = np.unique(np.repeat(rows, self.links.shape[1]) * c + self.links[at].ravel())
            r, k = new // c, new % c
            fresh = np.isinf(far[r, k])
            r, k = r[fresh], k[fresh]
            for i in range(0, len(r), 1 << 15):
                s = slice(i, i + (1 << 15))
                far[r[s], k[s]] = np.sqrt(((x[r[s]] - self.centers[k[s]]) ** 2).sum(axis=1))
        rows, at = np.nonzero(np.isfinite(far) & (far <= limit(ratio)))
        return rows, at, far[rows, at]


def _assigner(graph: CentroidGraph, dim: int, ratio: float, most: int):
    """Rows with ``lists``: the nearest centroid's and those within ``ratio``, at most ``most``, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows, at, far = graph.within(matrix(part.column("v"), dim), ratio)
                order = np.lexsort((at, far, rows))
                rows, at = rows[order], at[order]
                first = np.searchsorted(rows, np.arange(part.num_rows))
                keep = np.arange(len(rows)) - first[rows] < most
                counts = np.bincount(rows[keep], minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(at[keep].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "lists"])

    return run


def _router(graph: CentroidGraph, starts: np.ndarray, sizes: np.ndarray, dim: int, ratio: float, need: int):
    """Each query once for every block of the lists that it searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows, at, _ = graph.within(matrix(part.column("v"), dim), ratio, sizes, need)
                blocks = starts[at + 1] - starts[at]
                row, block = np.repeat(rows, blocks), spread(starts[at], blocks)
                for i in range(0, len(row), 4096):
                    sent = part.take(pa.array(row[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 4096], pa.int64()), sent.column("query"), sent.column("v")], ["block", "query", "v"])

    return run


def _scorer(dim: int, k: int):
    """The ``k`` nearest rows of each query among the blocks that a task reads; a query may come up more than once."""
    names = ["query", "rid", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            if best:
                query = np.repeat(list(best), [len(x[0]) for x in best.values()])
                values = [np.concatenate([x[i] for x in best.values()]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(query), *map(pa.array, values)], names)
                best.clear()

        for b in batches:
            for query, qv, rid, ids, v in zip(*(b.column(c).to_pylist() for c in ("query", "qv", "rid", "id", "v")), strict=True):
                rows, rid, ids = whole(v, "<f8").reshape(-1, dim), whole(rid), whole(ids)
                for q, x in zip(whole(query).tolist(), whole(qv, "<f8").reshape(-1, dim), strict=True):
                    score = np.sqrt(((rows - x) ** 2).sum(axis=1))
                    held = best.get(q)
                    if held is not None:
                        near = np.flatnonzero(score <= (held[2][-1] if len(held[2]) >= k else np.inf))
                        near = near[~np.isin(rid[near], held[0])]
                        r, i, s = (np.concatenate(x) for x in zip(held, (rid[near], ids[near], score[near]), strict=True))
                    else:
                        r, i, s = rid, ids, score
                    if len(s) > 4 * k:
                        near = np.flatnonzero(s <= np.partition(s, k - 1)[k - 1])
                        r, i, s = r[near], i[near], s[near]
                    order = np.lexsort((r, i, s))[:k]
                    best[q] = r[order], i[order], s[order]
                if len(best) > HELD_QUERIES:
                    yield from emit()
        yield from emit()

    return run


def search(
    vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", ratio: float = 0.15, replica_ratio: float = 0.02, replicas: int = 8, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS
) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest rows found of each row that fulfils ``queries``, itself left out.

    ``queries`` is a condition on a column named ``id``, the key. However narrow ``ratio``, the lists searched hold ``k``
    other rows or all. Score is the Euclidean distance in doubles; nearest
    first, ties to smaller keys. A wider ``ratio`` searches more lists and finds more; recall is measured, not promised.

    Left out are rows with a null key and rows whose vector is null, empty, zero or holds null, NaN or infinite components,
    or has another length than the vector of the least key. Rows that repeat a key or a vector are rows of their own; equal
    queries are searched once. Fewer than ``k`` rows give fewer ranks, an empty table none. Other columns may have any name.
    """
    spark = vectors.sparkSession
    v = named(vector)
    fit = named(key).isNotNull() & sound(v) & F.exists(v, lambda x: x != 0)
    rows, n, dim = numbered(vectors.filter(fit).select(named(key).alias("id"), v.cast("array<double>").alias("v")), "ann_rows")
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    lists = int(np.clip(-(-n // list_rows), 1, most_lists))
    graph = CentroidGraph.over(Tree(sample(rows, n, dim), lists).centers)
    lists = len(graph.centers)
    width = shuffle_width(spark)
    assigned = staged(arrow_map(rows.select("rid", "id", "v"), _assigner(graph, dim, replica_ratio, replicas), "rid long, id long, v array<double>, lists array<int>"), "ann_lists")
    postings = assigned.select("rid", "id", "v", F.explode("lists").alias("list"))
    sizes = {r.list: r["count"] for r in postings.groupBy("list").count().collect()}  # at most most_lists rows
    starts, held = block_starts(sizes, lists, BLOCK_ROWS), np.array([sizes.get(i, 0) for i in range(lists)])
    packed = pack(postings.withColumn("block", block_of(F.col("list"), starts)), "block", ["rid", "id"], "v", "<f8", dim, 2 * BLOCK_ROWS, width)
    index, drop = bucketed(packed, "postings", "block", width)

    asked = rows.filter(queries).select("rid", "id", "v")
    same = asked.groupBy("v").agg(F.min("rid").alias("query"))
    routed = arrow_map(same.select("query", "v"), _router(graph, starts, held, dim, ratio, replicas * (k + 1)), "block long, query long, v array<double>")
    sets = pack(routed, "block", ["query"], "v", "<f8", dim, QUERY_ROWS, width).withColumnRenamed("v", "qv")
    # one more than k, as the query itself is among them
    found = arrow_map(sets.join(index.hint("merge"), "block").select("query", "qv", "rid", "id", "v"), _scorer(dim, k + 1), "query long, rid long, id long, score double")
    once = found.groupBy("query", "rid").agg(F.first("id").alias("id"), F.first("score").alias("score"))
    top = staged(once.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("score", "id", "rid"))).filter(F.col("at") <= k + 1), "ann_top")
    drop()
    owners = asked.join(same, "v").select(F.col("rid").alias("own"), F.col("id").alias("query_id"), "query")
    each = owners.join(top, "query").filter("own <> rid")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy("score", "id", "rid"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
