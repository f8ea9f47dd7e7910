"""Hard-negative mining by a dual-tree search over anchors and candidates.

Candidates lie in the cells of a balanced tree over a bounded sample, cells in blocks of bounded size, blocks in leaves.
Anchors lie in packs of a tree of their own. For a pair of nodes with centers a, b and radii r, s every inner product is
within |a| s + |b| r + r s of a.b. A pack goes down the candidates' tree and skips every node whose interval no anchor of
the pack can use; what is left is scored exactly, leaf by leaf. Each search is made twice: first over the block nearest to
the pack, for bounds on what each anchor can still use, then over all that is not pruned. Pruning changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import arrow_map, bucketed, shuffle_width, staged
from lexigrove.operators.blocks import Tree, block_of, block_starts, far_line, matrix, named, nearest, numbered, pack, sample, scaled, sound, whole

#: Rows a cell should hold, and the most cells; their centers and radii are sent to every task (2,048 x 64 doubles: 1 MB).
CELL_ROWS, MOST_CELLS = 1_024, 2_048
#: Rows of a block, of an anchors' pack and of a leaf within a block.
BLOCK_ROWS, PACK_ROWS, LEAF_ROWS = 512, 256, 64
LOW, HIGH = -(1 << 62), 1 << 62


@dataclass
class Cells:
    """The candidates' tree: node centers and radii over all rows, children, and the first block of each cell."""

    children: list[tuple[int, int]]
    mid: np.ndarray
    rad: np.ndarray
    starts: np.ndarray

    def reached(self, center: np.ndarray, radius: float, low: float, high: float) -> list[int]:
        """Cells that may hold a row whose product with a point of the ball is within [low, high]."""
        out, front = [], [0] if len(self.children) else []
        while front:
            at = np.array(front)
            mid, rad = self.mid[at], self.rad[at]
            dot, wide = mid @ center, np.linalg.norm(mid, axis=1) * radius + np.linalg.norm(center) * rad + radius * rad
            ok = (rad >= 0) & (dot + wide + slip(wide) >= low) & (dot - wide - slip(wide) <= high)
            front = []
            for i in at[ok]:
                a, b = self.children[i]
                if a < 0:
                    out.append(b)
                else:
                    front += [a, b]
        return out

    def best(self, center: np.ndarray) -> int:
        """The cell with rows whose center has the largest product with ``center``."""
        leaves = [(float(self.mid[i] @ center), -b, b) for i, (a, b) in enumerate(self.children) if a < 0 and self.rad[i] >= 0]
        return max(leaves)[2]


def slip(x: np.ndarray | float) -> np.ndarray | float:
    """More than what rounding can add to a bound."""
    return 1e-6 * np.abs(x) + 1e-3


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    center = x.mean(axis=0)
    return center, float(np.sqrt(((x - center) ** 2).sum(axis=1).max()))


def _leaves(x: np.ndarray, most: int = LEAF_ROWS) -> list[np.ndarray]:
    """Rows halved along far lines until no part has more than ``most``."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        order = at[np.argsort(far_line(x[at], x[at].mean(axis=0)), kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def _router(cells: Cells, dim: int, seed: bool):
    """Each pack once for every block that it must be held against; ``seed``: for the first block of its best cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                v = whole(row.column("v")[0].as_py(), "<i4").reshape(-1, dim).astype(float)
                low, high = whole(row.column("low")[0].as_py()), whole(row.column("high")[0].as_py())
                center, radius = _ball(v)
                if seed:
                    blocks = np.array([cells.starts[cells.best(center)]])
                else:
                    found = cells.reached(center, radius, float(low.min()), float(high.max()))
                    blocks = np.concatenate([np.arange(cells.starts[c], cells.starts[c + 1]) for c in found]) if found else np.zeros(0, np.int64)
                for lo in range(0, len(blocks), 16):
                    part = blocks[lo : lo + 16]
                    sent = row.take(pa.array(np.zeros(len(part), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *sent.columns], ["block", *(f"a_{c}" for c in row.schema.names)])

    return run


def _scorer(dim: int, k: int, same: bool):
    """The first ``k`` rows of a block for each wish of an anchor: its label or another, a product within [low, high]."""
    names = ["wish", "rid", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c, kind="<i8": whole(b.column(c)[i].as_py(), kind)  # noqa: B023, E731
                wish, own, a_label, low, high = get("a_wish"), get("a_rid"), get("a_label"), get("a_low"), get("a_high")
                rid, ids, label = get("rid"), get("id"), get("label")
                a, v = get("a_v", "<i4").reshape(-1, dim), get("v", "<i4").reshape(-1, dim)
                peak = dim * int(np.abs(a).max(initial=0)) * int(np.abs(v).max(initial=0))
                kind = np.float64 if peak < 1 << 53 else np.int64  # doubles hold these products exactly
                size = np.linalg.norm(a.astype(float), axis=1)
                product = np.full((len(a), len(v)), LOW, np.int64)
                for leaf in _leaves(v.astype(float)):
                    center, radius = _ball(v[leaf].astype(float))
                    dot, wide = a @ center, size * radius
                    use = np.flatnonzero((dot + wide + slip(wide) >= low) & (dot - wide - slip(wide) <= high))
                    if len(use):
                        product[np.ix_(use, leaf)] = (a[use].astype(kind) @ v[leaf].astype(kind).T).astype(np.int64)
                fit = (product >= low[:, None]) & (product <= high[:, None]) & (product > LOW) & ((a_label[:, None] == label) == same) & (own[:, None] != rid)
                w, c = np.nonzero(fit)
                order = np.lexsort((rid[c], ids[c], -product[w, c], w))
                w, c = w[order], c[order]
                keep = np.arange(len(w)) - np.searchsorted(w, w) < k
                w, c = w[keep], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (wish[w], rid[c], ids[c], product[w, c])], names)

    return run


class _Search:
    """Blocks of candidates and the packs that look for them."""

    def __init__(self, rows: DataFrame, anchors: Column, n: int, dim: int):
        self.width, self.dim = shuffle_width(rows.sparkSession), dim
        tree = Tree(sample(rows, n, dim), int(np.clip(-(-n // CELL_ROWS), 1, MOST_CELLS)))
        placed = staged(self._placed(rows, tree.centers), "negatives_cells")
        found = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # at most MOST_CELLS rows
        radii = np.full(len(tree.centers), -1.0)
        for r in found:
            radii[r.cell] = r.far
        starts = block_starts({r.cell: r.n for r in found}, len(radii), BLOCK_ROWS)
        self.cells = Cells(tree.children, *tree.cover(radii), starts)
        packed = pack(placed.withColumn("block", block_of(F.col("cell"), starts)), "block", ["rid", "id", "label"], "v", "<i4", dim, 2 * BLOCK_ROWS, self.width)
        self.blocks, self.drop = bucketed(packed, "candidates", "block", self.width)
        asked = rows.filter(anchors)
        m = asked.count()
        own = Tree(sample(asked, m, dim), int(np.clip(-(-m // PACK_ROWS), 1, MOST_CELLS)))
        asked = staged(self._placed(asked, own.centers), "negatives_anchors")
        sizes = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.anchors = asked.withColumn("pack", block_of(F.col("cell"), block_starts(sizes, len(own.centers), PACK_ROWS))).select("pack", "rid", "id", "label", "v")

    def _placed(self, rows: DataFrame, centers: np.ndarray) -> DataFrame:
        """``rows`` with the nearest of ``centers`` and the distance to it."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("v"), dim)
                cell = nearest(x, centers)
                far = np.sqrt(((x - centers[cell]) ** 2).sum(axis=1)) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*b.schema.names, "cell", "far"])

        return arrow_map(rows.select("rid", "id", "label", "v"), run, "rid long, id long, label long, v array<long>, cell int, far double")

    def _pass(self, wishes: DataFrame, k: int, same: bool, seed: bool) -> DataFrame:
        numbers = ["wish", "rid", "label", "low", "high"]
        packs = pack(wishes, "pack", numbers, "v", "<i4", self.dim, PACK_ROWS, self.width).drop("pack")
        routed = arrow_map(packs, _router(self.cells, self.dim, seed), "block long, " + ", ".join(f"a_{c} binary" for c in [*numbers, "v"]))
        found = arrow_map(routed.join(self.blocks.hint("merge"), "block").drop("block"), _scorer(self.dim, k, same), "wish long, rid long, id long, score long")
        at = F.row_number().over(Window.partitionBy("wish").orderBy(F.desc("score"), "id", "rid"))
        return found.withColumn("at", at).filter(F.col("at") <= k)

    def first(self, wishes: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """(wish, at, rid, id, score): the first ``k`` rows of each wish (pack, wish, rid, label, v, low, high)."""
        seen = self._pass(wishes, k, same, True).filter(F.col("at") == k).select("wish", F.col("score").alias("floor"))
        raised = wishes.join(seen, "wish", "left").withColumn("low", F.greatest("low", F.coalesce("floor", "low"))).drop("floor")
        return staged(self._pass(staged(raised, f"{name}_wishes"), k, same, False), name)


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), scores are inner products, higher first, ties by smaller key. An anchor's positives
    are its first ``positives`` other rows of its label; for each, its negatives are the first rows of other labels with a
    score of ``band`` per cent of the positive's. ``anchors`` is a condition on a column named ``id``, the key; ``label`` an
    integer column, ``label`` if not given.

    Left out are rows with a null key or label and rows whose vector is null, empty or holds null, NaN or infinite
    components, or has another length than that of the least key. Rows that repeat a key or a vector are rows of their own.
    An anchor without positives, and a positive without negatives, give no rows. Scaled components of 2^27 and more raise
    an error. Other columns may have any name.
    """
    spark = vectors.sparkSession
    label = named("label") if label is None else label
    fit = named(key).isNotNull() & label.isNotNull() & sound(named(vector)) & (F.size(named(vector)) > 0)
    rows, n, dim = numbered(vectors.filter(fit).select(named(key).alias("id"), label.cast("long").alias("label"), scaled(named(vector), scale).alias("v")), "negatives_rows")
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    search = _Search(rows, anchors, n, dim)
    asked = search.anchors
    wishes = asked.select("pack", F.col("rid").alias("wish"), "rid", "label", "v", F.lit(LOW + 1).alias("low"), F.lit(HIGH).alias("high"))
    good = search.first(wishes, positives, True, "positives")
    low, high = (F.expr(f"{f}(cast(score as decimal(20,0)) * {p} / 100)").cast("long") for f, p in (("ceil", band[0]), ("floor", band[1])))
    # a wish for each anchor and positive, numbered apart
    each = good.select(F.col("wish").alias("own"), "at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"), high.alias("high")).filter("low <= high")
    pairs = staged(asked.join(each, asked.rid == each.own).drop("own").withColumn("wish", F.monotonically_increasing_id()), "negatives_pairs")
    bad = search.first(pairs.select("pack", "wish", "rid", "label", "v", "low", "high"), negatives, False, "negatives")
    search.drop()
    of = pairs.select("wish", F.col("id").alias("anchor_id"), "positive_id", "positive_score")
    return of.join(bad, "wish").select("anchor_id", "positive_id", F.col("at").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
