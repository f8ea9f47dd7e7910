"""Rows with vectors: sound rows, a balanced tree from a bounded sample, packed blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.scratch import arrow_map, staged

#: Rows of the sample on which trees and centroids are fitted.
SAMPLE_ROWS = 16_384
#: Scaled components beyond this are an error, as squares and sums of them must fit 64 bits.
LARGEST = 1 << 27


def named(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def sound(vector: Column) -> Column:
    """Is it a vector without null, infinite or undefined components?"""
    v = vector.cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vector: Column, scale: int) -> Column:
    """Components as integers floor(scale * x); an error where one is beyond ``LARGEST``."""
    v = vector.cast("array<double>")
    wide = F.exists(v, lambda x: F.abs(x * scale) >= LARGEST)
    error = F.raise_error(F.lit(f"a component is not below {LARGEST // scale}")).cast("array<long>")
    # of vectors that are not sound, null: no filter before this is relied on
    return F.when(sound(vector), F.when(wide, error).otherwise(F.transform(v, lambda x: F.floor(x * scale).cast("long"))))


def numbered(rows: DataFrame, name: str, key: str = "id", vector: str = "v") -> tuple[DataFrame, int, int]:
    """(rows written with a number ``rid`` each, how many, length of their vectors).

    Vectors of another length than that of the least ``key`` are left out.
    """
    written = staged(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size(vector)), name)
    dim = written.agg(F.min_by("dim", F.struct(F.col(key).isNull(), key, "rid")).alias("d")).first().d
    if dim is None:
        return written.drop("dim"), 0, 0
    right = written.filter(F.col("dim") == dim).drop("dim")
    return right, right.count(), dim


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)


def sample(rows: DataFrame, n: int, dim: int, most: int = SAMPLE_ROWS, vector: str = "v") -> np.ndarray:
    """About ``most`` rows by a hash of their number, never more: what is fitted on them is of bounded size."""
    share = min(1.0, most / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(vector).cast("array<double>").alias("v")).limit(most)
    found = drawn.toArrow().column("v")
    return matrix(found.combine_chunks(), dim) if len(found) else np.zeros((0, dim))


class Tree:
    """A balanced binary tree: each node halves its rows along the line through two far rows.

    ``centers`` are of the leaves, from left to right; ``children[i]`` are node numbers, or (-1, leaf) for a leaf.
    """

    def __init__(self, rows: np.ndarray, leaves: int):
        self.children: list[tuple[int, int]] = []
        self.centers: np.ndarray = np.zeros((0, rows.shape[1]))
        found: list[np.ndarray] = []

        def grow(x: np.ndarray, want: int) -> int:
            me = len(self.children)
            self.children.append((-1, -1))
            mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
            if want <= 1 or len(x) < 2:
                self.children[me] = (-1, len(found))
                found.append(mean)
                return me
            half = want // 2
            order = np.argsort(far_line(x, mean), kind="stable")
            cut = max(1, len(x) * half // want)
            left = grow(x[order[:cut]], half)
            self.children[me] = (left, grow(x[order[cut:]], want - half))
            return me

        grow(rows, leaves)
        self.centers = np.array(found).reshape(len(found), rows.shape[1])

    def cover(self, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(center, radius) of each node, given the radii of the leaves; a leaf without rows has radius -1."""
        mid, rad = np.zeros((len(self.children), self.centers.shape[1])), np.full(len(self.children), -1.0)
        for i in range(len(self.children) - 1, -1, -1):
            a, b = self.children[i]
            if a < 0:
                mid[i], rad[i] = self.centers[b], radii[b]
                continue
            mid[i] = (mid[a] + mid[b]) / 2
            rad[i] = max((rad[c] + np.linalg.norm(mid[i] - mid[c]) for c in (a, b) if rad[c] >= 0), default=-1.0)
        return mid, rad


def far_line(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Positions of the rows along the line through a row far from the mean and the row farthest from it."""
    p = x[np.argmax(((x - mean) ** 2).sum(axis=1))]
    q = x[np.argmax(((x - p) ** 2).sum(axis=1))]
    return x @ (q - p)


def nearest(x: np.ndarray, centers: np.ndarray, step: int = 2048) -> np.ndarray:
    """The nearest center of each row, the first of equals."""
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + step] @ centers.T - half, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


# ---------------------------------------------------------------- packed blocks


def pack(rows: DataFrame, block: str, numbers: list[str], vector: str, kind: str, dim: int, most: int, n_parts: int) -> DataFrame:
    """Rows (block, number columns, vector) as one row a block: ``numbers`` as little-endian int64, vectors as ``kind``.

    A block of more than ``most`` rows becomes several rows of the same block.
    """
    dealt = rows.select(block, *numbers, vector).repartition(n_parts, block).sortWithinPartitions(block, numbers[0])
    fields = [pa.field(block, pa.int64()), *(pa.field(c, pa.binary()) for c in [*numbers, vector])]
    schema = f"{block} long, " + ", ".join(f"{c} binary" for c in [*numbers, vector])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, current = 0, None

        def emit() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            vec = matrix(whole.column(vector).combine_chunks(), dim)
            values = [np.asarray(whole.column(c).to_numpy(), "<i8").tobytes() for c in numbers]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([current, *values, vec.astype(kind).tobytes()], fields, strict=True)], schema=pa.schema(fields))

        for b in batches:
            keys = b.column(block).to_numpy()
            at = 0
            while at < len(keys):
                if count and (keys[at] != current or count >= most):
                    yield emit()
                    held, count = [], 0
                current = int(keys[at])
                end = min(at + int(np.searchsorted(keys[at:], current, side="right")), at + most - count)
                held.append(b.slice(at, end - at))
                count, at = count + end - at, end
        if count:
            yield emit()

    return arrow_map(dealt, run, schema)


def whole(value: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(value, kind)


def block_starts(sizes: dict[int, int], lists: int, most: int) -> np.ndarray:
    """Where each list's blocks of about ``most`` rows begin; the last entry is how many there are."""
    return np.concatenate([[0], np.cumsum([-(-sizes.get(i, 0) // most) for i in range(lists)])]).astype(np.int64)


def block_of(lists: Column, starts: np.ndarray, rid: str = "rid") -> Column:
    """The block of a row within its list, by a hash of its number: a large list is many blocks."""
    first = F.lit([int(x) for x in starts])
    low, high = F.element_at(first, lists + 1), F.element_at(first, lists + 2)
    return low + F.pmod(F.xxhash64(rid), high - low)
