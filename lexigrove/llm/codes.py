"""Vector code compression: product codes from Lloyd rounds that move only what changed.

Vectors and the last assignment lie in two tables with the same buckets, so that a round joins them in place. Each task
assigns its rows anew and states, once a batch, what the changed parts take from their old entry and give to their new
one; only these sums are shuffled. The driver adds them to running integer sums, one a part, entry and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import arrow_map, bucketed, carried, shuffle_width, staged
from lexigrove.operators.blocks import matrix, named, scaled, sound

DELTA = "array<struct<part:int,entry:int,n:long,sums:array<long>>>"
_ARROW = pa.schema([("rid", pa.int64()), ("code", pa.binary()), ("error", pa.int64()), ("delta", pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))])


@dataclass
class Codes:
    """``rows``: key, carried columns, code (two hex digits a part), error. ``books``: part x entry x component."""

    rows: DataFrame
    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each row and part, squared distance to it); ties go to the lower index. All integers."""
    parts, _, width = books.shape
    x = x.reshape(len(x), parts, width)
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * width * peak * peak < 1 << 53 else np.int64  # doubles hold these integers exactly
    code, error = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for p in range(parts):
        part, book = x[:, p].astype(kind), books[p].astype(kind)
        far = (book * book).sum(axis=1) - 2 * (part @ book.T)
        code[:, p] = far.argmin(axis=1)
        error[:, p] = (far.min(axis=1) + (part * part).sum(axis=1)).astype(np.int64)
    return code, error


def changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, parts: int, entries: int) -> list[dict]:
    """What entries lose and gain by the parts whose entry changed; ``old`` is None in the first round."""
    width, out = x.shape[1] // parts, []
    for p in range(parts):
        at = np.arange(len(x)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        part = x[at, p * width : (p + 1) * width]
        n, sums = np.zeros(entries, np.int64), np.zeros((entries, width), np.int64)
        for sign, entry in ((1, new[at, p]), *(() if old is None else ((-1, old[at, p]),))):
            n += sign * np.bincount(entry, minlength=entries)
            for j in range(width):
                sums[:, j] += sign * np.rint(np.bincount(entry, weights=part[:, j], minlength=entries)).astype(np.int64)
        touched = np.flatnonzero((n != 0) | (sums != 0).any(axis=1))
        out += [{"part": p, "entry": int(e), "n": int(n[e]), "sums": sums[e].tolist()} for e in touched]
    return out


def _round(books: np.ndarray, first: bool, dim: int):
    parts, entries, _ = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), dim, np.int64)
            code, error = assign(x, books)
            old = None if first else np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(code.shape).astype(np.int64)
            delta = [changes(x, old, code, parts, entries), *[None] * (b.num_rows - 1)]
            values = [b.column("rid"), pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()), pa.array(error.sum(axis=1)), pa.array(delta, _ARROW.field("delta").type)]
            yield pa.RecordBatch.from_arrays(values, schema=_ARROW)

    return run


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, buckets: int | None = None
) -> Codes:
    """Product codes of ``vectors``: a code of ``parts`` entries a row, of at most 256 ``entries`` a part.

    Components become floor(scale * x). A part's codebook starts as that part of the ``entries`` least keys, ascending
    (of rows that share a key the least vector; a null key comes last; fewer keys, fewer entries). Each round assigns every
    part to the nearest entry, ties to the lower index, and replaces entries by floor(sum / count); an entry without parts
    stays. At the end parts are assigned once more.

    Left out are rows whose vector is null or holds null, NaN or infinite components, and those whose length differs from
    that of the least key's vector or is no positive multiple of ``parts``. Repeated rows and keys are rows of their own.
    An empty table gives no rows and empty codebooks. Scaled components of 2^27 and more raise an error. Only ``key`` and
    ``keep`` are carried; other columns may have any name.
    """
    if entries > 256:
        raise ValueError("a code has one byte a part")
    spark, keep = vectors.sparkSession, carried(vectors, keep or [], [key, "code", "error"])
    row = F.struct(named(key).alias("key"), *(named(c).alias(f"k{i}") for i, c in enumerate(keep)))
    rows = vectors.filter(sound(named(vector))).select(row.alias("row"), scaled(named(vector), scale).alias("x"))
    rows = rows.filter((F.size("x") > 0) & (F.size("x") % parts == 0)).withColumn("rid", F.monotonically_increasing_id())
    buckets = buckets or shuffle_width(spark)
    held, drop_held = bucketed(rows.repartition(buckets, "rid"), "vectors", "rid", buckets)
    dim = held.agg(F.min_by(F.size("x"), F.struct(F.col("row.key").isNull(), "row.key", "x")).alias("d")).first().d or parts
    held = held.filter(F.size("x") == dim)
    least = held.select("row.key").distinct().orderBy(F.col("key").asc_nulls_last()).limit(entries)
    start = held.join(F.broadcast(least), F.col("row.key").eqNullSafe(F.col("key"))).groupBy("key").agg(F.min("x").alias("x")).orderBy(F.col("key").asc_nulls_last()).collect()
    width = dim // parts
    books = np.array([r.x for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
    state, drop_state = None, lambda: None
    for k in range(rounds + 1 if start else 0):
        both = held.select("rid", "x") if state is None else held.select("rid", "x").join(state.select("rid", "code").hint("shuffle_hash"), "rid")
        new, drop_new = bucketed(arrow_map(both, _round(books, state is None, dim), f"rid long, code binary, error long, delta {DELTA}"), "codes", "rid", buckets)
        drop_state()
        state, drop_state = new, drop_new
        if k == rounds:
            break
        each = state.filter("delta is not null").select(F.explode("delta").alias("d")).select("d.*")
        total = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)]
        for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # at most parts x entries rows
            counts[r.part, r.entry] += r.n
            sums[r.part, r.entry] += [r[f"s{j}"] for j in range(width)]
        used = counts > 0
        books = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], books)
    found = held.select("rid", "row") if state is None else held.select("rid", "row").join(state.select("rid", "code", "error").hint("shuffle_hash"), "rid")
    if state is None:
        found = found.select("*", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    out = found.select(F.col("row.key").alias(key), *(F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)), F.lower(F.hex("code")).alias("code"), "error")
    out = staged(out, "vector_codes")
    drop_state()
    drop_held()
    return Codes(out, books)
