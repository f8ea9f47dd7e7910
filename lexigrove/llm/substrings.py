"""Exact repeated-window removal by super-k-mer partitioning.

Every run of consecutive windows that share a minimiser (the least hash of its six-word grams) is one super-k-mer.
Phase 1 sends only keys: minimiser, hash of the run's words, row. Runs with equal words are counted first, so a passage
that a third of all documents shares is one row after the partial aggregation. A run seen twice is repeated whole. Runs
that share a minimiser but differ in words are compared window by window: one copy of each travels as one packed string
to its minimiser's bucket, where sorting counts windows exactly. A minimiser with more than ``HOT`` different runs (the
edges of a very common passage) is not one bucket: its windows are spread by their own words.

A window that also starts anywhere else, in any row, has all its words removed; windows are judged on the input.

Null and empty texts have no words; texts shorter than a window lose none. Repeated rows are occurrences like any other,
so both lose their text. Rows are told apart by a 128-bit hash of id and text, hence null and repeated ids do no harm.
Very long texts are one array step each. Other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.llm.common import NON_SPACE, Words, arrow_map, carried, mix64, release, staged, text_steps

WINDOW, GRAM = 35, 6
HOT = 1024
_MUL = np.uint64(0xA24BAED4963EE407)
_INV = np.uint64(pow(0xA24BAED4963EE407, -1, 1 << 64))


class Runs:
    """Super-k-mers of consecutive texts: minimiser, hash of words, first window (as word index), windows, text."""

    def __init__(self, words: Words, window: int):
        h = words.hashes()
        n, gram = len(h), min(GRAM, window)
        span = window - gram + 1
        counts = np.maximum(words.counts() - window + 1, 0)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        starts = np.repeat(words.bound[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        if not len(starts):
            self.m = self.c = np.zeros(0, np.uint64)
            self.start = self.windows = self.doc = np.zeros(0, np.int64)
            self.again = np.zeros(0, bool)
            return
        g = h[: n - gram + 1].copy()
        for k in range(1, gram):
            g = g * _MUL + h[k : n - gram + 1 + k]
        g = mix64(g)
        grams = g.copy()
        # Least over a span: doubling, then two overlapping stretches.
        width = 1
        while width * 2 <= span:
            g[: len(g) - width] = np.minimum(g[: len(g) - width], g[width:])
            width *= 2
        least = np.minimum(g[starts], g[starts + span - width])
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        self.windows = np.diff(np.concatenate((first, [len(starts)])))
        self.m, self.start, self.doc = least[first], starts[first], self.doc[first]
        # Does the run hold its minimiser more than once? Only then can it repeat a window itself.
        size = self.windows + span - 1
        at = np.repeat(self.start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        self.again = np.add.reduceat((grams[at] == np.repeat(self.m, size)).astype(np.int64), np.cumsum(size) - size) > 1
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _MUL))))
        back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _INV))))
        total = np.concatenate(([np.uint64(0)], np.cumsum(h * power)))
        part = (total[self.start + self.windows + window - 1] - total[self.start]) * back[self.start]
        self.c = mix64(mix64(part) + self.windows.astype(np.uint64))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    return docs.select(F.xxhash64(i, t).alias("__r1"), F.xxhash64(F.lit(1), i, t).alias("__r2"), *(F.col(f"`{c}`") for c in docs.columns))


def _runs(keyed: DataFrame, text: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_steps(batch.column(2)):
                words = Words(data, offs, NON_SPACE)
                r = Runs(words, window)
                rows = pa.array(r.doc)
                part = batch.slice(lo, hi - lo)
                own = [part.column(k).take(rows) for k in (0, 1)]
                made = [r.m.view(np.int64), r.c.view(np.int64), (r.start - words.bound[r.doc]).astype(np.int64), r.windows.astype(np.int64), r.again]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, made)], names=["r1", "r2", "m", "c", "start", "windows", "again"])

    return arrow_map(keyed.select("__r1", "__r2", F.col(f"`{text}`")), run, "r1 long, r2 long, m long, c long, start long, windows long, again boolean")


def _packed(texts: DataFrame, window: int) -> DataFrame:
    """(m, c, seen, kinds, words): the wanted runs of each text as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_steps(batch.column(0)):
                words = Words(data, offs, NON_SPACE)
                r = Runs(words, window)
                bounds = np.searchsorted(r.doc, np.arange(hi - lo + 1))
                rows = []
                for d, wanted in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    want = {(x["m"], x["c"]): x for x in wanted}
                    for k in range(bounds[d], bounds[d + 1]):
                        x = want.pop((int(r.m[k : k + 1].view(np.int64)[0]), int(r.c[k : k + 1].view(np.int64)[0])), None)
                        if x:
                            a, b = int(r.start[k]), int(r.start[k] + r.windows[k] + window - 1)
                            body = data[words.starts[a] : words.ends[b - 1]].tobytes()
                            rows.append((x["m"], x["c"], x["seen"], x["kinds"], b" ".join(body.split()).decode()))
                types = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["m", "c", "seen", "kinds", "words"])

    return arrow_map(texts, run, "m long, c long, seen long, kinds long, words string")


@cache
def _factors(window: int) -> np.ndarray:
    return np.random.default_rng(window).integers(0, 1 << 64, (window, 2), dtype=np.uint64) | np.uint64(1)


def _in_bucket(group: list[tuple[int, int, str]], window: int) -> Iterator[tuple[int, list[int]]]:
    """(c, offsets of repeated windows) of runs with one minimiser: (c, times seen, words)."""
    ids: dict[str, int] = {}
    parts, weights, owners, offsets = [], [], [], []
    for k, (_, seen, text) in enumerate(group):
        w = np.array([ids.setdefault(x, len(ids)) for x in text.split(" ")], np.int32)
        n = len(w) - window + 1
        parts.append(w)
        weights.append(np.full(n, seen))
        owners.append(np.full(n, k))
        offsets.append(np.arange(n))
    # Two independent 64-bit keys a window, whatever the size of the bucket: sums of mixed words times odd factors by place.
    mixed, factors = mix64(np.arange(1, len(ids) + 1, dtype=np.uint64)), _factors(window)
    keys = [np.lib.stride_tricks.sliding_window_view(mixed[w], window) @ factors for w in parts]
    rows = np.ascontiguousarray(np.concatenate(keys)).view("V16").ravel()
    owners, offsets = np.concatenate(owners), np.concatenate(offsets)
    _, which = np.unique(rows, return_inverse=True)
    twice = np.bincount(which, np.concatenate(weights))[which] > 1
    for k in np.unique(owners[twice]).tolist():
        yield group[k][0], offsets[twice & (owners == k)].tolist()


def _counted(packed: DataFrame, window: int) -> DataFrame:
    """(m, c, offsets) from buckets: rows of a minimiser are consecutive, and read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            at, group = None, {}
            for batch in batches:
                for m, c, seen, words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if m != at:
                        if len(group):
                            yield at, list(group.values())
                        at, group = m, {}
                    group[c] = (c, seen, words)
            if len(group):
                yield at, list(group.values())

        for m, group in groups():
            found = list(_in_bucket(group, window))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(found), pa.int64()), pa.array([c for c, _ in found], pa.int64()), pa.array([o for _, o in found], pa.list_(pa.int64()))], names=["m", "c", "offsets"])

    rows = packed.select("m", "c", "seen", "words").repartition("m").sortWithinPartitions("m")
    return arrow_map(rows, run, "m long, c long, offsets array<long>")


def _spread(packed: DataFrame, window: int) -> DataFrame:
    """(m, c, offsets) for minimisers with very many runs: windows are grouped by their own words."""
    words = F.split("words", " ")
    one = packed.dropDuplicates(["m", "c"]).select("m", "c", "seen", words.alias("w"))
    each = F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.struct(i.cast("long").alias("o"), F.array_join(F.slice("w", i + 1, window), " ").alias("t")))
    rows = one.select("m", "c", "seen", F.explode(each).alias("x")).select("m", "c", "seen", "x.o", "x.t")
    twice = rows.groupBy("t").agg(F.sum("seen").alias("n")).filter("n > 1").select("t")
    return rows.join(twice, "t", "left_semi").groupBy("m", "c").agg(F.collect_list("o").alias("offsets"))


def _kept(joined: DataFrame, out: T.StructType, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_steps(batch.column(batch.num_columns - 2)):
                words = Words(data, offs, NON_SPACE)
                part = batch.slice(lo, hi - lo)
                spans = part.column(part.num_columns - 1).to_pylist()
                texts, removed = [], []
                for d in range(hi - lo):
                    a, b = int(words.bound[d]), int(words.bound[d + 1])
                    own = data[offs[d] : offs[d + 1]].tobytes().split()
                    gone = np.zeros(b - a + 1, np.int64)
                    for s in spans[d] or ():
                        if s["offsets"] is None:
                            gone[s["start"]] += 1
                            gone[s["start"] + s["windows"] + window - 1] -= 1
                        else:
                            at = s["start"] + np.array(s["offsets"], np.int64)
                            np.add.at(gone, at, 1)
                            np.subtract.at(gone, at + window, 1)
                    keep = np.cumsum(gone)[:-1] == 0
                    removed.append(int(len(keep) - keep.sum()))
                    texts.append((b" ".join(own) if keep.all() else b" ".join([own[k] for k in np.flatnonzero(keep).tolist()])).decode())
                made = [pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *made], names=out.names)

    return arrow_map(joined, run, out)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns (default all), ``n_words``, ``n_removed`` and ``kept_text``: the words left, one space between."""
    spark = docs.sparkSession
    # Columns travel under names of their own, so that none can clash or hold dots.
    names = carried(docs, keep, ["n_words", "n_removed", "kept_text"])
    own = [f"c{k}" for k in range(len(names))]
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(names, own, strict=True)), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = _removed(spark, docs, window, own)
    return found.select(*(F.col(n).alias(c) for c, n in zip(names, own, strict=True)), "n_words", "n_removed", "kept_text")


def _removed(spark: SparkSession, docs: DataFrame, window: int, kept: list[str]) -> DataFrame:
    """``kept`` columns and what ``remove_repeats`` adds, of documents (…, doc_id, text)."""
    doc_id, text = "doc_id", "text"
    keyed = _keyed(docs, doc_id, text)
    runs = staged(_runs(keyed, text, window), "runs")
    kinds = runs.groupBy("m", "c").agg(F.count(F.lit(1)).alias("seen"), F.min("r1").alias("r1"), F.max("again").alias("again"))
    kinds = staged(kinds, "kinds")
    release(spark)
    many = kinds.groupBy("m").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    unlike = kinds.join(many, "m", "left").filter((F.col("kinds") > 1) | F.col("again")).withColumn("kinds", F.coalesce("kinds", F.lit(1).cast("long")))
    wanted = unlike.groupBy("r1").agg(F.collect_list(F.struct("m", "c", "seen", "kinds")).alias("wanted"))
    texts = keyed.select(F.col("__r1").alias("r1"), F.col(f"`{text}`").alias("text")).join(wanted, "r1").select("text", "wanted")
    packed = staged(_packed(texts, window), "packed")
    release(spark)
    some = _counted(packed.filter(F.col("kinds") <= HOT), window)
    if packed.filter(F.col("kinds") > HOT).limit(1).count():
        some = some.union(_spread(packed.filter(F.col("kinds") > HOT), window))
    whole = kinds.filter("seen > 1").select("m", "c", F.lit(None).cast("array<long>").alias("offsets"))
    alone = kinds.filter("seen = 1").select("m", "c")
    marks = staged(whole.union(some.join(alone, ["m", "c"], "left_semi").select("m", "c", "offsets")), "marks")
    release(spark)
    spans = runs.join(marks, ["m", "c"]).groupBy("r1", "r2").agg(F.collect_list(F.struct("start", "windows", "offsets")).alias("__spans"))
    spans = staged(spans, "spans")
    release(spark)
    joined = keyed.join(spans, (F.col("__r1") == F.col("r1")) & (F.col("__r2") == F.col("r2")), "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text"), "__spans")
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return _kept(joined, T.StructType([*joined.schema.fields[:-2], *more]), window)


def clean(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated windows out of ``text``; a text that loses nothing stays as it is."""
    own = [f"__own{k}" for k in range(len(docs.columns))]
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)))
    at = own[docs.columns.index(text)]
    found = remove_repeats(inner, window, doc_id=own[docs.columns.index(doc_id)], text=at)
    left = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(at))
    return found.select(*((left if n == at else F.col(n)).alias(c) for c, n in zip(docs.columns, own, strict=True)))
