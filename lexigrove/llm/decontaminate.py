"""Benchmark decontamination by an FM-index per training shard.

A shard is a bounded run of documents. Its words that no test item uses can be in no occurrence, so they become
separators; what is left, runs of test vocabulary long enough to hold a window, is the shard's indexed text. Over that
text: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix for rank, and every eighth suffix
position kept. All windows of all items are searched backwards together; occurrences are located by walking to a kept
position, and their spans are merged per document.

Test windows go to every task in blocks whose size is checked (``BLOCK_WORDS``); more items mean more passes over the
documents, never a larger broadcast. Documents never move: there is no shuffle.

Null and empty documents have no words and are clean; items without words match nothing; repeated items and documents
each count for themselves; an empty table on either side gives clean documents or no rows. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.llm.common import ALNUM_RAW, FOLD, Words, arrow_map, carried, text_steps

WINDOW = 10
#: Words of test items in one pass. The windows of a block are WINDOW times that many 32-bit symbols at most.
BLOCK_WORDS = 2_000_000
#: Bytes of text in a shard, and the distance of kept suffix positions.
SHARD_BYTES = 4 << 20
KEEP_EVERY = 8


class Tests:
    """A block of items: sorted word hashes as vocabulary, and windows as symbol rows by length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = np.array([i for i, _ in items], dtype=object)
        data = "\n".join(t for _, t in items).encode()
        ends = np.cumsum([len(t.encode()) + 1 for _, t in items]) if items else np.zeros(0, np.int64)
        offs = np.concatenate(([0], ends)).astype(np.int64)
        w = Words(np.frombuffer(data + b"\n" if items else b"", np.uint8), offs, ALNUM_RAW)
        h = w.hashes(FOLD)
        self.vocab = np.unique(h)
        symbols = (np.searchsorted(self.vocab, h) + 1).astype(np.int64)
        by: dict[int, tuple[list, list]] = {}
        for i in range(len(items)):
            s = symbols[w.bound[i] : w.bound[i + 1]]
            if len(s):
                size = min(window, len(s))
                rows, owners = by.setdefault(size, ([], []))
                rows.append(np.lib.stride_tricks.sliding_window_view(s, size))
                owners.append(np.full(len(s) - size + 1, i))
        self.windows = {k: (np.concatenate(r), np.concatenate(o)) for k, (r, o) in by.items()}
        self.shortest = min(self.windows, default=0)


class WaveletMatrix:
    """rank(symbol, i): how often a symbol occurs before i, for many at once."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        for k in range(self.bits - 1, -1, -1):
            bit = (seq >> k) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.levels.append((ones, len(seq) - int(ones[-1])))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        # Where each symbol's run starts at the bottom follows from the same walk with i = 0.

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for k, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> k) & 1).astype(bool)
            a, b = ones[lo], ones[i]
            lo = np.where(one, zeros + a, lo - a)
            i = np.where(one, zeros + b, i - b)
        return i - lo


class FMIndex:
    """Full-text index over symbols of at least 1; 0 is reserved for the end."""

    def __init__(self, text: np.ndarray, top: int):
        seq = np.concatenate((text, [0])).astype(np.int64)
        n = len(seq)
        order, rank, step = np.argsort(seq, kind="stable"), None, 1
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(seq[order]) != 0)))
        while rank[order[-1]] < n - 1:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            step *= 2
        self.n = n
        self.bwt = seq[order - 1]
        self.before = np.searchsorted(seq[order], np.arange(top + 2))
        self.wavelet = WaveletMatrix(self.bwt, top)
        self.kept = order % KEEP_EVERY == 0
        self.kept_rank = np.concatenate(([0], np.cumsum(self.kept)))
        self.kept_at = order[self.kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of each row of ``phrases``."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            lo[alive] = self.before[c] + self.wavelet.rank(c, lo[alive])
            hi[alive] = self.before[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to the nearest kept one."""
        at, steps, out = at.copy(), np.zeros(len(at), np.int64), np.empty(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            found = self.kept[at[todo]]
            done = todo[found]
            out[done] = self.kept_at[self.kept_rank[at[done]]] + steps[done]
            todo = todo[~found]
            c = self.bwt[at[todo]]
            at[todo] = self.before[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
        return out


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + len)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())


def shard_hits(words: Words, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(hit flag per word, distinct rows of document index and item index) for the documents of a shard."""
    hit = np.zeros(len(words), bool)
    none = np.zeros((0, 2), np.int64)
    if not len(words) or not tests.windows:
        return hit, none
    h = words.hashes(FOLD)
    at = np.minimum(np.searchsorted(tests.vocab, h), len(tests.vocab) - 1)
    known = tests.vocab[at] == h
    doc = words.owner()
    # Runs of known words within one document, of at least the shortest window.
    new = np.ones(len(h), bool)
    new[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(h)])))
    use = known[first] & (size >= tests.shortest)
    first, size = first[use], size[use]
    if not len(first):
        return hit, none
    # Indexed text: the runs, a separator after each; ``place`` leads back to the word.
    sep = len(tests.vocab) + 1
    place = _spread(first, size + 1)
    text = at[np.minimum(place, len(h) - 1)] + 1
    text[np.cumsum(size + 1) - 1] = sep
    index = FMIndex(text, sep)
    pairs = [none]
    for length, (phrases, owners) in tests.windows.items():
        lo, hi = index.search(phrases)
        some = np.flatnonzero(hi > lo)
        if not len(some):
            continue
        counts = hi[some] - lo[some]
        where = place[index.locate(_spread(lo[some], counts))]
        hit[_spread(where, np.full(len(where), length))] = True
        pairs.append(np.unique(np.stack((doc[where], np.repeat(owners[some], counts)), axis=1), axis=0))
    return hit, np.unique(np.concatenate(pairs), axis=0)


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Tests]:
    """Items in blocks of about BLOCK_WORDS words; each is collected only after its size is known."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // (6 * BLOCK_WORDS)))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        got = sorted((r.i or "", r.t) for r in part.collect())
        if got:
            yield Tests(got)


def find_spans(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", cleaned: bool = False) -> DataFrame:
    """``keep`` columns, ``n_words``, ``spans`` (word ranges [start, end) hit), ``items`` (ids with an occurrence).

    With ``cleaned``, also ``clean_text``: the text without the bytes from each span's first word to its last.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(t) for t in _blocks(items, item_id, item_text)]
    keep = carried(docs, keep, ["n_words", "spans", "items", *(["clean_text"] if cleaned else [])])
    own = [f"c{k}" for k in range(len(keep))]
    chosen = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, own, strict=True)), F.col(f"`{text}`").alias("in"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    more = [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))]
    more += [T.StructField("clean_text", T.StringType())] if cleaned else []
    out = T.StructType([*chosen.schema.fields[:-1], *more])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_steps(batch.column(batch.num_columns - 1), SHARD_BYTES):
                words = Words(data, offs, ALNUM_RAW)
                hit, named = np.zeros(len(words), bool), [[] for _ in range(hi - lo)]
                for block in blocks:
                    more_hit, pairs = shard_hits(words, block.value)
                    hit |= more_hit
                    for d, i in pairs.tolist():
                        named[d].append(block.value.names[i])
                spans: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
                cut = hit.copy()
                cut[1:] &= ~hit[:-1] | (words.owner()[1:] != words.owner()[:-1])
                owner = words.owner()
                starts = np.flatnonzero(cut)
                for s in starts.tolist():
                    d = int(owner[s])
                    spans[d].append((s - int(words.bound[d]), 0))
                ends = hit.copy()
                ends[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
                seen = [0] * (hi - lo)
                for e in np.flatnonzero(ends).tolist():
                    d = int(owner[e])
                    spans[d][seen[d]] = (spans[d][seen[d]][0], e + 1 - int(words.bound[d]))
                    seen[d] += 1
                cols = [*batch.slice(lo, hi - lo).columns[:-1], pa.array(words.counts(), pa.int64())]
                cols += [pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], arrow_span), pa.array([sorted(x) for x in named], pa.list_(pa.string()))]
                if cleaned:
                    source = batch.column(batch.num_columns - 1)
                    cols.append(pa.array([_without(data, offs, words, d, spans[d]) if spans[d] else source[lo + d].as_py() for d in range(hi - lo)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    found = arrow_map(chosen, run, out)
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, own, strict=True)), *(f.name for f in more))


def _without(data: np.ndarray, offs: np.ndarray, words: Words, d: int, spans: list[tuple[int, int]]) -> str:
    base, at, out = int(words.bound[d]), int(offs[d]), []
    for a, b in spans:
        out.append(data[at : words.starts[base + a]].tobytes())
        at = int(words.ends[base + b - 1])
    out.append(data[at : offs[d + 1]].tobytes())
    return b"".join(out).decode()


def digest_of_items(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the benchmark spans cut from ``text``; documents with nothing else left keep an empty text."""
    # Other columns travel under names of their own, so that none can clash with what is added.
    own = [f"__own{k}" for k in range(len(docs.columns))]
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)))
    at = own[docs.columns.index(text)]
    found = find_spans(inner, items, [n for n in own if n != at], at, item_id, item_text, cleaned=True)
    return found.select(*(F.col("clean_text" if n == at else n).alias(c) for c, n in zip(docs.columns, own, strict=True)))
