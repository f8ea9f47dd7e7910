"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens. A minimal perfect hash over the vocabulary (hash and displace: one displacement per
bucket, every slot used, the key kept for the check) resolves a pre-token that is itself a token. Any other is merged
from its bytes: a linked list of pieces and a heap of mergeable neighbours, lowest rank first, leftmost on ties.

All of it works on a run of texts at a time, as arrays over their UTF-8 bytes: pre-tokens of up to 16 bytes are two
integers and a length, equal ones of a run are resolved once, and a hash that two different ones share is found by
comparing them all. Merges are remembered in the worker.

The vocabulary file's path and the pattern are parameters; each Python worker loads them once. The common pattern
``ARRAY_PATTERN`` is cut by arrays of character classes, any other by the ``regex`` module. Ids are bytes of
little-endian unsigned 32-bit integers.

Null texts are empty; empty texts have no ids. Very long texts are encoded in stretches that end before white space.
Rows are independent: repeated rows and ids and nulls need no care, and an empty table gives an empty result. Columns of
the table that an added one would clash with are left out unless they are named in ``keep``, which is an error.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.llm.common import arrow_map, carried, mix64, spread, text_steps

#: Slots for merged pre-tokens that a worker remembers and ids held for them (40 MB by their sizes); full, it starts anew.
CACHE_SLOTS, CACHE_IDS = 1 << 20, 1 << 22
#: The same for pre-tokens that are no two integers.
CACHE_TOKENS = 20_000
#: Bytes of text that are encoded at a time, so that the arrays stay small.
RUN_BYTES = 1 << 18
#: Bytes of one text that are encoded at a time.
STRETCH = 8 << 20
#: Fixed value: the pattern that is cut without a regular expression.
ARRAY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Bytes of a pre-token that two integers hold.
WIDE = 16
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def char_classes() -> np.ndarray:
    """The class of each code point."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def _points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that start at ``at``."""
    lead = data[at].astype(np.uint32)
    out = lead.copy()
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = np.flatnonzero((lead >= least) & (lead < (0xE0, 0xF0, 0x100)[more - 1]))
        if len(some):
            value = lead[some] & mask
            for k in range(1, more + 1):
                value = value << 6 | (padded[at[some] + k] & 0x3F)
            out[some] = value
    return out


def cut_arrays(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets at which a pre-token of ``ARRAY_PATTERN`` starts; each ends where the next one starts."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    ascii_only = len(at) == len(data)
    kinds = char_classes()[:128][data] if ascii_only else char_classes()[_points(data, at)]
    n = len(at)
    first = offs[:-1][np.diff(offs) > 0] if ascii_only else np.searchsorted(at, offs[:-1][np.diff(offs) > 0])
    edge = np.zeros(n + 3, bool)
    edge[first] = True
    edge[n] = True
    start = edge.copy()
    start[1:n] |= kinds[1:] != kinds[:-1]
    char = np.zeros(n + 3, np.uint8)
    char[:n] = data[at]
    # White space before something else in the same text: its last character stands alone, or joins what follows.
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~edge[1:n])
    start[last] = True
    start[last[char[last] == 0x20] + 1] = False
    # Contractions: a lone apostrophe that nothing was joined to, and the letters after it.
    mark = np.flatnonzero((char[: n - 1] == 0x27) & start[: n - 1] & (kinds[1:] == LETTER) & ~edge[1:n])
    if len(mark):
        a, b = char[mark + 1], np.where(edge[mark + 2], 0, char[mark + 2])
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        some, size = mark[one | two], np.where(one, 1, 2)[one | two]
        start[some + 1] = False
        start[some + 1 + size] = True
    return at[np.flatnonzero(start[:n])]


def _hashed(k0: np.ndarray, k1: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix64(k0 ^ mix64(k1 + size.astype(np.uint64) * _SPREAD))


def _halves(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the next eight bytes of byte runs as integers; only the first ``WIDE`` bytes count."""
    padded = np.concatenate((data, np.zeros(WIDE, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    k0 = eight[starts] & _KEEP[np.minimum(size, 8)]
    k1 = np.where(size > 8, eight[np.minimum(starts + 8, len(eight) - 1)] & _KEEP[np.clip(size - 8, 0, 8)], 0)
    return k0, k1.astype(np.uint64)


class PerfectHash:
    """bytes -> slot in 0..n-1 for n fixed keys, one slot each; -1 for anything else."""

    PER_BUCKET = 4
    #: Displacements tried at a time.
    TRIES = 64

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // self.PER_BUCKET)
        h, k0, k1, size = self._parts(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        held = np.bincount(bucket, minlength=self.buckets)
        by = np.argsort(bucket, kind="stable")
        begin = np.concatenate(([0], np.cumsum(held)))
        self.shift = np.zeros(self.buckets, np.int64)
        owner = np.full(n, -1, np.int64)
        for b in np.argsort(-held, kind="stable"):
            if held[b] < 2:
                break
            mine, d = by[begin[b] : begin[b + 1]], 0
            while True:
                tries = np.arange(d, d + self.TRIES, dtype=np.int64)
                slots = self._slot(h[mine][None], tries[:, None])
                fits = (owner[slots] < 0).all(1)
                for row in np.flatnonzero(fits):
                    if len(set(slots[row].tolist())) == len(mine):
                        break
                else:
                    d += self.TRIES
                    continue
                break
            self.shift[b], owner[slots[row]] = tries[row], mine
        # A bucket of one takes any free slot; a negative entry names it outright.
        single = np.flatnonzero(held == 1)
        free = np.flatnonzero(owner < 0)
        owner[free], self.shift[single] = by[begin[single]], -1 - free
        self.slots = [keys[i] for i in owner.tolist()]
        self.k0, self.k1, self.size = k0[owner], k1[owner], size[owner]

    @staticmethod
    def _parts(keys: list[bytes]) -> tuple[np.ndarray, ...]:
        size = np.array([len(k) for k in keys], np.int64)
        data = np.frombuffer(b"".join(keys), np.uint8)
        k0, k1 = _halves(data, np.cumsum(size) - size, size)
        h = _hashed(k0, k1, size)
        for i in np.flatnonzero(size > WIDE).tolist():
            h[i] = xxhash.xxh3_64_intdigest(keys[i])
        return h, k0, k1, size

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        """A slot that each displacement draws anew, so a search for free ones cannot run in a circle."""
        return (mix64(h ^ mix64(d.astype(np.uint64) * _SPREAD)) % np.uint64(self.n)).astype(np.int64)

    def find_all(self, h: np.ndarray, k0: np.ndarray, k1: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Slots of keys of at most ``WIDE`` bytes."""
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        at = np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))
        return np.where((self.k0[at] == k0) & (self.k1[at] == k1) & (self.size[at] == size), at, -1)

    def find(self, key: bytes) -> int:
        h = self._parts([key])[0]
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        at = int(-1 - d[0] if d[0] < 0 else self._slot(h, d)[0])
        return at if self.slots[at] == key else -1


class Merged:
    """Ids of merged pre-tokens of at most ``WIDE`` bytes. Each may lie in two slots; in the second it takes another's place."""

    def __init__(self):
        self.k0, self.k1 = np.zeros(CACHE_SLOTS, np.uint64), np.zeros(CACHE_SLOTS, np.uint64)
        self.size, self.count = np.zeros(CACHE_SLOTS, np.uint8), np.zeros(CACHE_SLOTS, np.uint8)
        self.begin, self.ids, self.held = np.zeros(CACHE_SLOTS, np.int32), np.zeros(CACHE_IDS, np.uint32), 0

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h % np.uint64(CACHE_SLOTS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(CACHE_SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray, k0: np.ndarray, k1: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which are known, the ids that each of those has, all of those ids)."""
        at, other = self._slots(h)
        known = (self.k0[at] == k0) & (self.k1[at] == k1) & (self.size[at] == size)
        miss = np.flatnonzero(~known)
        at[miss] = x = other[miss]
        known[miss] = (self.k0[x] == k0[miss]) & (self.k1[x] == k1[miss]) & (self.size[x] == size[miss])
        at = at[known]
        counts = self.count[at].astype(np.int64)
        return known, counts, self.ids[spread(self.begin[at].astype(np.int64), counts)]

    def add(self, h: np.ndarray, k0: np.ndarray, k1: np.ndarray, size: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        if self.held + len(ids) > CACHE_IDS:
            self.size[:] = 0
            self.held = 0
        if len(ids) > CACHE_IDS:
            return
        begin = self.held + np.cumsum(counts) - counts
        self.ids[self.held : self.held + len(ids)] = ids
        self.held += len(ids)
        left = np.arange(len(h))
        for turn, at in enumerate(self._slots(h)):
            slots = at[left]
            # One of those that share a slot stays in all of its arrays.
            slots, one = np.unique(slots, return_index=True)
            free = slots >= 0 if turn else self.size[slots] == 0
            slots, some = slots[free], left[one[free]]
            self.k0[slots], self.k1[slots], self.size[slots] = k0[some], k1[some], size[some]
            self.count[slots], self.begin[slots] = counts[some], begin[some]
            left = np.delete(left, one[free])


class ByteBPE:
    """An encoder and decoder of runs of texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.regex = pattern, regex.compile(pattern)
        self.hash = PerfectHash(list(self.ranks))
        self.ids = np.array([self.ranks[k] for k in self.hash.slots], np.uint32)
        self.piece: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.piece[v] = k
        self.piece_size = np.array([len(x) for x in self.piece], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.pieces = np.frombuffer(b"".join(self.piece), np.uint8)
        self.byte = [self.ranks[bytes((b,))] for b in range(256)]
        self.known: dict[bytes, bytes] = {}
        self.short = Merged()
        self.two = np.array([self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int32)

    def _one(self, raw: bytes, pairs: np.ndarray) -> bytes:
        out = self.known.get(raw)
        if out is None:
            at = self.hash.find(raw)
            out = array("I", [int(self.ids[at])] if at >= 0 else self.merged(raw, pairs.tolist())).tobytes()
            if len(self.known) >= CACHE_TOKENS:
                self.known.clear()
            if len(raw) <= 64:
                self.known[raw] = out
        return out

    def merged(self, raw: bytes, pair: list[int]) -> list[int]:
        """Ids of ``raw`` from its bytes and the ranks of its byte pairs (-1: none). ``end[i]`` is where the piece that
        starts at i ends, i.e. the next piece.

        A heap entry is rank and start in one integer; it is stale unless ``pair[start]`` still is that rank.
        """
        n, rank = len(raw), self.ranks.get
        if n == 1:
            return [self.ranks[raw]]
        bits = n.bit_length()
        mask = (1 << bits) - 1
        end, before, piece = list(range(1, n + 1)), list(range(-1, n - 1)), list(map(self.byte.__getitem__, raw))
        end.append(n)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        pair.append(-1)
        heapify(heap)
        while heap:
            e = heappop(heap)
            i = e & mask
            if pair[i] != e >> bits:
                continue
            j = end[i]
            stop = end[i] = end[j]
            piece[i] = e >> bits
            pair[j] = -1
            if stop < n:
                before[stop] = i
                pair[i] = r = rank(raw[i : end[stop]], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                pair[i] = -1
            k = before[i]
            if k >= 0:
                pair[k] = r = rank(raw[k:stop], -1)
                if r >= 0:
                    heappush(heap, r << bits | k)
        out, i = [], 0
        while i < n:
            out.append(piece[i])
            i = end[i]
        return out

    def _starts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.pattern == ARRAY_PATTERN:
            return cut_arrays(data, offs)
        sizes = [len(x.encode()) for a, b in zip(offs[:-1], offs[1:], strict=True) for x in self.regex.findall(data[a:b].tobytes().decode())]
        if sum(sizes) != len(data):
            raise ValueError("the pattern leaves bytes out")
        return np.cumsum([0, *sizes])[:-1]

    def _resolved(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(kind of each pre-token, ids a kind has, all kinds' ids, pre-tokens before each text)."""
        starts = self._starts(data, offs)
        size = np.diff(np.append(starts, len(data)))
        k0, k1 = _halves(data, starts, size)
        h = _hashed(k0, k1, size)
        kind_h, first, kind = np.unique(h, return_index=True, return_inverse=True)
        wide = np.flatnonzero(size > WIDE)
        same = (k0[first][kind] == k0) & (k1[first][kind] == k1) & (size[first][kind] == size)
        odd = np.union1d(wide, np.flatnonzero(~same))
        at = self.hash.find_all(kind_h, k0[first], k1[first], size[first])
        at[size[first] > WIDE] = -1
        miss = np.flatnonzero((at < 0) & (size[first] <= WIDE))
        parts = [x[miss] for x in (kind_h, k0[first], k1[first], size[first])]
        known, counts_known, ids_known = self.short.find(*parts)
        new = miss[~known]
        whole, pairs = data.tobytes(), self.two[data[:-1].astype(np.int32) << 8 | data[1:]]

        def merges(some: np.ndarray, of: Callable) -> tuple[np.ndarray, np.ndarray]:
            found = [of(whole[a:b], pairs[a : b - 1]) for a, b in zip(starts[some].tolist(), (starts[some] + size[some]).tolist(), strict=True)]
            return np.array([len(x) // 4 for x in found], np.int64), np.frombuffer(b"".join(found), np.uint32)

        counts_new, ids_new = merges(first[new], lambda raw, pair: array("I", self.merged(raw, pair.tolist())).tobytes())
        self.short.add(*(x[~known] for x in parts), counts_new, ids_new)
        # Long ones, and those whose hash another one has, are kinds of their own.
        counts_odd, ids_odd = merges(odd, self._one)
        kind[odd] = len(kind_h) + np.arange(len(odd))
        counts = np.ones(len(kind_h) + len(odd), np.int64)
        some = np.concatenate((miss[known], new, len(kind_h) + np.arange(len(odd))))
        counts[some] = np.concatenate((counts_known, counts_new, counts_odd))
        begin = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.uint32)
        hit = np.flatnonzero(at >= 0)
        ids[begin[hit]] = self.ids[at[hit]]
        ids[spread(begin[some], counts[some])] = np.concatenate((ids_known, ids_new, ids_odd))
        return kind, counts, ids, np.searchsorted(starts, offs)

    def _stretches(self, data: np.ndarray) -> list[np.ndarray]:
        """A long text in parts. A part ends before white space that follows something else, where a pre-token ends in
        any case."""
        out, at = [], 0
        while len(data) - at > STRETCH:
            lo = at + STRETCH
            space = (data[lo:] == 0x20) | (data[lo:] == 0x0A)
            here = np.flatnonzero(space[1:] & ~space[:-1] & (data[lo:-1] > 0x20) & (data[lo:-1] < 0x7F))
            if not len(here):
                break
            out.append(data[at : lo + here[0] + 1])
            at = lo + int(here[0]) + 1
        return [*out, data[at:]]

    def encode_all(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of consecutive texts, where each text's ids start and the end)."""
        if len(offs) == 2 and len(data) > STRETCH and self.pattern == ARRAY_PATTERN:
            made = np.concatenate([self._encoded(x, np.array([0, len(x)]))[0] for x in self._stretches(data)])
            return made, np.array([0, len(made)])
        return self._encoded(data, offs)

    def _encoded(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, counts, ids, bound = self._resolved(data, offs)
        begin = np.cumsum(counts) - counts
        each = counts[kind]
        return ids[spread(begin[kind], each)], np.concatenate(([0], np.cumsum(each)))[bound]

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, where each id's bytes start and the end)."""
        size = self.piece_size[ids]
        return self.pieces[spread(self.piece_at[ids], size)], np.concatenate(([0], np.cumsum(size)))

    def encode(self, text: str) -> bytes:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all(np.frombuffer(ids, "<u4"))[0].tobytes()


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """This process's encoder for a vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(path, pattern)
    return _LOADED[path, pattern]


def _mapped(df: DataFrame, column: str, keep: list[str] | None, added: list[tuple[str, T.DataType]], made: Callable) -> DataFrame:
    """``keep`` columns of ``df`` and the added ones; ``made`` turns bytes and offsets of a run of rows into their arrays."""
    names = [n for n, _ in added]
    kept = carried(df, keep, names)
    own = [f"__own{k}" for k in range(len(kept))]
    chosen = df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(kept, own, strict=True)), F.col(f"`{column}`").alias("__in"))
    out = T.StructType([*chosen.schema.fields[:-1], *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_steps(batch.column(batch.num_columns - 1), RUN_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], *made(data, offs)], names=out.names)

    return arrow_map(chosen, run, out).select(*(F.col(n).alias(k) for n, k in zip(own, kept, strict=True)), *names)


def _binary(data: np.ndarray, bound: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer((bound * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, width: int = 4) -> DataFrame:
    """``keep`` columns (default all) and ``ids`` binary, ``n_tokens`` long. ``width``: bytes an id, 4, or 2 for a
    vocabulary of at most 65,536."""

    def made(data, offs):
        bpe = loaded(path, pattern)
        if len(bpe.piece) > 1 << 8 * width:
            raise ValueError(f"ids of this vocabulary do not fit in {width} bytes")
        ids, bound = bpe.encode_all(data, offs)
        return _binary(ids.astype(f"<u{width}", copy=False), bound), pa.array(np.diff(bound), pa.int64())

    return _mapped(df, text, keep, [("ids", T.BinaryType()), ("n_tokens", T.LongType())], made)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) and ``decoded`` binary: the bytes that the ids stand for (null: none)."""

    def made(data, offs):
        out, bound = loaded(path, pattern).decode_all(np.frombuffer(data.tobytes(), "<u4"))
        return [_binary(out, bound[offs // 4])]

    return _mapped(df, ids, keep, [("decoded", T.BinaryType())], made)


def count_tokens(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) and ``n_tokens`` long; ids stay in the worker."""

    def made(data, offs):
        return [pa.array(np.diff(loaded(path, pattern).encode_all(data, offs)[1]), pa.int64())]

    return _mapped(df, text, keep, [("n_tokens", T.LongType())], made)


def encode_checked(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode`` with ``lossless``: whether the ids decode to the text's bytes. One worker does both, so a task holds one
    vocabulary and the text does not travel back."""

    def made(data, offs):
        bpe = loaded(path, pattern)
        ids, bound = bpe.encode_all(data, offs)
        back, at = bpe.decode_all(ids)
        at = at[bound]
        same = [np.array_equal(back[a:b], data[x:y]) for a, b, x, y in zip(at[:-1].tolist(), at[1:].tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        return _binary(ids.astype("<u4", copy=False), bound), pa.array(np.diff(bound), pa.int64()), pa.array(same, pa.bool_())

    return _mapped(df, text, keep, [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("lossless", T.BooleanType())], made)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all), ``n_tokens`` and the SHA-256 of the ids and of what they decode to.

    One pass of a worker encodes and decodes, so the ids need not travel.
    """

    def made(data, offs):
        bpe = loaded(path, pattern)
        ids, bound = bpe.encode_all(data, offs)
        back, at = bpe.decode_all(ids)
        ids, at = ids.astype("<u4", copy=False), at[bound]
        digests = [[hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(y[:-1].tolist(), y[1:].tolist(), strict=True)] for x, y in ((ids, bound), (back, at))]
        return pa.array(np.diff(bound), pa.int64()), *(pa.array(x, pa.string()) for x in digests)

    return _mapped(df, text, keep, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], made)
