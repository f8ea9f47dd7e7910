"""Shared pieces: tables, the scratch folder all executors share, and word arrays over Arrow buffers.

Words are found on UTF-8 bytes: every separator of the operators is ASCII, and no byte of a longer
character is, so byte runs and character runs are the same.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexigrove.scratch import arrow_map, bucketed, drop_path, scratch_path, scratch_root, ship, shuffle_width, staged  # noqa: F401

#: Bytes of text that one array step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- bytes of a text column


def _letters(*spans: tuple[int, int]) -> np.ndarray:
    lut = np.ones(256, bool)
    for a, b in spans:
        lut[a : b + 1] = False
    return lut


#: Runs of anything but ASCII white space.
NON_SPACE = _letters((0x20, 0x20), (0x09, 0x0D))
#: Runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = _letters((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: The same read before folding, so capital letters count.
ALNUM_RAW = ALNUM.copy()
ALNUM_RAW[0x41:0x5B] = True
#: Bytes with A-Z lower-cased, and bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, dtype=np.uint64))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums and products become evenly spread keys."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Words of consecutive texts. ``starts``/``ends`` are byte offsets, ``bound[i]:bound[i+1]`` the words of text i."""

    __slots__ = ("bound", "data", "ends", "is_word", "offs", "starts")

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
        n = len(data)
        w = is_word[data]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = w[:-1]
        first = offs[:-1]
        before[first[first < n]] = False
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = w[1:]
        last = offs[1:] - 1
        after[last[last >= 0]] = False
        self.data, self.offs, self.is_word = data, offs, w
        self.starts = np.flatnonzero(w & ~before)
        self.ends = np.flatnonzero(w & ~after) + 1
        self.bound = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bound)

    def owner(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.bound))

    def hashes(self, fold: np.ndarray = SAME) -> np.ndarray:
        """A 64-bit hash of each word's bytes after ``fold``."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        longest = int(lens.max())
        powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _BASE, dtype=np.uint64))
        at = np.flatnonzero(self.is_word)
        part = _TABLE[fold[self.data[at]]] * powers[at - np.repeat(self.starts, lens)]
        return mix64(np.add.reduceat(part, np.cumsum(lens) - lens))


def text_steps(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``step_bytes``; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if raw else "")
    wide = pa.large_binary() if raw else pa.large_string()
    column = column.cast(wide) if column.type != wide else column
    n = len(column)
    if not n:
        return
    _, off_buf, data_buf = column.buffers()
    offs = np.frombuffer(off_buf, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + step_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + len), one range after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]))


def carried(df: DataFrame, keep: list[str] | None, added: list[str]) -> list[str]:
    """Columns to carry along: ``keep``, or all but those that an added one would clash with."""
    names = {n.lower() for n in added}
    if keep is None:
        return [c for c in df.columns if c.lower() not in names]
    if clash := [c for c in keep if c.lower() in names]:
        raise ValueError(f"columns {clash} clash with added ones; rename them")
    return keep


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are staged and no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


