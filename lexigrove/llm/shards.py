"""Token ids in training order, as fixed-stride binary shards.

Documents' ids are packed, one after another with a separator, into sequences of equal length; each input partition
pads its last one. Sequences are numbered through by partition totals (a native sum first), and a keyed Feistel network
with cycle-walking maps the numbers onto global slots one to one: a permutation that needs no sort, no state and no
collected list, and that can be inverted. Sequences are compressed one by one on their way to a shard's task. A shard is a range of slots. Each shard is written in slot order under a
temporary name and renamed, so a task that runs again writes the same bytes; slot s lies at byte (s mod per_shard) *
stride of shard s div per_shard, so a reader resumes anywhere by seeking.

Null ids are no document; an empty one is a separator. A very long document spans sequences. Repeated rows are packed
like any other. An empty table writes no shard. Only the ids column is read. Input must be a stored table (or staged):
its partitions are numbered once and read again, and a partition that then holds other bytes is an error.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import arrow_map, mix64, scratch_path

ROUNDS = 6
#: Tasks that write shards; with more shards, each writes a range of them.
MOST_TASKS = 20_000


class Feistel:
    """A keyed permutation of 0..n-1, on arrays."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix64(np.uint64(key & (1 << 64) - 1) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (mix64(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & self.mask)
        return left << self.half | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys, back)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], keys, back)
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


@dataclass
class Layout:
    """What a reader needs to find a slot."""

    sequences: int
    length: int
    width: int
    per_shard: int
    key: int

    @property
    def stride(self) -> int:
        return self.length * self.width

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def write(df: DataFrame, ids: str, width: int, separator: int, length: int = 2048, key: int = 17, shard_bytes: int = 32 << 20, root: str | None = None) -> tuple[str, DataFrame]:
    """(folder, one row a sequence: slot, number, shard, byte_offset, crc32). ``ids`` is binary, ``width`` bytes an id.

    The shards are written as the rows are computed.
    """
    spark = df.sparkSession
    root = root or scratch_path(spark, "shards")
    rows = df.select(F.col(f"`{ids}`").cast("binary").alias("ids"))
    # One row a partition reaches the driver.
    sums = rows.filter("ids is not null").groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("ids") + width).cast("long").alias("n"))
    stride = length * width
    sizes = {r.p: r.n for r in sums.collect()}
    firsts, total = {}, 0
    for p in sorted(sizes):
        firsts[p] = total
        total += -(-sizes[p] // stride)
    layout = Layout(total, length, width, max(1, shard_bytes // stride), key)
    fs, top = _open(root)
    fs.create_dir(f"{top}/shards", recursive=True)
    with fs.open_output_stream(f"{top}/layout.json") as f:
        f.write(json.dumps(asdict(layout)).encode())
    mark = separator.to_bytes(width, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, codec = TaskContext.get().partitionId(), pa.Codec("zstd", 3)
        at, seen, order, held = firsts.get(p, 0), 0, Feistel(total, key), bytearray()

        def made(n: int) -> pa.RecordBatch:
            nonlocal at
            number = np.arange(at, at + n)
            slot, at = order.slot(number), at + n
            body = [codec.compress(memoryview(held)[k * stride : (k + 1) * stride], asbytes=True) for k in range(n)]
            del held[: n * stride]
            return pa.RecordBatch.from_arrays([pa.array(slot // layout.per_shard, pa.int32()), pa.array(slot), pa.array(number), pa.array(body, pa.binary())], names=["shard", "slot", "number", "body"])

        for batch in batches:
            for x in batch.column(0):
                value = x.as_py()
                if value is not None:
                    held += value
                    held += mark
                    seen += len(value) + width
                    if len(held) >= max(stride, 1 << 20):
                        yield made(len(held) // stride)
        if seen != sizes.get(p, 0):
            raise RuntimeError(f"partition {p} held {sizes.get(p, 0)} bytes when counted and {seen} now")
        if len(held) % stride:
            held += mark * ((stride - len(held) % stride) // width)
        if held:
            yield made(len(held) // stride)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(root)
        at, out, temporary, codec = None, None, "", pa.Codec("zstd")

        def close() -> None:
            if out is not None:
                out.close()
                # A task that runs again writes the same bytes: what is there already may stay.
                if fs.get_file_info(f"{top}/shards/{at:08d}.bin").type == pafs.FileType.NotFound:
                    fs.move(temporary, f"{top}/shards/{at:08d}.bin")
                else:
                    fs.delete_file(temporary)

        for batch in batches:
            crcs = []
            for shard, slot, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if shard != at:
                    close()
                    at, temporary = shard, f"{top}/shards/.{shard}-{uuid.uuid4().hex}"
                    out, due = fs.open_output_stream(temporary), shard * layout.per_shard
                if slot != due:
                    raise RuntimeError(f"slot {due} is missing")
                due += 1
                data = codec.decompress(body.as_buffer(), stride)
                out.write(data)
                crcs.append(zlib.crc32(data))
            slots = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), pa.array(slots % layout.per_shard * stride), pa.array(crcs, pa.int64())], names=["slot", "number", "shard", "byte_offset", "crc32"])
        close()

    dealt = arrow_map(rows, cut, "shard int, slot long, number long, body binary")
    # A task writes a contiguous range of shards, one after the other.
    each = -(-layout.shards // max(1, min(layout.shards, MOST_TASKS)))
    dealt = dealt.repartitionById(max(1, -(-layout.shards // max(1, each))), (F.col("shard") / max(1, each)).cast("int")).sortWithinPartitions("slot")
    return root, arrow_map(dealt, put, "slot long, number long, shard int, byte_offset long, crc32 long")


def read(root: str, first: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Sequences from slot ``first`` on, by sequential reads from a seek."""
    fs, top = _open(root)
    with fs.open_input_stream(f"{top}/layout.json") as f:
        layout = Layout(**json.loads(f.read()))
    kind = {1: np.uint8, 2: np.dtype("<u2"), 4: np.dtype("<u4")}[layout.width]
    end = layout.sequences if count is None else min(layout.sequences, first + count)
    while first < end:
        shard = first // layout.per_shard
        with fs.open_input_file(f"{top}/shards/{shard:08d}.bin") as f:
            f.seek(first % layout.per_shard * layout.stride)
            for _ in range(min(end, (shard + 1) * layout.per_shard) - first):
                yield np.frombuffer(f.read(layout.stride), kind)
                first += 1


