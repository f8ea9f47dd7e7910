"""WARC archives with a two-level capture index.

Writing: each task writes the records of its rows as gzip members of one archive in the shared folder, under a name of
its own and renamed when whole, so a task that runs again leaves nothing half-written. Of records with equal payloads
the one with the largest page_id is the response, the others are revisits that name it. Index rows (reversed-host URL
key, page_id, file, offset, length) are range-sorted; each partition writes blocks of ``BLOCK_ROWS`` rows compressed one
by one, and a sparse directory holds each block's first key, file, offset and length.

Reading: ``lookup`` binary-searches the directory, reads that block's byte range, then the record's. ``read_all`` goes
through every block and reads each archive's records in offset order.

A null or empty html is a payload of 0 bytes, equal to every other such. Rows that repeat a page_id are records of their
own: of several with the largest page_id one is the response, the others revisit it too. A null page_id is less than any
other; if equal payloads have no other, one of them is the response and the others are revisits that name none. Page ids
are integers. An empty table writes no archive. Very long pages are one record. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import arrow_map, drop_path, scratch_path, staged

BLOCK_ROWS = 3000
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.a.com:80/p?q -> com,a)/p?q."""
    s = (url or "").strip()
    rest = s.split("://", 1)[-1].split("#", 1)[0]
    cut = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:] or "/"
    host = host.partition(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + path.lower()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else f"/{root}")
    return fs, path


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool | None = None) -> bytes:
    """One WARC record as a gzip member. A revisit has no payload and names the response's page, if that has an id."""
    kind = "revisit" if revisit or refers_to is not None else "response"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {refers_to}"] if refers_to is not None else []
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", LEVEL, mtime=0)


def parse(member: bytes) -> dict:
    """The record of a gzip member; checks its length, and a response's digest."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    payload = body.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and digest_of(payload) != digest:
        raise ValueError("payload digest is wrong")
    page = fields["X-Page-Id"]
    return {
        "page_id": int(page) if page else None, "url": json.loads(f'"{fields["WARC-Target-URI"]}"'), "payload": payload, "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            found = [digest_of((x.as_py() or "").encode()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=["page_id", "url", "html", "digest"])


def write(pages: DataFrame, root: str | None = None, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Writes archives and index of all pages; returns their folder. ``least_bytes``: smaller payloads are all responses."""
    spark = pages.sparkSession
    root = root or scratch_path(spark, "warc")
    chosen = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    # Staged with a number a row, so that rows alike in every column stay apart and each payload is digested once.
    made = arrow_map(chosen, _digested, "page_id long, url string, html string, digest string")
    payloads = scratch_path(spark, "payloads")
    numbered = made.withColumn("row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(payloads)
    made = spark.read.schema(numbered.schema).parquet(payloads)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    digests = made.filter(size >= least_bytes).select("page_id", "row", "digest")
    # A count and a maximum a digest, whatever the number of copies. A null page_id is the least.
    twice = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "row")).alias("top")).filter("n > 1").select("digest", "top")
    refers = digests.join(twice, "digest").filter("row <> top.row").select("row", F.col("top.page_id").alias("refer"), F.lit(True).alias("revisit"))
    rows = made.join(refers, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(root)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, at, seen = None, 0, []
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    for pid, link, text, digest, refer, revisit in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if out is None:
                            fs.create_dir(f"{top}/archives", recursive=True)
                            out = fs.open_output_stream(f"{top}/archives/.{name}", compression=None)
                        payload = (text or "").encode()
                        member = record(pid, link, payload, digest, refer, revisit)
                        out.write(member)
                        seen.append((surt(link), pid, name, at, len(member)))
                        at += len(member)
        finally:
            if out is not None:
                out.close()
        if seen:
            fs.move(f"{top}/archives/.{name}", f"{top}/archives/{name}")
            for lo in range(0, len(seen), 10_000):
                some = list(zip(*seen[lo : lo + 10_000], strict=True))
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(some, types, strict=True)], names=["key", "page_id", "file", "offset", "length"])

    # Staged at once: a task that ran twice wrote two archives, and the index names those of the run that counted.
    index = staged(arrow_map(rows.select("page_id", "url", "html", "digest", "refer", "revisit"), run, "key string, page_id long, file string, offset long, length long"), "captures")
    drop_path(spark, payloads)  # the archives are whole and nothing below reads it
    directory = arrow_map(index.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset"), _blocks(root), "first string, file string, offset long, length long, n long")
    # In parts, as the blocks are made in these tasks; readers sort it.
    directory.write.parquet(f"{root}/directory")
    return root


def _blocks(root: str):
    """Sorted index rows to compressed blocks of one index file a partition; gives the directory's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(root)
        name = f"index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx"
        out, at, rows, made = None, 0, [], []

        def block() -> None:
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode(), LEVEL)
            out.write(data)
            made.append((rows[0][0], name, at, len(data), len(rows)))
            at += len(data)
            rows.clear()

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(f"{top}/index", recursive=True)
                    out = fs.open_output_stream(f"{top}/index/.{name}", compression=None)
                rows.append(r)
                if len(rows) >= BLOCK_ROWS:
                    block()
        if out is not None:
            if rows:
                block()
            out.close()
            fs.move(f"{top}/index/.{name}", f"{top}/index/{name}")
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names=["first", "file", "offset", "length", "n"])

    return run


def _range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


class Archive:
    """Point lookups: the sparse directory in memory (a row per BLOCK_ROWS captures), all else by range reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.fs, self.top = _open(root)
        self.directory = [tuple(r) for r in spark.read.parquet(f"{root}/directory").orderBy("first", "file", "offset").collect()]
        self.firsts = [r[0] for r in self.directory]

    def lookup(self, url: str) -> list[dict]:
        """All captures of ``url``, read from the archives."""
        key, out = surt(url), []
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.directory) and self.firsts[k] <= key:
            _, file, offset, length, _ = self.directory[k]
            rows = [json.loads(x) for x in zlib.decompress(_range(self.fs, f"{self.top}/index/{file}", offset, length)).decode().split("\n")]
            for row in rows[bisect.bisect_left(rows, key, key=lambda r: r[0]) :]:
                if row[0] != key:
                    break
                out.append(parse(_range(self.fs, f"{self.top}/archives/{row[2]}", row[3], row[4])))
            k += 1
        return out


def read_all(spark: SparkSession, root: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record, through index and archives."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(root)
        for batch in batches:
            for _, file, offset, length, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [json.loads(x) for x in zlib.decompress(_range(fs, f"{top}/index/{file}", offset, length)).decode().split("\n")]
                yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], names=["file", "offset", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(root)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        at, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != at:
                    if source:
                        source.close()
                    at, source = file, fs.open_input_file(f"{top}/archives/{file}")
                rows.append(parse(source.read_at(length, offset)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names=names)
        if source:
            source.close()

    directory = spark.read.parquet(f"{root}/directory").repartition(max(1, spark.sparkContext.defaultParallelism))
    index = arrow_map(directory, captures, "file string, offset long, length long")
    # Stretches of an archive go to one task, in order; a large archive is several stretches.
    stretch = (F.col("offset") / (32 << 20)).cast("long")
    dealt = index.repartition("file", stretch).sortWithinPartitions("file", "offset")
    return arrow_map(dealt, records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
