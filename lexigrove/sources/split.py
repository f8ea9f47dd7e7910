"""Files whose records cross lines, read by many tasks: CSV with quoted line ends, and JSON arrays.

Spark's text source cuts a file into splits and a split into pieces: lines of a CSV file, what lies between commas of a
JSON file. A piece changes the state of a reader (in quotes or not, how deep), and what a split does to it is known for
either state at its beginning. So one pass sums splits up, the driver goes along these sums (a row a split), and a second
pass starts each split in its right state and puts records together. Only records that cross splits are shuffled.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.scratch import arrow_map

#: A whole quoted string or field, and the rest of a field after its closing quote or without quotes.
_CSV_QUOTED = re.compile(r'(?:[^"]|"")*"(?!")')
_CSV_REST = re.compile(r"[^,]*")
_JSON_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_JSON_MARK = re.compile(r'["\[\]{}]')


def csv_piece(line: str, quoted: bool) -> tuple[bool, int]:
    """(in quotes after ``line``, 0): a quote opens a field only at its beginning."""
    if '"' not in line:
        return quoted, 0
    at, n = 0, len(line)
    while at <= n:
        if quoted or line.startswith('"', at):
            m = _CSV_QUOTED.match(line, at if quoted else at + 1)
            if m is None:
                return True, 0
            at, quoted = m.end(), False
        at = _CSV_REST.match(line, at).end() + 1
    return False, 0


def json_piece(piece: str, quoted: bool) -> tuple[bool, int]:
    """(in a string after ``piece``, how much deeper)."""
    at, deeper = 0, 0
    while True:
        if quoted:
            m = _JSON_STRING.match(piece, at)
            if m is None:
                return True, deeper
            at, quoted = m.end(), False
        m = _JSON_MARK.search(piece, at)
        if m is None:
            return False, deeper
        at = m.end()
        if m[0] == '"':
            quoted = True
        else:
            deeper += 1 if m[0] in "[{" else -1


@dataclass(frozen=True)
class Kind:
    """How pieces are separated, what one does to the state, at which depth a separator ends a record."""

    separator: str
    piece: Callable[[str, bool], tuple[bool, int]]
    depth: int
    skip_blank: bool


CSV = Kind("\n", csv_piece, 0, True)
JSON = Kind(",", json_piece, 1, False)


def _pieces(spark: SparkSession, path: str, kind: Kind) -> DataFrame:
    """(at, piece): ``at`` is where the piece's split begins in the one file."""
    return spark.read.option("lineSep", kind.separator).text(path).select(F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("piece"))


def _summed(kind: Kind):
    """A row a split: for either state at its beginning the state after it, how much deeper, and how many records begin
    after an end at each depth (relative to the beginning)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, []

        def emit() -> pa.RecordBatch:
            row = {"at": now}
            for s, (quoted, deeper, ends) in enumerate(sums):
                row |= {f"quoted{s}": quoted, f"deeper{s}": deeper, f"ends{s}": [{"d": d, "n": n} for d, n in sorted(ends.items())]}
            return pa.RecordBatch.from_pylist([row], schema=_SUMS)

        for b in batches:
            for at, piece in zip(b.column("at").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if at != now:
                    if now is not None:
                        yield emit()
                    now, sums = at, [[False, 0, {}], [True, 0, {}]]
                blank = kind.skip_blank and not piece.strip("\r")
                for x in sums:
                    begin = x[0]
                    x[0], deeper = kind.piece(piece, begin)
                    x[1] += deeper
                    if not x[0] and not (blank and not begin):
                        x[2][x[1]] = x[2].get(x[1], 0) + 1
        if now is not None:
            yield emit()

    return run


_SUMS = pa.schema([("at", pa.int64()), *(f for s in (0, 1) for f in ((f"quoted{s}", pa.bool_()), (f"deeper{s}", pa.int64()), (f"ends{s}", pa.list_(pa.struct([("d", pa.int64()), ("n", pa.int64())])))))])
_SUMS_SQL = "at long, " + ", ".join(f"quoted{s} boolean, deeper{s} long, ends{s} array<struct<d:long,n:long>>" for s in (0, 1))


def _gathered(kind: Kind):
    """(ord, part, record, open): whole records, and parts of records that cross splits with the number of their record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, quoted, depth, number, held, out, size = None, False, 0, 0, [], [], 0
        cut = False  # does the record in hand begin before this split

        def take(ended: bool) -> None:
            nonlocal held, cut, number
            out.append({"ord": number, "part": now, "record": kind.separator.join(held), "open": cut or not ended})
            held, cut = [], False
            number += ended

        for b in batches:
            for at, piece, q, d, first in zip(*(b.column(c).to_pylist() for c in ("at", "piece", "quoted", "depth", "first")), strict=True):
                if at != now:
                    if held:
                        take(False)
                    now, quoted, depth, number, cut = at, q, d, first, q or d > kind.depth
                blank = kind.skip_blank and not quoted and not held and not piece.strip("\r")
                quoted, deeper = kind.piece(piece, quoted)
                depth += deeper
                if blank:
                    continue
                held.append(piece)
                size += len(piece)
                if not quoted and depth <= kind.depth:
                    take(True)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)
                    out, size = [], 0
        if held:
            take(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)

    return run


_RECORDS = pa.schema([("ord", pa.int64()), ("part", pa.int64()), ("record", pa.string()), ("open", pa.bool_())])


def records(spark: SparkSession, path: str, kind: Kind) -> DataFrame:
    """(ord, record): the records of one file, numbered from 0, blank lines of CSV left out.

    The same splits are read twice. Line ends are line feeds; of a carriage return before one, callers decide.
    """
    pieces = _pieces(spark, path, kind)
    starts, quoted, depth, number = [], False, 0, 0
    for r in sorted(arrow_map(pieces, _summed(kind), _SUMS_SQL).collect(), key=lambda r: r["at"]):  # a row a split
        starts.append((r["at"], quoted, depth, number))
        s = int(quoted)
        number += sum(e.n for e in r[f"ends{s}"] if depth + e.d <= kind.depth)
        quoted, depth = r[f"quoted{s}"], depth + r[f"deeper{s}"]
    if not starts:
        return spark.createDataFrame([], "ord long, record string")
    entered = F.broadcast(spark.createDataFrame(starts, "at long, quoted boolean, depth long, first long"))
    found = arrow_map(pieces.join(entered, "at"), _gathered(kind), "ord long, part long, record string, open boolean")
    cut = found.filter("open").groupBy("ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "record"))), lambda x: x.record), kind.separator).alias("record"))
    return found.filter("not open").select("ord", "record").unionByName(cut)


def csv_records(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(names of the columns, (ord, row)): rows from 0 without the header, a struct of strings each."""
    lines = records(spark, path, CSV).withColumn("record", F.regexp_replace("record", "\r$", ""))
    head = lines.filter("ord = 0").select("record").first()
    if head is None:
        return [], spark.createDataFrame([], "ord long, row struct<c0:string>")
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"}
    names = next(csv.reader(io.StringIO(head.record.removeprefix("﻿"), newline="")))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = lines.filter("ord > 0").select((F.col("ord") - 1).alias("ord"), F.from_csv("record", schema, options).alias("row"))
    return names, rows


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """(ord, item): the elements of the array that the file holds, as JSON text."""
    found = records(spark, path, JSON)
    # the first begins with the array's bracket, the last ends with it; the comma before the next file's end is none
    bare = F.regexp_replace(F.regexp_replace("record", "^﻿", ""), r"^\s*\[", "")
    first = F.when(F.col("ord") == 0, bare).otherwise(F.col("record"))
    last = found.agg(F.max("ord").alias("last"))
    item = F.when(F.col("ord") == F.col("last"), F.regexp_replace(first, r"\]\s*$", "")).otherwise(first)
    items = found.crossJoin(F.broadcast(last)).select("ord", F.trim(F.regexp_replace(item, r"^\s+|\s+$", "")).alias("item"))
    return items.filter("item <> ''")
