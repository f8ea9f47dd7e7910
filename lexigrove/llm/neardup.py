"""Near-duplicate classes from bottom-k sketches of one hash function.

1. Each text becomes the set of its word shingles' 64-bit hashes, a bottom-64 sketch of it, and 128 one-bit bins.
   Equal sets fall together on a 128-bit key before anything is compared, so copies cost one row each.
2. Inverted lists of the 32 lowest values give candidates. A list of at most ``SHORT`` sets is paired; sizes and bins
   prune inside the join. Values in more sets ("frequent") are never paired alone: the neighbouring frequent ones of
   each set form compound keys, and lists of at most ``MEDIUM`` sets under those are paired likewise.
3. Rounds: in every list, one hub is compared with the members that are not in its class, which costs a row a member.
   The first round's hub is the set that the longest lists hold, so copies of one original join with it; later hubs
   are drawn anew for each list from its largest class. Classes are joined after each round.
4. Each set has a home: of the sets it was compared with in the first round, the one that most others were compared
   with too. Pairs within lists follow, but only of members whose classes and homes differ: a class needs no second link.
   Sets of one home that are still in different classes are then sorted by what they lack of it, in ``ORDERS`` orders of
   its elements, and compared with their next neighbours: likely links of a large group, for a few pairs a set.
5. Two sets of one home share at most the smaller of their overlaps with it, so they can link only if they also share
   elements outside it (found by prefix filtering over those, rarest elements first), or if both overlaps alone would
   do. Members of longer compound lists and different homes meet by prefix filtering over full sets. Only pairs of
   different classes whose sizes and overlaps allow the threshold become rows.
6. Candidates are estimated on the union's sketch, survivors verified on full sets, links joined into classes.

Two sets at the threshold t share no usable key with a probability below 1e-7 at t = 0.8, and far less above it: a pair
is lost only if no infrequent value and no two neighbouring frequent ones are shared. A set's infrequent values may all
be its own, but each is with probability 1 - t at most, so a set with ``own_limit`` of them or more meets its partners
under one of them (but for 1e-8, by the binomial tail) and has no compound keys.
The pruning bounds are at least six standard deviations away.

Null and empty texts have an empty set: a class of their own each. Rows with a null id get a null class. Rows that
repeat an id with the same text share its class. Different texts under one id are each compared as sets of their own
if their equals have another id; of those that have none, the one of the smallest key stands for the id. Ties: the
smallest id names the class. Only id and text are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrove.llm.common import FOLD, NON_SPACE, Words, arrow_map, mix64, release, staged, text_steps

SKETCH, RETAINED = 64, 32
SHORT, MEDIUM = 64, 256
#: Residues of elements whose frequencies order them (2 MB as a broadcast, whatever the input).
COUNTERS = 1 << 18
#: Rounds of hubs before pairs are made. More rounds leave fewer pairs; the result is the same.
ROUNDS = 2
#: Orders in which sets of one home are sorted by what they lack, elements that an order looks at, neighbours compared.
ORDERS, DEEP, NEXT = 8, 4, 2
#: Longs of a signature of what a set lacks.
WORDS = 8
_MUL = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts with fewer words have one shingle, none without words."""
    for lo, hi, data, offs in text_steps(column):
        words = Words(data, offs, NON_SPACE)
        h = words.hashes(FOLD)
        n = len(h)
        run = h.copy()
        for k in range(1, size):
            run[: n - k] = run[: n - k] * _MUL + h[k:] if k < n else run[: n - k]
        run = mix64(run)
        for d in range(hi - lo):
            a, b = int(words.bound[d]), int(words.bound[d + 1])
            if b - a >= size:
                yield np.unique(run[a : b - size + 1])
            elif b > a:
                yield np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], np.uint64)
            else:
                yield h[:0]


def own_limit(t: float, k: int = RETAINED, risk: float = 1e-8) -> int:
    """The least count that own values among ``k`` retained ones reach with a probability below ``risk``."""
    tail, p = 0.0, 1 - t
    for x in range(k, -1, -1):
        tail += math.comb(k, x) * p**x * t ** (k - x)
        if tail >= risk:
            return x + 1
    return 0


def _bins(values: np.ndarray) -> tuple[int, int]:
    """One bit of the lowest value in each of 128 equal stretches of the hash range, as two longs."""
    if not len(values):
        return 0, 0
    where = values >> np.uint64(57)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    bits = np.zeros(128, np.uint8)
    bits[where[first].astype(np.int64)] = (mix64(values[first]) & np.uint64(1)).astype(np.uint8)
    a, b = np.packbits(bits).view(">i8").tolist()
    return a, b


def sketches(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (set size), k1, k2 (key of the whole set), s1, s2 (bins), sketch (64 lowest values, 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in shingle_sets(batch.column(1), size):
                k = xxhash.xxh3_128_digest(v.tobytes())
                rows.append((len(v), int.from_bytes(k[:8], "big", signed=True), int.from_bytes(k[8:], "big", signed=True), *_bins(v), v[:SKETCH].tobytes()))
            types = [pa.int64()] * 5 + [pa.binary()]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n", "k1", "k2", "s1", "s2", "sketch"])

    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return arrow_map(chosen, run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n long, k1 long, k2 long, s1 long, s2 long, sketch binary")


def _values(batches_column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", np.uint64) for x in batches_column]


def retained(sets: DataFrame) -> DataFrame:
    """(rep, v): the RETAINED lowest values of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [v[:RETAINED].view(np.int64) for v in _values(batch.column(1))]
            rep = batch.column(0).take(pa.array(np.repeat(np.arange(len(low)), [len(x) for x in low])))
            yield pa.RecordBatch.from_arrays([rep, pa.array(np.concatenate(low) if low else [], pa.int64())], names=["rep", "v"])

    chosen = sets.select("rep", "sketch")
    return arrow_map(chosen, run, f"rep {chosen.schema['rep'].dataType.simpleString()}, v long")


def _may_link(a: Column, b: Column, t: float) -> Column:
    """Sizes and bins allow similarity t. An element that only one set has moves one bin at most."""
    p = (1 - t) / 2
    most = 128 * p + 6.3 * (128 * p * (1 - p)) ** 0.5
    apart = F.bit_count(a.s1.bitwiseXOR(b.s1)) + F.bit_count(a.s2.bitwiseXOR(b.s2))
    return (F.least(a.n, b.n) >= F.greatest(a.n, b.n) * (t - 1e-9)) & (apart <= F.least(F.lit(most), (a.n + b.n) * ((1 - t) / (1 + t)) + 1e-9))


class _Side:
    def __init__(self, name: str):
        self.name = name

    def __getattr__(self, column: str) -> Column:
        return F.col(f"{self.name}.{column}")


def _classed(rows: DataFrame, at: DataFrame | None) -> DataFrame:
    """``rows`` with each set's class so far (root)."""
    if at is None:
        return rows.withColumn("root", F.col("rep"))
    return rows.join(at, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _mixed(m: DataFrame) -> DataFrame:
    """Rows of the lists whose members are in different classes."""
    apart = m.groupBy("x", "y").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("x", "y")
    return m.join(apart, ["x", "y"], "left_semi")


def _short(base: DataFrame, at: DataFrame | None) -> DataFrame:
    """Members of the short lists, a row each."""
    return _classed(base.filter(F.size("short") > 0), at).select("rep", "root", "n", "s1", "s2", "weight", F.explode("short").alias("v"))


def _spokes(base: DataFrame, compound: DataFrame, at: DataFrame | None, t: float, turn: int) -> DataFrame:
    """Pairs of each list's hub and its members of other classes that may link with it: a row a member at most."""
    a, b = _Side("a"), _Side("b")
    ends = [F.least(a.rep, b.rep).alias("a"), F.greatest(a.rep, b.rep).alias("b")]
    # Short lists: at most SHORT rows in a window.
    m = _short(base, at)
    drawn = F.col("weight") if turn == 0 else F.xxhash64("rep", "v", F.lit(turn))
    hub = F.max(F.struct(drawn.alias("w"), "rep", "root", "n", "s1", "s2")).over(Window.partitionBy("v"))
    m = m.drop("weight") if turn else m
    m = m.select(F.struct("rep", "root", "n", "s1", "s2").alias("b"), hub.alias("a")).filter((a.root != b.root) & _may_link(a, b, t))
    pairs = m.select(*ends)
    # Lists of compound keys have any length: a hub each by aggregation, then a join.
    m = _classed(compound, at)
    if turn == 0:
        best = m.select("x", "y", "root", F.lit(1).alias("size"), F.struct("weight", "rep", "n", "s1", "s2").alias("p"))
    else:
        best = m.groupBy("x", "y", "root").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct(F.xxhash64("rep", "x", "y", F.lit(turn)).alias("weight"), "rep", "n", "s1", "s2")).alias("p"))
    hubs = best.groupBy("x", "y").agg(F.max(F.struct("size", "p", "root")).alias("h"))
    hubs = hubs.select("x", "y", "h.root", "h.p.rep", "h.p.n", "h.p.s1", "h.p.s2")
    joined = m.alias("b").join(hubs.alias("a"), [a.x == b.x, a.y == b.y, a.root != b.root, _may_link(a, b, t)])
    return pairs.union(joined.select(*ends)).distinct()


def _paired(base: DataFrame, compound: DataFrame, homes: DataFrame, at: DataFrame, t: float) -> DataFrame:
    """Pairs a < b of different classes and homes within lists of bounded length that may link."""

    def apart(rows: DataFrame, *keys: str) -> DataFrame:
        by = Window.partitionBy(*keys)  # MEDIUM rows at most
        return rows.withColumn("lo", F.min("root").over(by)).withColumn("hi", F.max("root").over(by)).filter("lo <> hi")

    short = apart(_short(base, at), "v")
    long = apart(_classed(compound.filter(F.col("c") <= MEDIUM), at), "x", "y")
    columns = ["x", "y", "rep", "root", "n", "s1", "s2"]
    m = short.withColumn("x", F.col("v")).withColumn("y", F.col("v")).select(*columns).union(long.select(*columns))
    m = staged(m.join(homes.select("rep", "home"), "rep", "left").withColumn("home", F.coalesce("home", "rep")), "apart")
    a, b = _Side("a"), _Side("b")
    joined = m.alias("a").join(m.alias("b"), [a.x == b.x, a.y == b.y, a.rep < b.rep, a.root != b.root, a.home != b.home, _may_link(a, b, t)])
    return joined.select(a.rep.alias("a"), b.rep.alias("b")).distinct()


def _estimated(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Pairs whose union's sketch does not rule out similarity t."""
    low = t - 6 * (t * (1 - t) / SKETCH) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_values(batch.column(2)), _values(batch.column(3)), strict=True):
                union = np.union1d(x, y)[:SKETCH]
                both = np.intersect1d(x, y, assume_unique=True)
                keep.append(np.isin(both, union, assume_unique=True).sum() >= low * len(union))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    s = sets.select("rep", "sketch")
    wide = pairs.join(s.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(s.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")
    return arrow_map(wide, run, pairs.select("a", "b").schema)


def _compared(pairs: DataFrame, docs: DataFrame, size: int, t: float) -> DataFrame:
    """a, b, both (elements that the full sets share), linked (similarity t in whole percent, as the comparison is exact)."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    texts = staged(docs.join(wanted, "rep", "left_semi"), "texts")
    percent = round(100 * t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, linked = [], []
            for x, y in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                linked.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "both", "linked"])

    wide = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return arrow_map(wide, run, pairs.select("a", "b").schema.add("both", "long").add("linked", "boolean"))


def components(links: DataFrame) -> DataFrame:
    """(rep, root) for every end of a link: the smallest id that links reach. Labels pass to neighbours, then along
    themselves, until none changes; each round is written to the shared folder."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    at = staged(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(at, both.b == at.rep).groupBy(F.col("a").alias("rep")).agg(F.min("root").alias("near"))
        step = at.join(near, "rep").select("rep", "root", F.least("root", "near").alias("to"))
        jump = at.select(F.col("rep").alias("to"), F.col("root").alias("far"))
        new = staged(step.join(jump, "to").select("rep", F.least("to", "far").alias("root"), (F.least("to", "far") < F.col("root")).alias("moved")), "labels")
        at = new.select("rep", "root")
        if not new.filter("moved").limit(1).count():
            return at


def _widened(at: DataFrame, links: DataFrame) -> DataFrame:
    """The classes ``at`` joined by links between them: only classes that a new link touches are worked on."""
    ends = links
    for c in "ab":
        named = at.select(F.col("rep").alias(c), F.col("root").alias(f"{c}_root"))
        ends = ends.join(named, c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    joined = components(ends.filter("a <> b").distinct()).withColumnRenamed("root", "to")
    moved = at.join(joined.select(F.col("rep").alias("root"), "to"), "root", "left").select("rep", F.coalesce("to", "root").alias("root"))
    alone = joined.join(at, "rep", "left_anti").select("rep", F.col("to").alias("root"))
    return staged(moved.union(alone), "classes")


def _homes(first: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, home, shares): of a set and those it was compared with, the one in most comparisons, and the overlap."""
    ends = first.select(F.col("a").alias("rep"), F.col("b").alias("home"), "both").union(first.select("b", "a", "both"))
    weight = ends.groupBy("home").agg(F.count(F.lit(1)).alias("weight"))
    own = weight.join(sets.select(F.col("rep").alias("home"), F.col("n").alias("both")), "home")
    some = ends.join(weight, "home").select("rep", "weight", "home", "both").union(own.select(F.col("home").alias("rep"), "weight", "home", "both"))
    best = some.groupBy("rep").agg(F.max(F.struct("weight", "home", "both")).alias("h"))
    return best.select("rep", "h.home", F.col("h.both").alias("shares"))


def _counters(texts: DataFrame, size: int) -> np.ndarray:
    """How many sets hold elements of each of COUNTERS residues: an order of elements, of a fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for v in shingle_sets(batch.column(0), size):
                np.add.at(out, (v & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                out += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["counts"])

    # A row a task, then one of each of a few tasks to the driver.
    some = arrow_map(arrow_map(texts.select("text"), counted, "counts binary").repartition(8), added, "counts binary")
    return sum((np.frombuffer(zlib.decompress(r.counts), np.int64) for r in some.collect()), np.zeros(COUNTERS, np.int64))


def _mixed_homes(homes: DataFrame, at: DataFrame) -> DataFrame:
    """(rep, home, shares, root) of homes whose sets are in different classes."""
    kin = _classed(homes, at)
    apart = kin.groupBy("home").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("home")
    return kin.join(apart, "home", "left_semi")


def lack_signature(lack: np.ndarray) -> list[int]:
    """64 * WORDS bits, each one of the lowest element in one of as many stretches of the hash range. An element that one
    of two sets lacks alone changes one bit at most, and that with a chance of a half."""
    where = (lack >> np.uint64(64 - 6 - (WORDS - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(lack) else []
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[where[first]] = (mix64(lack[first]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(">i8").tolist()


def _lacks(homes: DataFrame, at: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(rep, home, q, low): of sets of mixed homes, the signature of what they lack of the home, and the first ``DEEP``
    elements of it in each order."""
    kin = _mixed_homes(homes, at).select("rep", "home")
    wanted = docs.join(kin.select("rep").union(kin.select("home")).distinct(), "rep", "left_semi").select("rep", "text")
    texts = staged(wanted, "texts")
    both = kin.join(texts, "rep").join(texts.select(F.col("rep").alias("home"), F.col("text").alias("home_text")), "home").sortWithinPartitions("home")
    salts = mix64(np.arange(1, ORDERS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, of = np.zeros(0, np.uint64), None
        for batch in batches:
            signs, lows = [], []
            for i, (v, h) in enumerate(zip(shingle_sets(batch.column(2), size), batch.column(0).to_pylist(), strict=True)):
                if of is None or h != of:
                    home, of = next(shingle_sets(batch.column(3).slice(i, 1), size)), h
                lack = home[~np.isin(home, v, assume_unique=True)]
                signs.append(lack_signature(lack))
                low = np.zeros((ORDERS, DEEP), np.int64)
                for k, salt in enumerate(salts):
                    first = np.sort(mix64(lack ^ salt))[:DEEP]
                    low[k, : len(first)] = first.view(np.int64)
                lows.append(low.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(signs, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.list_(pa.int64())))], names=["rep", "home", "q", "low"])

    kind = kin.schema["rep"].dataType.simpleString()
    return staged(arrow_map(both.select("home", "rep", "text", "home_text"), run, f"rep {kind}, home {kind}, q array<long>, low array<array<long>>"), "lacks")


def _side_by_side(lacks: DataFrame, at: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Pairs of sets of one home and different classes that are next to each other in one of the orders and lack the same
    first element of it: at most ``ORDERS * NEXT`` a set."""
    m = _classed(lacks.select("rep", "home", "low"), at).join(sets.select("rep", "n", "s1", "s2"), "rep")
    rows = m.select("home", "rep", "root", "n", "s1", "s2", F.posexplode("low").alias("k", "low"))
    order = ["home", "k", "low", "rep"]
    # Ranges of the order, so a large home is spread over tasks; pairs across two ranges are left to what follows.
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                before = [p for p in before if p["home"] == r["home"] and p["k"] == r["k"] and p["low"][0] == r["low"][0]][-NEXT:]
                out += [(p, r) for p in before if p["root"] != r["root"]]
                before.append(r)
            pairs = [{"a": min(p["rep"], r["rep"]), "b": max(p["rep"], r["rep"]), "x": p, "y": r} for p, r in out]
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], batch.schema.field("rep").type) for c in "ab"] + [pa.array([p[z][c] for p in pairs], pa.int64()) for z in "xy" for c in ("n", "s1", "s2")], names=["a", "b", *(f"{z}{c}" for z in "xy" for c in ("n", "s1", "s2"))])

    kind = rows.schema["rep"].dataType.simpleString()
    found = arrow_map(dealt.select("home", "k", "low", "rep", "root", "n", "s1", "s2"), run, f"a {kind}, b {kind}, " + ", ".join(f"{z}{c} long" for z in "xy" for c in ("n", "s1", "s2")))
    side = lambda z: F.struct(*(F.col(f"{z}{c}").alias(c) for c in ("n", "s1", "s2")))
    return found.filter(_may_link(side("x"), side("y"), t)).select("a", "b").distinct()


def _rest(members: DataFrame, at: DataFrame, sets: DataFrame, homes: DataFrame, lacks: DataFrame, docs: DataFrame, size: int, t: float) -> DataFrame:
    """Candidates among sets of one home, and of different homes among members of long lists, that are still in
    different classes."""
    kin = _mixed_homes(homes, at).select("rep", F.lit(False).alias("listed"))
    listed = _mixed(_classed(members, at)).select("rep", F.lit(True).alias("listed"))
    m = _classed(kin.union(listed).groupBy("rep").agg(F.max("listed").alias("listed")), at).join(homes, "rep", "left")
    m = m.withColumn("home", F.coalesce("home", "rep")).join(sets.select("rep", "n", "s1", "s2"), "rep")
    m = staged(m.withColumn("shares", F.coalesce("shares", "n")).withColumn("beyond", F.col("n") - F.col("shares")), "members")
    wanted = staged(docs.join(m.select("rep").union(m.select("home")).distinct(), "rep", "left_semi").select("rep", "text"), "texts")
    both = m.select("rep", "home", "n", "shares", "listed").join(wanted, "rep").join(wanted.select(F.col("rep").alias("home"), F.col("text").alias("home_text")), "home")
    both = both.sortWithinPartitions("home")
    counts = docs.sparkSession.sparkContext.broadcast(_counters(wanted, size))

    def elements(near: bool) -> DataFrame:
        """(rep, e, first). ``near``: what a set has beyond its home. Else the rarest elements, among which a partner must
        share one; ``first`` is for partners at least as large."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            home, of = np.zeros(0, np.uint64), None
            for batch in batches:
                reps, found, firsts = [], [], []
                for i, (v, h) in enumerate(zip(shingle_sets(batch.column(1), size), batch.column(0).to_pylist(), strict=True)):
                    if near:
                        if h != of:
                            home, of = next(shingle_sets(batch.column(2).slice(i, 1), size)), h
                        rows, most = v[~np.isin(v, home, assume_unique=True)], 0
                    else:
                        least, most = (len(v) - math.ceil(len(v) * x - 1e-9) + 1 for x in (t, 2 * t / (1 + t)))
                        rows = v[np.lexsort((v, counts.value[(v & np.uint64(COUNTERS - 1)).astype(np.int64)]))][:least]
                    reps.append(np.full(len(rows), i))
                    found.append(rows.view(np.int64))
                    firsts.append(np.arange(len(rows)) < most)
                if reps:
                    rep = batch.column(3).take(pa.array(np.concatenate(reps)))
                    yield pa.RecordBatch.from_arrays([rep, pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(firsts), pa.bool_())], names=["rep", "e", "first"])

        chosen = both if near else both.filter("listed")
        chosen = chosen.select("home", "text", "home_text", "rep")
        return staged(arrow_map(chosen, run, f"rep {chosen.schema['rep'].dataType.simpleString()}, e long, first boolean"), "elements").join(m, "rep")

    a, b = _Side("a"), _Side("b")
    need = (a.n + b.n) * (t / (1 + t)) - 1e-9
    fits = (a.root != b.root) & ((a.n < b.n) | ((a.n == b.n) & (a.rep != b.rep))) & _may_link(a, b, t)
    ends = [F.least(a.rep, b.rep).alias("a"), F.greatest(a.rep, b.rep).alias("b")]
    # What most sets of a home have counts as part of it: the home itself is one of them, with changes of its own.
    near = elements(True).select("rep", "home", "e")
    counted = near.groupBy("home", "e").agg(F.count(F.lit(1)).alias("c"))
    sizes = m.groupBy("home").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("smallest"))
    by = Window.partitionBy("rep")
    near = near.join(counted, ["home", "e"]).join(sizes, "home").withColumn("common", (F.col("c") > 2) & (2 * F.col("c") >= F.col("members")))
    near = near.withColumn("gained", F.count_if("common").over(by)).withColumn("k", F.row_number().over(by.orderBy("common", "c", "e")))
    near = staged(near.select("rep", "e", "c", "common", "gained", "k"), "near")
    gained = near.groupBy("rep").agg(F.max("gained").alias("gained"))
    m = m.join(gained, "rep", "left").withColumn("gained", F.coalesce("gained", F.lit(0)))
    m = m.withColumn("lack", -F.col("shares")).withColumn("shares", F.col("shares") + F.col("gained")).withColumn("beyond", F.col("beyond") - F.col("gained")).join(sizes, "home")
    m = m.join(sets.select(F.col("rep").alias("home"), F.col("n").alias("whole")), "home").withColumn("lack", F.col("whole") + F.col("lack"))
    m = m.join(lacks.select("rep", "q"), "rep", "left")
    m = staged(m, "members")
    # Rarest first: a partner of at least the smallest size shares one of these.
    wanted = F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("smallest")) * (t / (1 + t)) - F.col("shares") - 1e-9))
    near = staged(near.filter("c > 1 and not common").drop("gained").join(m, "rep").filter(F.col("k") <= F.col("beyond") - wanted + 1), "near")
    same = near.alias("a").join(near.alias("b"), [a.home == b.home, a.e == b.e, fits, F.least(a.shares, b.shares) + F.least(a.beyond, b.beyond) >= need])
    # Overlaps with the home that would do alone: only of sets small enough beside the smallest.
    enough = staged(m.filter((F.col("n") + F.col("smallest")) * (t / (1 + t)) - 1e-9 <= F.col("shares")), "enough")
    # Of two classes one is not the home's largest.
    largest = m.groupBy("home", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("home").agg(F.max_by("root", "k").alias("largest"))
    outer = enough.join(largest, "home").filter("root <> largest")
    # Such a pair shares of the home what neither lacks, and of the rest what both have gained. So it lacks at most
    # whole + gained - need elements together, and the elements that one lacks alone are no more than this:
    alone_most = 2 * (a.whole + F.least(a.gained, b.gained) - need) - a.lack - b.lack + 1e-6
    differ = F.coalesce(sum((F.bit_count(F.get(a.q, F.lit(i)).bitwiseXOR(F.get(b.q, F.lit(i)))) for i in range(WORDS)), F.lit(0)), F.lit(0))
    alike = (alone_most >= 0) & (differ <= F.least(alone_most, alone_most / 2 + 3.15 * F.sqrt(F.greatest(alone_most, F.lit(0.0))) + 1))
    alone = outer.alias("a").join(enough.alias("b"), [a.home == b.home, a.root != b.root, a.rep != b.rep, _may_link(a, b, t), F.least(a.shares, b.shares) >= need, alike])
    # Elements of one home only have no pair to give between homes.
    far = elements(False)
    several = far.groupBy("e").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).filter("lo <> hi").select("e")
    far = staged(far.join(several, "e", "left_semi"), "far")
    other = far.filter("first").alias("a").join(far.alias("b"), [a.e == b.e, a.home != b.home, fits])
    return same.select(*ends).union(alone.select(*ends)).union(other.select(*ends)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    t = threshold
    every = staged(sketches(docs, shingle, doc_id, text), "sketches")
    full = every.filter("n > 0 and doc_id is not null")
    named = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    release(docs.sparkSession)
    best = full.join(named, ["k1", "k2"]).filter("doc_id = rep").groupBy("rep").agg(F.min(F.struct("k1", "k2", "n", "s1", "s2", "sketch")).alias("s"))
    sets = staged(best.select("rep", "s.n", "s.s1", "s.s2", "s.sketch"), "sets")
    values = retained(sets)
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    of = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("v"))))
    held = values.join(often, "v").groupBy("rep").agg(F.sum(F.log2("c")).alias("weight"), of(F.col("c") <= SHORT).alias("short"), of(F.col("c") > SHORT).alias("h"))
    # Values in no other set are infrequent too. A set that is retained whole has (1 - t) of them as its own at most.
    r = F.least("n", F.lit(RETAINED))
    own = F.when(r < RETAINED, F.floor(r * (1 - t) + 1e-9) + 1).otherwise(own_limit(t))
    pairs_of = F.transform(F.sequence(F.lit(0), F.size("h") - 2), lambda i: F.struct(F.get("h", i).alias("x"), F.get("h", i + 1).alias("y")))
    chain = F.when((F.size("h") > 1) & (r - F.size("h") < own), pairs_of)
    base = staged(held.join(sets.drop("sketch"), "rep").withColumn("chain", chain).drop("h"), "lists")
    release(docs.sparkSession)
    chains = base.select("rep", "n", "s1", "s2", "weight", F.explode("chain").alias("k")).select("rep", "n", "s1", "s2", "weight", "k.x", "k.y")
    sizes = chains.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    compound = staged(chains.join(sizes, ["x", "y"]), "compound")
    texts = docs.select(F.col(f"`{doc_id}`").alias("rep"), F.col(f"`{text}`").alias("text"))
    at = None

    def join_classes(candidates: DataFrame) -> DataFrame:
        nonlocal at
        pairs = staged(_estimated(candidates, sets, t), "pairs")
        if at is not None and not pairs.limit(1).count():
            return pairs  # nothing that could change a class
        compared = staged(_compared(pairs, texts, shingle, t), "compared")
        links = compared.filter("linked").select("a", "b")
        if at is None:
            at = components(links)
        elif links.limit(1).count():
            at = _widened(at, links)
        release(docs.sparkSession)
        return compared

    homes = staged(_homes(join_classes(_spokes(base, compound, at, t, 0)), sets), "homes")
    for turn in range(1, ROUNDS):
        join_classes(_spokes(base, compound, at, t, turn))
    lacks = _lacks(homes, at, texts, shingle)
    # Pairs of different homes and pairs of one home: no pair is in both.
    join_classes(_paired(base, compound, homes, at, t).union(_side_by_side(lacks, at, sets, t)))
    members = compound.filter(F.col("c") > MEDIUM).select("rep", "x", "y")
    join_classes(_rest(members, at, sets, homes, lacks, texts, shingle, t))
    classes = named.join(at, "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    out = every.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left")
    cid = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    cid = F.when(F.col("doc_id").isNotNull(), cid).alias("component_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), cid)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def dedup(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id. Different texts under that id all stay, so that none is
    lost with its copies; rows that repeat id and text stay once. Rows without an id stay. Columns may have any name."""
    own = [f"c{k}" for k in range(len(docs.columns))]
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)))
    i, x = own[docs.columns.index(doc_id)], own[docs.columns.index(text)]
    kept = near_duplicates(inner, shingle, threshold, i, x).filter("kept").select(F.col("doc_id").alias("kept")).distinct()
    one = inner.filter(F.col(i).isNotNull()).join(kept, F.col(i) == F.col("kept"), "left_semi")
    turn = F.row_number().over(Window.partitionBy(i, x).orderBy(F.lit(0)))
    rows = one.withColumn("turn", turn).filter("turn = 1").drop("turn").unionByName(inner.filter(F.col(i).isNull()))
    return rows.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)))
