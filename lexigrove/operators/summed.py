"""Iterations whose tasks each sum up what their rows say: batch topic models and k-means from many starts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.scratch import arrow_map, kept


def task_sums(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what ``add`` puts into an array of zeros of ``shape``.

    One array a task; they are summed in about the square root of as many tasks, again and again while there are more than
    eight, and those by the driver.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            add(total, b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for x in b.column("total").to_pylist():
                total += np.frombuffer(x).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    tasks = rows.rdd.getNumPartitions()
    sums = arrow_map(rows, each, "total binary")
    while tasks > 8:
        tasks = int(np.ceil(np.sqrt(tasks)))
        sums = arrow_map(sums.repartition(tasks), some, "total binary")
    out = np.zeros(shape)
    for r in sums.collect():  # eight rows at most; an iterator would run their tasks one after the other
        out += np.frombuffer(r.total).reshape(shape)
    return out


# ---------------------------------------------------------------- topic model


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function for x > 0: six steps of its recurrence, in pairs of the same sum, then
    its asymptotic series."""
    x = np.asarray(x, float)
    u, y = x * (x + 5), x + 6
    r = 1 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - (2 * x + 5) * (1 / u + 1 / (u + 4) + 1 / (u + 6))


def expected(weights: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet rows."""
    if not weights.size:
        return weights
    both = digamma(np.concatenate([weights, weights.sum(axis=1, keepdims=True)], axis=1))
    return np.exp(both[:, :-1] - both[:, -1:])


#: Weights of words (documents x terms x topics) that are held at once.
HELD_WEIGHTS = 5 << 17


def _alike(sizes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Documents with terms, in groups of about equal ``sizes`` that have ``cells`` of the longest at most."""
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    i = int(np.searchsorted(ordered, 1))
    while i < len(order):
        j = int(np.searchsorted(ordered, max(ordered[i] + 16, ordered[i] * 1.3), side="right"))
        j = min(j, i + max(1, cells // int(ordered[j - 1])))
        yield order[i:j]
        i = j


def _settled(words: np.ndarray, count: np.ndarray, prior: float, rounds: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(topic weights, what ``expected`` makes of them) of documents: ``words`` is documents x topics x terms.

    Documents that have stopped are computed on, without effect, until enough have to copy the others.
    """
    n, k = len(words), words.shape[1]
    weights, live, on = np.ones((n, k)), np.arange(n), np.ones(n, bool)
    now, mean = weights.copy(), np.full(k, 1 / k)
    theta = expected(now)
    last = theta.copy()
    for _ in range(rounds):
        norm = np.matmul(theta[:, None, :], words)[:, 0]
        norm += 1e-100
        new = theta * np.matmul(words, np.divide(count, norm, out=norm)[:, :, None])[:, :, 0] + prior
        moved = np.abs(new - now) @ mean
        now, theta = new, expected(new)
        weights[live[on]], last[live[on]] = now[on], theta[on]
        on &= moved >= least
        left = np.count_nonzero(on)
        if not left:
            break
        if left < 0.6 * len(live):
            live, now, theta, words, count = (x[on] for x in (live, now, theta, words, count))
            on = np.ones(left, bool)
    return weights, last


def document_topics(bound: np.ndarray, term: np.ndarray, count: np.ndarray, words: np.ndarray, prior: float, rounds: int = 100, least: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(topic weights of each document, topics x terms that they expect) for documents ``bound[i]:bound[i + 1]``.

    ``words`` is exp(E[log p(term | topic)]). A document stops once its weights move less than ``least`` on average.
    Documents of about equal length go through the rounds together, filled up with a term that no topic has.
    """
    (k, terms), sizes = words.shape, np.diff(bound)
    weights, stats = np.full((len(sizes), k), prior), np.zeros((k, terms + 1))
    wide = np.concatenate([words, np.zeros((k, 1))], axis=1)
    for docs in _alike(sizes, HELD_WEIGHTS // k):
        lane = np.arange(sizes[docs].max())
        own = lane < sizes[docs][:, None]
        at = np.minimum(bound[docs][:, None] + lane, len(term) - 1)
        t, n = np.where(own, term[at], terms), np.where(own, count[at], 0.0)
        of_term = np.take(wide, t, axis=1).transpose(1, 0, 2)
        weights[docs], theta = _settled(of_term, n, prior, rounds, least)
        n /= np.matmul(theta[:, None, :], of_term)[:, 0] + 1e-100
        for i in range(k):
            stats[i] += np.bincount(t.ravel(), weights=(theta[:, i, None] * n).ravel(), minlength=terms + 1)
    return weights, stats[:, :terms] * words


def _parts(b: pa.RecordBatch, step: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, bounds, terms, counts) of runs of rows."""
    for lo in range(0, b.num_rows, step):
        part = b.slice(lo, step)
        sizes = part.column("term").value_lengths().to_numpy()
        bound = np.concatenate([[0], np.cumsum(sizes)])
        yield lo, lo + part.num_rows, bound, part.column("term").flatten().to_numpy(), part.column("n").flatten().to_numpy().astype(float)


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 in as many bytes each, 1, 2 or 4, as the largest takes; the first byte says how many."""
    most = x.max(initial=0)
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


#: Documents and terms of them in a packed row; one of the two may be less than full.
PACKED_ROWS, PACKED_TERMS = 8_192, 1 << 21


def packed_counts(rows: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """(rows (…, term, n) as few wide rows of bytes, written; what deletes them). Documents without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit() -> pa.RecordBatch:
            values = [narrow(np.concatenate(x)) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["sizes", "term", "n"])

        for b in batches:
            for _, _, bound, term, count in _parts(b, 512):
                sizes = np.diff(bound)
                if len(term):
                    held.append((sizes[sizes > 0], term, count))
                if sum(len(x[0]) for x in held) + 512 > PACKED_ROWS or sum(len(x[1]) for x in held) >= PACKED_TERMS:
                    yield emit()
        if held:
            yield emit()

    return kept(arrow_map(rows.select("term", "n"), run, "sizes binary, term binary, n binary"), "topic_packed")


def fit_topics(rows: DataFrame, k: int, terms: int, seed: int, iterations: int) -> np.ndarray:
    """Topics x terms after ``iterations`` of batch variational EM over rows (…, term array<int>, n array<long>).

    Both priors are 1 / k. Starts are gamma draws of shape 100 and mean 1.
    """
    topics = np.random.RandomState(seed).gamma(100.0, 0.01, (k, terms))
    packed, drop = packed_counts(rows)
    for _ in range(iterations):
        held = rows.sparkSession.sparkContext.broadcast(expected(topics))

        def add(total: np.ndarray, b: pa.RecordBatch) -> None:
            for each in zip(*(b.column(c).to_pylist() for c in ("sizes", "term", "n")), strict=True):
                sizes, term, count = map(widened, each)
                total += document_topics(np.concatenate([[0], np.cumsum(sizes)]), term, count.astype(float), held.value, 1 / k)[1]  # noqa: B023

        topics = task_sums(packed, add, (k, terms)) + 1 / k
        held.destroy()
    drop()
    return topics


def topic_of(rows: DataFrame, topics: np.ndarray, key: str) -> DataFrame:
    """(key, topic, confidence): the first largest share of each document."""
    k, kind = len(topics), rows.schema[key].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(expected(topics))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, end, bound, term, count in _parts(b):
                p = document_topics(bound, term, count, held.value, 1 / k)[0]
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([b.column(key).slice(lo, end - lo), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p.max(axis=1))], [key, "topic", "confidence"])

    return arrow_map(rows.select(key, "term", "n"), run, f"{key} {kind}, topic int, confidence double")


# ---------------------------------------------------------------- k-means


def _far(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, starts x rows x centers."""
    flat = centers.reshape(-1, x.shape[1])
    d = (x * x).sum(axis=1)[:, None] + (flat * flat).sum(axis=1) - 2 * x @ flat.T
    return np.maximum(d, 0).reshape(len(x), *centers.shape[:2]).transpose(1, 0, 2)


def _unit(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, dim)


def drawn_starts(rows: DataFrame, dim: int, k: int, seed: int, starts: int) -> np.ndarray:
    """``starts`` x ``k`` x dim: centers drawn from rows (id, v), each with a chance as the squared distance to those so far.

    A draw is a race: a row's time is exponential, from a hash of its id, at a rate of its weight; the first wins. All starts
    are drawn in one scan a center. Once every row is a center, the rows of least time follow.
    """
    centers = np.zeros((starts, 0, dim))
    for c in range(k):
        held = rows.sparkSession.sparkContext.broadcast(centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple | None] = [None] * starts
            for b in batches:
                if not b.num_rows:
                    continue
                x = _unit(b, dim)
                weight = _far(x, held.value).min(axis=2) if c else np.ones((starts, len(x)))  # noqa: B023
                for s in range(starts):
                    u = (b.column(f"u{s}").to_numpy() + 0.5) / float(1 << 62)
                    with np.errstate(divide="ignore"):
                        time = np.where(weight[s] > 1e-12, -np.log(u) / weight[s], 1e300 * u)
                    i = int(np.lexsort((b.column("id").to_numpy(), time))[0])
                    found = (float(time[i]), int(b.column("id")[i].as_py()), x[i].tolist())
                    best[s] = found if best[s] is None else min(best[s], found)
            out = [{"s": s, "time": f[0], "id": f[1], "x": f[2]} for s, f in enumerate(best) if f is not None]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("s", pa.int32()), ("time", pa.float64()), ("id", pa.int64()), ("x", pa.list_(pa.float64()))]))

        draws = [F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{s}:{c}"), "id"), 2).alias(f"u{s}") for s in range(starts)]
        raced = arrow_map(rows.select("id", "v", *draws), run, "s int, time double, id long, x array<double>")
        won = {r.s: r.x for r in raced.groupBy("s").agg(F.min_by("x", F.struct("time", "id")).alias("x")).collect()}
        centers = np.concatenate([centers, np.array([won[s] for s in range(starts)])[:, None]], axis=1)
        held.destroy()
    return centers


def lloyd(rows: DataFrame, dim: int, centers: np.ndarray, most: int = 300, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(centers, cost of each start): steps of all starts in one scan, until no start's centers move more than ``least``.

    A center without rows stays. A start that has settled is carried on, as it costs no scan of its own."""
    starts, k = centers.shape[:2]
    for _ in range(most):
        held = rows.sparkSession.sparkContext.broadcast(centers)

        def add(total: np.ndarray, b: pa.RecordBatch) -> None:
            x = _unit(b, dim)
            if not len(x):
                return
            far = _far(x, held.value)  # noqa: B023
            at, cost = far.argmin(axis=2), far.min(axis=2)
            wide = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for s in range(starts):
                one = np.zeros((len(x), k))
                one[np.arange(len(x)), at[s]] = 1
                total[s, :, 1:] += one.T @ wide
                total[s, :, 0] += np.bincount(at[s], weights=cost[s], minlength=k)

        total = task_sums(rows.select("v"), add, (starts, k, 2 + dim))
        held.destroy()
        n = total[..., 1:2]
        new = np.where(n > 0, total[..., 2:] / np.maximum(n, 1), centers)
        moved, cost = np.abs(new - centers).max(), total[..., 0].sum(axis=1)
        if moved <= least:
            break
        centers = new
    return centers, cost
