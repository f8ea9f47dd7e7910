"""Toxicity by weak supervision.

Voters are words (a lexicon) and word beginnings of four to seven bytes (patterns) that labelled toxic texts hold far
more often than others. A generative label model estimates by expectation-maximisation how often each voter fires on
toxic and on other texts, and how voters correlate within a class; correlated voters share their weight. A logistic
classifier over voters is trained on the model's posterior labels and scores every text in one pass without a shuffle.

Fitting uses at most ``FIT_ROWS`` labelled rows, those least by a hash of the id, of which texts with the same least
word-pair hash (copies) count once; only hashed features reach the driver. Everything else covers all rows.

Null and empty texts fire no voter and score the classifier's base rate. Without labelled rows of both kinds every
score is 0. Repeated rows are scored alike; a repeated label counts once, of conflicting ones the larger; null labels
and ids are not learnt from. Only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import ALNUM_RAW, FOLD, Words, arrow_map, carried, mix64, text_steps

FIT_ROWS = 20_000
VOTERS = 400
#: Of a text in the sample, at most so many bytes of features' hashes travel: 8 a feature.
BEGINNINGS = (4, 5, 6, 7)
LEAST_TEXTS, LEAST_ODDS = 4, 2.5
#: So many of the candidates may pass the bound of evidence by chance alone.
BY_CHANCE = 1.0
EM_STEPS, FIT_STEPS = 20, 300
#: The row's own label is one more voter, of this accuracy.
LABEL_RIGHT = 0.98
_TABLE_SEED = np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(words: Words) -> list[np.ndarray]:
    """Hashes by kind: each word, then each of its beginnings (only words longer than that have one)."""
    out = [words.hashes(FOLD)]
    lens = words.ends - words.starts
    folded = FOLD[words.data]
    for k in BEGINNINGS:
        h = np.zeros(len(words), np.uint64)
        at = np.flatnonzero(lens > k)
        for i in range(k):
            h[at] = h[at] * np.uint64(0x100000001B3) + folded[words.starts[at] + i]
        h[at] = mix64(h[at] * _TABLE_SEED + np.uint64(k))
        out.append(h)
    return out


@dataclass
class Model:
    voters: np.ndarray
    weights: np.ndarray
    bias: float
    fires: np.ndarray
    shares: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        n = len(words.bound) - 1
        if not len(self.voters):
            return np.full(n, self.bias)
        doc, odds = words.owner(), np.full(n, self.bias)
        found = []
        for h in features(words):
            at = np.minimum(np.searchsorted(self.voters, h), len(self.voters) - 1)
            some = np.flatnonzero(self.voters[at] == h)
            found.append(doc[some] * len(self.voters) + at[some])
        once = np.unique(np.concatenate(found))
        odds += np.bincount(once // len(self.voters), self.weights[once % len(self.voters)], n)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> list:
    """(toxic, hash of all words, distinct feature hashes) of the fitting rows; texts of the same words count once."""
    rows = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id is not null and y is not null")
    rows = rows.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_steps(batch.column(1)):
                words = Words(data, offs, ALNUM_RAW)
                kinds = features(words)
                out, whole = [], []
                for d in range(hi - lo):
                    a, b = int(words.bound[d]), int(words.bound[d + 1])
                    out.append(np.unique(np.concatenate([k[a:b] for k in kinds])).view(np.int64))
                    whole.append(int.from_bytes(xxhash.xxh3_64_digest(kinds[0][a:b].tobytes()), "big", signed=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(whole, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["y", "whole", "found"])

    # FIT_ROWS rows of two numbers: small enough to broadcast at any scale.
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(rows), "id").select("y", "text")
    made = arrow_map(texts, run, "y int, whole long, found array<long>").groupBy("y", "whole").agg(F.max("found").alias("found"))
    return sorted(((r.y, r.whole, r.found) for r in _packed(made).toLocalIterator()), key=lambda r: (r[0], r[1]))


def _packed(df: DataFrame) -> DataFrame:
    """Arrays of longs as bytes: cheap to bring over and to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.asarray(x.values, np.int64).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["y", "whole", "found"])

    return arrow_map(df, run, "y int, whole long, found binary")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    rows = _sample(docs, labels, doc_id, text, label)
    y = np.array([r[0] for r in rows], np.int64)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros((2, 0)), np.zeros(0))
    if not len(y) or y.min() == y.max():
        return none
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    hit = np.unique(np.concatenate([s for s, t in zip(sets, y, strict=True) if t] or [np.zeros(0, np.uint64)]), return_counts=True)
    names, ones = hit
    names, ones = names[ones >= LEAST_TEXTS], ones[ones >= LEAST_TEXTS]
    others = np.zeros(len(names))
    for s, t in zip(sets, y, strict=True):
        if not t:
            others += np.isin(names, s, assume_unique=True) if len(names) < len(s) else 0
            if len(names) >= len(s):
                at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                others[at[names[at] == s]] += 1
    odds = np.log((ones + 0.5) / (y.sum() + 1)) - np.log((others + 0.5) / ((1 - y).sum() + 1))
    # Evidence against chance: half the G statistic, as natural logarithms. The more candidates, the higher the bound.
    both, share = ones + others, y.mean()
    g = ones * np.log(ones / (both * share)) + others * np.log(np.maximum(others, 1e-9) / (both * (1 - share)))
    best = np.flatnonzero((odds >= LEAST_ODDS) & (g >= np.log(max(1, len(names)) / BY_CHANCE)))
    best = best[np.lexsort((names[best], -g[best]))][:VOTERS]
    if not len(best):
        return none
    voters = np.sort(names[best])
    votes = np.zeros((len(y), len(voters)), np.float64)
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(voters, s), len(voters) - 1)
        votes[i, at[voters[at] == s]] = 1
    first = np.stack([(votes[y == c].sum(0) + 0.1) / ((y == c).sum() + 10) for c in (0, 1)])
    fires, shares, posterior = label_model(votes, y, float(share), first)
    weights, bias = classifier(votes, posterior)
    return Model(voters, weights, bias, fires, shares)


def label_model(votes: np.ndarray, y: np.ndarray, base: float, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(fires | class) as 2 x voters, share of each voter's evidence that is its own, P(toxic) of each row).

    A voter that does not fire abstains, which says nothing by itself; that none fires is evidence of its own. The share
    of toxic texts is that of the labels. Starts from voters that each fire on a tenth of toxic texts and on a thousandth of others, with a share of 1.
    """
    n, k = votes.shape
    fires = np.clip(first, 1e-5, 0.999)
    shares, p, none = np.ones(k), np.zeros(n), votes.sum(1) == 0
    missed, quiet = 0.1, 0.99
    labelled = np.where(y == 1, 1, -1) * np.log(LABEL_RIGHT / (1 - LABEL_RIGHT))
    for _ in range(EM_STEPS):
        on = np.log(fires[1] / fires[0]) * shares
        odds = np.log(base / (1 - base)) + votes @ on + none * np.log(missed / quiet) + labelled
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        mass = np.stack([1 - p, p])
        fires = np.clip((mass @ votes + [[0.1], [1.0]]) / (mass.sum(1, keepdims=True) + 10), 1e-5, 0.999)
        missed = float(np.clip(p[none].sum() / p.sum(), 0.01, 0.3))
        quiet = float(np.clip((1 - p)[none].sum() / (1 - p).sum(), 0.5, 0.999))
        # Correlations of voters given the class, averaged over both classes.
        corr = np.zeros((k, k))
        for c in (0, 1):
            centred = (votes - fires[c]) * np.sqrt(mass[c])[:, None]
            cov = centred.T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr += mass[c].sum() / n * cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        shares = 1 / (1 + np.where(corr > 0.3, corr, 0).sum(1))
    return fires, shares, p


def classifier(votes: np.ndarray, posterior: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Adam with a light ridge."""
    x = np.concatenate([votes, np.ones((len(votes), 1))], axis=1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log((posterior.mean() + 1e-6) / (1 - posterior.mean() + 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, FIT_STEPS + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - posterior) / len(x)
        g[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns (default all) and ``score``, the probability of being toxic."""
    kept = carried(docs, keep, ["score"])
    own = [f"c{k}" for k in range(len(kept))]
    chosen = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, own, strict=True)), F.col(f"`{text}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # VOTERS weights
    schema = chosen.drop("text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_steps(batch.column(batch.num_columns - 1)):
                s = shared.value.scores(Words(data, offs, ALNUM_RAW))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(s, pa.float64())], names=schema.names)

    found = arrow_map(chosen, run, schema)
    return found.select(*(F.col(n).alias(c) for c, n in zip(kept, own, strict=True)), "score")
