"""Weak-label quality model.

Overlapping heuristics vote low (1), fine (0) or abstain (-1) on every document.  Expectation-
maximisation over the counts of vote patterns (labellers are one-sided, so there are at most
2 ** labellers of them, counted over all documents) estimates each labeller's accuracy and gives every
pattern a posterior.  A linear scorer on hashed byte pairs and hashed repetition levels is then trained
on posteriors of at most ``TRAIN`` documents, and scores all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix, small_batches
from .rules import Texts

#: Documents that the scorer is fitted on, about (chosen by hash of doc_id and text, repeated rows once; never more
#: than twice as many); 4 * DIM bytes each.
TRAIN = 6000
#: Buckets of the hashed features.
DIM = 512
REJECT = 0.5

def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _count(flags: np.ndarray, t: Texts) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][t.off])


def _plain(t: Texts) -> np.ndarray:
    """Far from every sign of low quality."""
    quiet = (_share(t.n_symbols, t.n_words) < 0.05) & (_share(t.n_upper, t.n_letters) < 0.2) & (_share(_count(t.raw == 0x21, t), t.n_words) < 0.05)
    return quiet & (_share(t.n_repeat_words, t.n_words) < 0.5) & (_share(t.top_word, t.n_words) < 0.2)


# Each labeller votes for one class where it sees its sign, and abstains elsewhere: (class, sign).
LABELLERS = {
    "symbols": (1, lambda t: (_share(t.n_symbols, t.n_words) > 0.25) & (t.n_words >= 5)),
    "symbol_chars": (1, lambda t: (_share(t.n_symbols, t.word_chars) > 0.05) & (t.n_words >= 5)),
    "capitals": (1, lambda t: (_share(t.n_upper, t.n_letters) > 0.55) & (t.n_letters >= 20)),
    "marks": (1, lambda t: (_share(_count(t.raw == 0x21, t), t.n_words) > 0.3) & (t.n_words >= 5)),
    "top_word": (1, lambda t: (_share(t.top_word, t.n_words) > 0.3) & (t.n_words >= 20)),
    "windows": (1, lambda t: (_share(t.n_repeat_words, t.n_words) > 0.6) & (t.n_words >= 20)),
    "runs": (1, lambda t: (_share(t.n_runs, t.n_words) > 0.3) & (t.n_words >= 20)),
    "plain": (0, lambda t: _plain(t) & (t.n_words >= 5)),
    "varied": (0, lambda t: (_share(t.top_word, t.n_words) < 0.15) & (_share(t.n_repeat_words, t.n_words) < 0.4) & (_share(t.n_symbols, t.word_chars) < 0.02)),
}


def votes(t: Texts) -> np.ndarray:
    """Rows by labellers: 1 low, 0 fine, -1 abstains."""
    out = np.empty((len(t.off) - 1, len(LABELLERS)), dtype=np.int8)
    for j, (label, sign) in enumerate(LABELLERS.values()):
        out[:, j] = np.where(sign(t), label, -1)
    return out


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


@dataclass(frozen=True)
class LabelModel:
    """prior: share of low documents; accuracy: how often each labeller's vote is right."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is low."""
        weight = np.log(self.accuracy) - np.log(1 - self.accuracy)
        odds = np.log(self.prior / (1 - self.prior)) + np.where(v == 1, weight, np.where(v == 0, -weight, 0.0)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts."""
    v = votes_of(patterns)
    n = counts.astype(float)
    model = LabelModel(0.1, np.full(v.shape[1], 0.95))
    for _ in range(rounds):
        p = model.posterior(v)
        right = ((p * n) @ (v == 1)) + (((1 - p) * n) @ (v == 0))
        said = n @ (v >= 0)
        # Smoothed by four documents; labellers are taken to be better than chance.
        accuracy = np.clip((right + 3.8) / (said + 4), 0.55, 0.999)
        prior = float(np.clip((p @ n + 0.1) / (n.sum() + 1), 1e-4, 0.5))
        done = np.allclose(accuracy, model.accuracy, atol=1e-7) and abs(prior - model.prior) < 1e-7
        model = LabelModel(prior, accuracy)
        if done:
            break
    return model


_GRAMS = 3 * DIM // 4
_BUCKET = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % _GRAMS


def features(t: Texts) -> np.ndarray:
    """Rows by DIM hashed features: shares of byte pairs, and levels of repetition."""
    raw, off = t.raw, t.off
    rows = len(off) - 1
    size = np.diff(off)
    base = np.repeat(np.arange(rows) * DIM, size)
    pair = (raw[:-1].astype(np.uint16) << np.uint16(8)) | raw[1:]
    slot = base[:-1] + _BUCKET[pair]
    same = np.ones(len(slot), dtype=bool)
    inner = off[1:-1]
    same[inner[(inner > 0) & (inner < len(raw))] - 1] = False
    out = np.bincount(slot[same], minlength=rows * DIM).reshape(rows, DIM).astype(np.float32)
    out /= np.maximum(size - 1, 1)[:, None]
    words = np.maximum(t.n_words, 1)
    for name, share in (("windows", t.n_repeat_words / words), ("top", t.top_word / words)):
        level = np.minimum((share * 8).astype(np.int64), 7)
        slot = _GRAMS + np.array([hash_slot(f"{name}:{k}") for k in range(8)])[level]
        out[np.arange(rows), slot] += np.float32(0.05)
    return out


def hash_slot(name: str) -> int:
    h = np.frombuffer(name.encode().ljust(16, b"\0")[:16], dtype=np.uint64)
    with np.errstate(over="ignore"):
        return int(mix(h[:1] ^ mix(h[1:]))[0] % np.uint64(DIM // 4))


@dataclass(frozen=True)
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_scorer(x: np.ndarray, p: np.ndarray, ridge: float = 3.0, rounds: int = 12) -> Scorer:
    """Logistic regression on soft labels by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = np.c_[(x - mean) / scale, np.ones(len(x))].astype(np.float64)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (q - p) + penalty * w
        hess = (z * (q * (1 - q) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Scorer(mean, scale, w[:-1], float(w[-1]))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            yield part, Texts(part.column(1))


@frugal
def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, t in _texts(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pattern_of(votes(t)))], names=["doc_id", "pattern"])


@frugal
def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, t in _texts(batches):
        x = features(t)
        yield pa.RecordBatch.from_arrays([pa.array(pattern_of(votes(t))), pa.array([r.tobytes() for r in x], pa.binary())], names=["pattern", "x"])


_SCORED = "doc_id long, votes_low long, votes_fine long, posterior double, score double, kept boolean"


class QualityModel:
    """Fitted on documents (doc_id, text); ``score`` judges any.

    Null and empty texts get abstentions only and are kept; repeated rows are judged alike; a null
    doc_id is carried, and its row may be drawn for the fit like any other; very long texts are read whole; other columns are ignored, or kept by ``keep``; an
    empty table fits a model that keeps everything.
    """

    def __init__(self, docs: DataFrame, train: int = TRAIN):
        small_batches(docs.sparkSession)
        rows = self._rows(docs)
        found = rows.mapInArrow(_vote_rows, "doc_id long, pattern long").groupBy("pattern").count().collect()
        self.patterns = np.array([r["pattern"] for r in found], dtype=np.int64)
        counts = np.array([r["count"] for r in found], dtype=np.int64)
        self.labels = fit_labels(self.patterns, counts)
        total = int(counts.sum())
        share = min(1.0, train / max(total, 1))
        drawn = rows.withColumn("key", F.xxhash64("doc_id", "text", F.lit(11))).filter(F.col("key").bitwiseAND(F.lit((1 << 40) - 1)) < int(share * (1 << 40)))
        # Hashes of different rows are spread evenly, so twice the number expected is never reached; the order makes reruns agree.
        sample = drawn.dropDuplicates(["key"]).orderBy("key").limit(2 * train).select("doc_id", "text").mapInArrow(_train_rows, "pattern long, x binary").collect()
        if len(sample) >= 2:
            x = np.stack([np.frombuffer(bytes(r["x"]), dtype=np.float32) for r in sample])
            p = self.labels.posterior(votes_of(np.array([r["pattern"] for r in sample], dtype=np.int64)))
            order = np.lexsort((*x[:, :8].T, p))  # rows may arrive in any order; sums then agree between runs
            self.scorer = fit_scorer(x[order], p[order])
        else:
            self.scorer = Scorer(np.zeros(DIM), np.ones(DIM), np.zeros(DIM), -30.0)

    @staticmethod
    def _rows(docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, votes_low, votes_fine, posterior, score, kept): score is the linear scorer's probability of low quality."""
        labels, scorer = self.labels, self.scorer

        @frugal
        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, t in _texts(batches):
                v = votes(t)
                score = np.where(t.n_words > 0, scorer.score(features(t)), 0.0)
                cols = [(v == 1).sum(axis=1), (v == 0).sum(axis=1), np.round(labels.posterior(v), 6), np.round(score, 6), score <= REJECT]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=[f.split()[0] for f in _SCORED.split(", ")])

        return self._rows(docs).mapInArrow(judged, _SCORED)

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of docs, all columns, that the scorer does not reject."""
        scorer = self.scorer

        @frugal
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    part = batch.slice(lo, 200)
                    t = Texts(part.column(part.schema.get_field_index("text")))
                    yield part.filter(pa.array((t.n_words == 0) | (scorer.score(features(t)) <= REJECT)))

        return docs.mapInArrow(kept, docs.schema)
