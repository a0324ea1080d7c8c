"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else, labelled or not, is unlabelled text.  Features are
hashed byte grams of words (``SIZES`` bytes, a word's ends included), so stems count in any language.  A gram is
kept if clearly more of the positives than of all documents hold it; the latter is counted over the whole corpus.
The number of a document's grams, by powers of two, is a feature too: longer texts hold more grams by chance.
A few linear models, each in a Spark task of its own, are trained in numpy on the positives and their own share of
an unlabelled sample by the risk

    prior * R(positives, +) + max(0, R(unlabelled, -) - prior * R(positives, -)),

whose second part estimates the risk on the clean documents and, being a risk, must not go below zero: where it
does, the step only undoes that.  The prior is the share of toxic rows among the labels that may be learnt from,
unless the caller gives it.  The score is the mean of the models' probabilities.

Bounds, documented parameters of the fit: ``positives`` confirmed documents, ``unlabelled`` sampled ones.
Document frequencies cover all documents, and all are scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SEP, materialize, small_batches, text_buffer

#: Confirmed toxic documents that are learnt from, at most.
POSITIVES = 4000
#: Unlabelled documents that all models together are trained on, at most.
UNLABELLED = 20000
MEMBERS = 4
#: Bytes of a gram; a word counts with a mark at each end.
SIZES = (4, 5, 7)
BITS = 20
#: Bytes of text hashed at once.
BLOCK = 1 << 20
#: Classes of the number of grams of a document, by powers of two.
LENGTHS = 24
#: A score from which a document counts as toxic.
TOXIC = 0.3
#: A part of four of the ids is never learnt from.
HELD_OUT_PART = 2


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from learning; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_PART, F.lit(False))


def _grams(raw: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distinct (row << BITS | slot) of all grams of a lower-cased buffer whose words are set off by spaces."""
    gap = raw == 0x20
    seen = np.cumsum(gap, dtype=np.int32)
    keys = []
    for size in SIZES:
        n = len(raw) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, dtype=np.uint32)
        for j in range(size):
            h *= np.uint32(0x01000193)
            h ^= raw[j : j + n]
        inner = seen[size - 2 : size - 2 + n] == seen[:n]  # no gap but at the ends
        h = h[inner]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h >>= np.uint32(32 - BITS)
        keys.append(row[:n][inner] << np.uint32(BITS) | h)
    if not keys:
        return np.zeros(0, np.uint32)
    key = np.sort(np.concatenate(keys))
    first = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    return key[first]


def _spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows behind each other, a space before each and at the end, and the row of every byte."""
    low = _LOWER[raw]
    low[_SEP[raw]] = 0x20
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint32), np.diff(off) + 1)
    return np.append(np.insert(low, off[:-1], 0x20), np.uint8(0x20)), np.append(row, np.uint32(len(off) - 2))


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (row, slot) pairs of a text column, in blocks of whole rows; a longer row comes alone."""
    raw, off = text_buffer(column)
    at, rows = 0, len(off) - 1
    while at < rows:
        stop = int(np.searchsorted(off, off[at] + BLOCK, side="right")) - 1
        stop = min(max(stop, at + 1), at + (1 << (32 - BITS)), rows)
        part = off[at : stop + 1]
        if part[-1] - part[0] <= BLOCK:
            key = _grams(*_spaced(raw[part[0] : part[-1]], part - part[0]))
        else:
            have = np.zeros(1 << BITS, dtype=bool)
            whole, row = _spaced(raw[part[0] : part[-1]], part - part[0])
            for lo in range(0, len(whole), BLOCK):
                have[_grams(whole[lo : lo + BLOCK + max(SIZES) - 1], row[lo : lo + BLOCK + max(SIZES) - 1])] = True
            key = np.flatnonzero(have).astype(np.uint32)
        yield at + (key >> np.uint32(BITS)).astype(np.int64), (key & np.uint32((1 << BITS) - 1)).astype(np.int64)
        at = stop


def _counted(wanted: np.ndarray | None):
    """Document frequencies of the wanted slots (None: all) in a partition; slot -1 counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, slot in grams(batch.column(0)):
                total += np.bincount(slot, minlength=1 << BITS)
        slot = np.flatnonzero(total) if wanted is None else wanted[total[wanted] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, slot]), pa.array(np.r_[n, total[slot]])], names=["slot", "n"])

    return count


def frequencies(texts: DataFrame, wanted: np.ndarray | None = None) -> tuple[int, np.ndarray]:
    """Number of documents and the document frequency of each slot."""
    rows = texts.mapInArrow(_counted(wanted), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, dtype=np.int64)
    real = rows[rows["slot"] >= 0]
    out[real["slot"].to_numpy(np.int64)] = real["n"].to_numpy(np.int64)
    return int(rows.loc[rows["slot"] == -1, "n"].sum()), out


def telling(n_pos: int, pos: np.ndarray, n_all: int, every: np.ndarray, deviations: float = 4.0, lift: float = 2.0) -> np.ndarray:
    """Slots that more of the positives hold than chance explains, in at least three or a hundredth of them."""
    share = np.maximum(every, pos) / max(n_all, 1)
    over = pos - n_pos * share
    least = max(min(3, n_pos // 2), n_pos / 100, 1)
    return np.flatnonzero((pos >= least) & (over > deviations * np.sqrt(n_pos * share * (1 - share))) & (pos >= lift * n_pos * share))


class Matrix:
    """Presence of columns in rows, by pairs."""

    def __init__(self, row: np.ndarray, col: np.ndarray, rows: int, cols: int):
        self.row, self.col, self.rows, self.cols = row, col, rows, cols

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.cols)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risks(f_pos: np.ndarray, f_all: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * R(positives, +), R(unlabelled, -) - prior * R(positives, -)) under the logistic loss."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(f_pos), loss(-f_all) - prior * loss(-f_pos)


def fit_pu(pos: Matrix, every: Matrix, prior: float, ridge: float = 2e-3, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Weights and bias (last) of a linear model under the non-negative risk, by Adam on all rows."""
    k = pos.cols
    w = np.r_[np.zeros(k), np.log(prior / (1 - prior))]
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        f_pos, f_all = pos.dot(w[:-1]) + w[-1], every.dot(w[:-1]) + w[-1]
        up = -prior * _sigmoid(-f_pos) / pos.rows  # of prior * R(positives, +)
        down = _sigmoid(f_all) / every.rows, -prior * _sigmoid(f_pos) / pos.rows  # of the clean part
        if risks(f_pos, f_all, prior)[1] >= 0:
            g_pos, g_all = up + down[1], down[0]
        else:
            g_pos, g_all = -down[1], -down[0]
        g = np.r_[pos.back(g_pos) + every.back(g_all), g_pos.sum() + g_all.sum()]
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _columns(slots: np.ndarray) -> np.ndarray:
    table = np.full(1 << BITS, -1, dtype=np.int32)
    table[slots] = np.arange(len(slots))
    return table


def _present(column: pa.Array, table: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) pairs by row: of the n slots in use, and behind them of the classes of length."""
    for row, slot in grams(column):
        col = table[slot]
        rows, many = np.unique(row, return_counts=True)
        length = n + np.minimum(np.log2(many).astype(np.int64), LENGTHS - 1)
        every, cols = np.r_[row[col >= 0], rows], np.r_[col[col >= 0], length]
        order = np.argsort(every, kind="stable")
        yield every[order], cols[order]


@dataclass(frozen=True)
class Ensemble:
    """slots: grams in use; weights: one row for each model, its bias last."""

    slots: np.ndarray
    weights: np.ndarray

    def score(self, column: pa.Array, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.weights), len(column)))
        for row, col in _present(column, table, len(self.slots)):
            for k, w in enumerate(self.weights):
                out[k] += np.bincount(row, weights=w[col], minlength=len(column))
        return _sigmoid(out + self.weights[:, -1:]).mean(axis=0)


def _train(n: int):
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["positive", "key"])  # the same order in every run
        parts = []
        for flag in (True, False):
            cols = rows.loc[rows["positive"] == flag, "cols"].to_list()
            lengths = [len(c) for c in cols]
            flat = np.concatenate([np.asarray(c, dtype=np.int64) for c in cols]) if cols else np.zeros(0, np.int64)
            parts.append(Matrix(np.repeat(np.arange(len(cols)), lengths), flat, len(cols), n))
        w = fit_pu(parts[0], parts[1], float(rows["prior"].iloc[0]))
        return pd.DataFrame({"member": int(rows["member"].iloc[0]), "weights": [w]})

    return train


class ToxicityModel:
    """Fitted on documents (doc_id, text) and labels (doc_id, toxic); ``score`` judges any documents.

    Null and empty texts hold no gram and get the score of the bias; repeated rows score alike; a null doc_id is
    scored, not held out, and never matches a label; an id labelled twice is toxic if any label says so; rows that
    share an id share its label; very long texts are hashed in blocks, whole; columns beyond the named ones are
    ignored.  Without a confirmed toxic document, as with empty tables, every score is 0.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, members: int = MEMBERS):
        small_batches(docs.sparkSession)
        self.members = members
        rows = self._rows(docs)
        known = (
            labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
            .filter(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
            .groupBy("id")
            .agg(F.max("toxic").alias("toxic"))
        )
        stats = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("pos")).first()
        n_known, n_toxic = stats["n"], stats["pos"] or 0
        if prior is None:
            # Labels of clean documents set the prior only; if there are none, one in ten is taken to be toxic.
            prior = n_toxic / n_known if 0 < n_toxic < n_known else 0.1
        self.prior = float(np.clip(prior, 1e-4, 0.9))
        ids = known.filter("toxic > 0").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(positives).select("id")
        # At most ``positives`` ids are broadcast.
        toxic = materialize(rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["text"]), "toxic")
        n_pos, pos = frequencies(toxic.select("text"))
        self.model = Ensemble(np.zeros(0, np.int64), np.r_[np.zeros(LENGTHS), -40.0][None, :])
        if n_pos == 0:
            return
        n_all, every = frequencies(rows.select("text"), np.flatnonzero(pos))
        slots = telling(n_pos, pos, n_all, every)
        key = F.xxhash64("text", "doc_id", F.lit(7))
        share = min(1.0, unlabelled / max(n_all, 1))
        sample = rows.withColumn("key", key).filter(key.bitwiseAND(F.lit((1 << 40) - 1)) < int(share * (1 << 40)))
        # Rows that repeat an id and a text are alike to the hash: one of each is drawn.
        sample = sample.dropDuplicates(["key"]).select(F.lit(False).alias("positive"), "key", "text")
        both = toxic.select(F.lit(True).alias("positive"), key.alias("key"), "text").unionByName(sample)
        listed = both.mapInArrow(self._listed(slots), "positive boolean, key long, cols array<int>")
        own = F.pmod(F.col("key").bitwiseAND(F.lit(0xFFFF)), F.lit(members)).cast("int")
        member = F.explode(F.when(F.col("positive"), F.array(*[F.lit(k) for k in range(members)])).otherwise(F.array(own)))
        # A group is at most ``positives`` and a share of ``unlabelled`` rows of telling grams.
        found = listed.select(member.alias("member"), "positive", "key", "cols", F.lit(self.prior).alias("prior")).groupBy("member").applyInPandas(_train(len(slots) + LENGTHS), "member int, weights array<double>").toPandas()
        self.model = Ensemble(slots, np.array(found.sort_values("member")["weights"].to_list()))

    @staticmethod
    def _rows(docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    @staticmethod
    def _listed(slots: np.ndarray):
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _columns(slots)
            for batch in batches:
                pairs = list(_present(batch.column(2), table, len(slots)))
                row = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
                col = np.concatenate([p[1] for p in pairs]).astype(np.int32) if pairs else np.zeros(0, np.int32)
                off = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                cols = pa.ListArray.from_arrays(pa.array(off), pa.array(col, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cols], names=["positive", "key", "cols"])

        return listed

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted) of every row."""
        model = self.model

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _columns(model.slots)
            for batch in batches:
                score = np.round(model.score(batch.column(1), table), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= TOXIC).astype(np.int32))], names=["doc_id", "score", "predicted"])

        out = self._rows(docs).mapInArrow(judged, "doc_id long, score double, predicted int")
        return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
