"""Periodic runs of words: an all-lag scan, shared out by ranges of lags.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring word extends
keeping q, at least ``min_length`` words and ``min_exp`` periods long.  Its period is at most n / min_exp, so the
array of word ids is compared with itself shifted by each such lag, many lags at once; stretches of equality of a
lag are the runs whose period divides it, and those of a smaller period are left out by looking at the lag's prime
divisors (of two periods of so long a stretch, their greatest common divisor is a third).

A document costs n * n / min_exp comparisons.  One that costs more than ``RANGE`` is dealt out: each range of its
lags is a row of its own, so that the lags of one very long document are scanned on many machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Comparisons of one range of lags, about.
RANGE = 1 << 24
#: Comparisons made at once (bytes of the largest array).
_AT_ONCE = 1 << 22


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words))


def _primes(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + ([q] if q > 1 else [])


def scan(ids: np.ndarray, low: int, high: int, min_exp: int, min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with a period from low to below high."""
    n = len(ids)
    high = min(high, n // min_exp + 1)
    low = max(low, 1)
    if low >= high:
        return []
    step = max(1, _AT_ONCE // max(n, 1))
    found = []
    behind = np.concatenate([ids, np.full(high, -1, dtype=ids.dtype)])
    for first in range(low, high, step):
        lags = np.arange(first, min(first + step, high))
        shifted = np.lib.stride_tricks.sliding_window_view(behind[first : first + n + len(lags) - 1], n)
        same = shifted == ids
        least = np.maximum(min_length - lags, (min_exp - 1) * lags)
        for k in np.flatnonzero(np.count_nonzero(same, axis=1) >= least).tolist():
            q = int(lags[k])
            edge = np.flatnonzero(np.diff(same[k].view(np.int8), prepend=0, append=0))
            begin, end = edge[::2], edge[1::2]
            long = end - begin >= least[k]
            parts = [q // p for p in _primes(q)]
            for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
                stretch = ids[a : b + q]
                if not any(np.array_equal(stretch[p:], stretch[:-p]) for p in parts):
                    found.append((a, b + q - a, q))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by a space: of each run its first period stays."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _as_rows(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"start": s, "length": n, "period": q} for s, n, q in sorted(r, key=lambda r: (r[0], r[2]))] for r in runs], _RUN_TYPE)


class PeriodicRuns:
    """Runs of every document (doc_id, text), and its text with each run cut to its first period.

    Null texts and texts without words have no run and collapse to nothing; a null doc_id is carried; rows are
    judged each for itself, so rows that share an id, or repeat, give a result each; very long texts are dealt out by
    ranges of lags; other columns are ignored; an empty table gives no rows.
    """

    def __init__(self, min_exp: int = 4, min_length: int = 6, comparisons: int = RANGE):
        if min_exp < 3:
            raise ValueError("min_exp must be 3 or more: with less, a smaller period need not divide a lag")
        self.min_exp, self.min_length, self.comparisons = min_exp, min_length, comparisons

    def find(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, runs, collapsed): runs by start, then period; words are numbered from 0."""
        small_batches(docs.sparkSession)
        min_exp, min_length, budget = self.min_exp, self.min_length, self.comparisons
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        out = f"doc_id long, n_words long, runs {_RUNS}, collapsed string"

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, runs, texts = [], [], []
                for text in batch.column(1):
                    words = text.as_py().encode().split()
                    r = scan(word_ids(words), 1, len(words), min_exp, min_length)
                    counts.append(len(words))
                    runs.append(r)
                    texts.append(collapse(words, r).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), _as_rows(runs), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

        def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                runs = []
                for text, low, high in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    words = text.as_py().encode().split()
                    # Ranges are set by a bound of the words, so the last may end beyond the last lag.
                    runs.append(scan(word_ids(words), low, high, min_exp, min_length))
                yield pa.RecordBatch.from_arrays([batch.column(0), _as_rows(runs)], names=["key", "found"])

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, texts = [], []
                for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                    words = text.as_py().encode().split()
                    counts.append(len(words))
                    texts.append(collapse(words, [(r["start"], r["length"], r["period"]) for r in runs]).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(2), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

        # Bounds of the number of words: half the bytes, and for texts beyond that bound one more than the separators.
        half = F.expr("octet_length(text) div 2 + 1")
        gaps = F.length("text") - F.length(F.translate("text", " \t\n\r\x0b\x0c", "")) + 1
        most = F.when(half.cast("double") * half / min_exp <= budget, half).otherwise(gaps)
        cost = most.cast("double") * most / min_exp
        short = rows.filter(cost <= budget).mapInArrow(whole, out)
        # Equal long rows are scanned once; their number gives the result as often as they are there.
        long = rows.filter(cost > budget).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"))
        long = long.withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256))
        lags = F.floor(most / min_exp) + 1
        parts = F.ceil(cost / F.lit(float(budget))).cast("long")
        width = (F.expr("lags div parts") + 1).cast("long")
        dealt = long.select("key", "text", lags.alias("lags"), parts.alias("parts")).withColumn("width", width)
        dealt = dealt.select("key", "text", "width", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = dealt.select("key", "text", (F.col("part") * F.col("width") + 1).alias("low"), ((F.col("part") + 1) * F.col("width") + 1).alias("high"))
        found = dealt.repartition(F.col("key"), F.col("low")).mapInArrow(ranged, f"key string, found {_RUNS}")
        # Runs of a document are fewer than its words.
        order = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")
        found = found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("found")), order).alias("runs"))
        again = long.join(found, "key").select("doc_id", "text", "runs", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        return short.unionByName(again.select("doc_id", "text", "runs").mapInArrow(joined, out))


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; ties: smallest start, then period; null without a run."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, better)


def listing(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the strongest run, and digests of all runs and of the collapsed text."""
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listing(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted(docs: DataFrame) -> DataFrame:
    """The rows (doc_id, text) of docs; of ids whose crc32 h is divisible by 10, the tail of the text is periodic.

    With n words and g = floor(h / 10), each word i >= a is replaced by word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)).  Rows without words or with a null doc_id stay as they are.
    """

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                h = None if doc_id is None else crc32(str(doc_id).encode())
                if h is None or h % 10 or not texts[k]:
                    continue
                words = texts[k].encode().split()
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    tail = words[a : a + p]
                    texts[k] = b" ".join(words[:a] + [tail[i % p] for i in range(n - a)]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(plant, "doc_id long, text string")
