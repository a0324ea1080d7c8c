"""Quality rules as a short-circuit cascade, ordered by rejections per unit of cost.

The base counts are part of the result, so they are made for every row; rules beyond them form the
cascade.  On a bounded sample (``SAMPLE`` rows) it is measured what each rule costs on top of the base
counts, and which rows that pass the base checks it rejects.  The order is greedy: next comes the rule
that rejects most, for its cost, of the rows that all rules before it kept.  The order decides only how
much work is done, never the verdict: a document is kept if no rule rejects it.  Every rule sees whole
texts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SEP, mix, small_batches, text_buffer, word_hashes

SAMPLE = 2000
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags in each row."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][off])


class Texts:
    """Counts over a batch of texts, each made when a rule first asks for it."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.raw, self.off = text_buffer(column)

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return word_hashes(self.column)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self._words[1])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return _sums(~_SEP[self.raw] & ((self.raw & 0xC0) != 0x80), self.off)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        table = np.zeros(256, dtype=bool)
        table[list(SYMBOLS)] = True
        return _sums(table[self.raw], self.off)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return _sums((self.raw >= 0x41) & (self.raw <= 0x5A), self.off)

    @cached_property
    def n_letters(self) -> np.ndarray:
        low = self.raw | 0x20
        return _sums((low >= 0x61) & (low <= 0x7A), self.off)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        lines, repeats = [], []
        for text in self.column.to_pylist():
            seen: set[str] = set()
            n = 0
            for line in (text or "").split("\n"):
                if line.strip(SPACES):
                    n += 1
                    seen.add(line)
            lines.append(n)
            repeats.append(n - len(seen))
        return np.array(lines, dtype=np.int64), np.array(repeats, dtype=np.int64)

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside three-word windows that occur twice or more in the text."""
        words, off = self._words
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        size = max(0, len(words) - 2)
        with np.errstate(over="ignore"):
            three = (words[:size] * np.uint64(0x9E3779B97F4A7C15) + words[1 : size + 1]) * np.uint64(0xD6E8FEB86659FD93) + words[2 : size + 2]
            key = mix(three ^ mix(row[:size].astype(np.uint64)))
        at = np.flatnonzero(row[:size] == row[2 : size + 2])
        ordered = np.sort(key[at])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        place = np.searchsorted(twice, key[at]) if len(twice) else np.zeros(0, np.int64)
        again = at[twice[np.minimum(place, len(twice) - 1)] == key[at]] if len(twice) else at[:0]
        mark = np.zeros(len(words), dtype=bool)
        for k in range(3):
            mark[again + k] = True
        return _sums(mark, off)

    @cached_property
    def n_runs(self) -> np.ndarray:
        """Words equal to the word before them."""
        words, off = self._words
        same = np.zeros(len(words), dtype=bool)
        same[1:] = words[1:] == words[:-1]
        first = off[:-1][np.diff(off) > 0]
        same[first] = False
        return _sums(same, off)

    @cached_property
    def top_word(self) -> np.ndarray:
        """Occurrences of each text's most frequent word."""
        words, off = self._words
        out = np.zeros(len(off) - 1, dtype=np.int64)
        if not len(words):
            return out
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        with np.errstate(over="ignore"):
            key = mix(words ^ mix(row.astype(np.uint64)))
        # The row rides in the low bits, so that one plain sort groups equal words of a row.
        if len(off) > 4097:
            raise ValueError("batches have at most 4096 rows")
        key = (key & ~np.uint64(0xFFF)) | row.astype(np.uint64)
        key.sort()
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        np.maximum.at(out, (key[edge[:-1]] & np.uint64(0xFFF)).astype(np.int64), np.diff(edge))
        return out


@dataclass(frozen=True)
class Rule:
    """rejects(texts) -> boolean array; true rejects the row."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < 50) | (100 * t.n_repeat_words > 50 * t.n_words)


#: The method's rules beside the base checks.  Integer comparisons, so verdicts are the same everywhere.
RULES = (
    Rule("symbols", lambda t: 100 * t.n_symbols > 30 * t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 40 * t.n_lines),
    Rule("capitals", lambda t: (100 * t.n_upper > 60 * t.n_letters) & (t.n_letters >= 50)),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)),
    Rule("one_word", lambda t: 100 * t.top_word > 35 * t.n_words),
)
#: Least seconds that a rule is taken to cost on the sample.
_LEAST_COST = 1e-6


def _take(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows, pa.int64()))


def _narrow(texts: Texts, keep: np.ndarray) -> Texts:
    """The kept rows, with the counts made so far."""
    out = Texts(_take(texts.column, np.flatnonzero(keep)))
    for name in ("n_words", "word_chars", "n_symbols", "n_upper", "n_letters", "n_repeat_words", "n_runs", "top_word"):
        if name in texts.__dict__:
            out.__dict__[name] = texts.__dict__[name][keep]
    if "_lines" in texts.__dict__:
        out.__dict__["_lines"] = tuple(x[keep] for x in texts.__dict__["_lines"])
    if "_words" in texts.__dict__:
        words, off = texts.__dict__["_words"]
        many = np.diff(off)
        out.__dict__["_words"] = words[np.repeat(keep, many)], np.r_[0, np.cumsum(many[keep])]
    return out


def base_counts(t: Texts) -> list[np.ndarray]:
    """The counts that every row gets."""
    return [t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words]


def _measured(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    """For each batch: seconds of each rule beyond the base counts, and the rows by the set of rules that reject them (as bits)."""
    for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
        texts = Texts(batch.column(0))
        base_counts(texts)
        texts = _narrow(texts, ~base_failed(texts))
        known = dict(texts.__dict__)
        seconds, bits = [], np.zeros(len(texts.column), dtype=np.int64)
        for i, rule in enumerate(rules):
            texts.__dict__.clear()
            texts.__dict__.update(known)  # each pays for its own counts
            began = time.perf_counter()
            bad = rule.rejects(texts)
            seconds.append(time.perf_counter() - began)
            bits |= bad.astype(np.int64) << i
        found, many = np.unique(bits, return_counts=True)
        out = [(i, s, 0) for i, s in enumerate(seconds)] + [(-1 - b, 0.0, n) for b, n in zip(found.tolist(), many.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["what", "seconds", "n"])


def greedy_order(names: list[str], seconds: list[float], sets: dict[int, int]) -> list[int]:
    """Places of rules, best first: most rows rejected per second of those left; ties by name.

    sets: rows by the set of rules that reject them (as bits).
    """
    left, order = list(range(len(names))), []
    alive = dict(sets)
    while left:
        gain = {i: sum(n for b, n in alive.items() if b >> i & 1) / max(seconds[i], _LEAST_COST) for i in left}
        best = min(left, key=lambda i: (-gain[i], seconds[i], names[i]))
        order.append(best)
        left.remove(best)
        alive = {b: n for b, n in alive.items() if not b >> best & 1}
    return order


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> tuple[Rule, ...]:
    """Rules in the order of the cascade, from about ``sample`` rows.

    Comes to the driver: a row for each rule and for each set of rules that reject a row together.
    """
    rows = docs.count()
    if not rows:
        return rules
    some = docs.select(F.col("text").cast("string").alias("text")).sample(fraction=min(1.0, 1.5 * sample / rows), seed=7).limit(sample)
    found = some.mapInArrow(lambda it: _measured(it, rules), "what long, seconds double, n long").groupBy("what").agg(F.sum("seconds").alias("seconds"), F.sum("n").alias("n")).collect()
    cost = {r["what"]: r["seconds"] for r in found if r["what"] >= 0}
    sets = {-1 - r["what"]: r["n"] for r in found if r["what"] < 0}
    return tuple(rules[i] for i in greedy_order([r.name for r in rules], [cost.get(i, 0.0) for i in range(len(rules))], sets))


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _judged(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            t = Texts(part.column(1))
            counts = base_counts(t)
            failed = base_failed(t)
            kept = np.zeros(part.num_rows, dtype=bool)
            passed = np.flatnonzero(~failed)
            if len(passed):
                rest = _narrow(t, ~failed)
                kept[passed] = cascade(rest, rules)
            cols = [*counts, failed, kept]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=[f.split()[0] for f in _OUT.split(", ")])


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Kept rows; a rule sees only rows that all rules before it kept."""
    kept = np.zeros(len(texts.column), dtype=bool)
    alive = np.arange(len(texts.column))
    for rule in rules:
        if not len(alive):
            break
        bad = rule.rejects(texts)
        if bad.any():
            alive = alive[~bad]
            texts = _narrow(texts, ~bad)
    kept[alive] = True
    return kept


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Base counts and verdict of every document (doc_id, text).

    Null and empty texts have no words and fail; repeated rows are judged alike; an empty table
    gives an empty result; other columns are ignored, a null doc_id is carried; very long texts are
    counted whole.
    """
    small_batches(docs.sparkSession)
    order = ordered_rules(docs, rules, sample)
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return inputs.mapInArrow(lambda it: _judged(it, order), _OUT)
