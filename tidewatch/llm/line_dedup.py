"""Line deduplication across a corpus: exact repeats, and lines one word edit apart.

A line is its sequence of words, A-Z in lower case; blank lines are never touched.  Of equal lines the
earliest occurrence (by doc_id, then line number) stays.  A line of at least ``MIN_WORDS`` words also
goes if an earlier such line is within one word edit (insertion, deletion or substitution).

A row is its doc_id and, where texts share one, the hash of its text, so rows that share a doc_id are judged each
for itself (in the order of those hashes).

Deletion-neighbourhood join: a line's variants (itself, and itself without each word) are hashed;
lines within one edit share a variant, at the same place for a substitution, with the other line whole
for an insertion.  Within one (variant, place) all lines are one substitution apart, so each is paired
with the earliest only, and no group is expanded into pairs.  The earliest of a group is a grouped minimum,
combined before the shuffle and joined back: a template with a third of all lines is never one task's.
Pairs are verified on their words.

Only lines that share a half with another line emit variants: one edit leaves the first or the last
half of both lines equal, so no pair is lost.  ``n // 2`` words make a half, n being the shorter
line's length, so a line has keys for its own length and for one less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, frugal, lower_words, materialize, mix, positional, small_batches, text_buffer, word_bounds, word_hashes

#: One edit leaves at least three quarters of a line of so many words; shorter lines count as repeats only if equal.
MIN_WORDS = 4
#: Up to so many rows (of some tens of bytes), or line numbers (4 bytes each, a row counting as six more), the smaller side
#: of a join is broadcast, some 400 kB.  They are counted: how small a Parquet file is says little about its rows in
#: memory.  Beyond, both sides are shuffled and merged, which is what any larger corpus takes.
BROADCAST_ROWS = 20_000

_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INV = tuple(np.uint64(pow(int(m), -1, 1 << 64)) for m in _MULT)
_LINES = "doc_id long, key long, line int, n int, a long, b long, p0 long, s0 long, p1 long, s1 long"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class _Rolled:
    """Hashes of any runs of words in a sequence, from prefix sums."""

    def __init__(self, words: np.ndarray, lane: int):
        n = len(words)
        self.inv = _powers(_INV[lane], n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * _powers(_MULT[lane], n), out=self.sums[1:])
        self.mult = _powers(_MULT[lane], n + 1)

    def run(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.inv[begin]

    def without(self, begin: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of words begin..end without word at."""
        return (self.sums[at] - self.sums[begin]) * self.inv[begin] + (self.sums[end] - self.sums[at + 1]) * self.inv[np.minimum(begin + 1, len(self.inv) - 1)]


def _lines_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(words, first word, end word, row, line number) of the lines with a word."""
    raw, off = text_buffer(column)
    words, word_off = word_hashes(column, lower=True)
    begin, _ = word_bounds(raw, off)
    row = np.repeat(np.arange(len(column)), np.diff(word_off))
    breaks = np.r_[0, np.cumsum(raw == 0x0A)]
    number = breaks[begin] - breaks[off[:-1]][row]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (number[1:] != number[:-1])]) if len(words) else np.zeros(0, np.int64)
    end = np.r_[first[1:], len(words)] if len(first) else first
    return words, first, end, row[first], number[first]


@frugal
def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in by_size(batch, 2):
                words, first, end, row, number = _lines_of(part.column(2))
                if not len(first):
                    continue
                n = end - first
                lanes = [_Rolled(words, k) for k in (0, 1)]
                ids = [mix(r.run(first, end) + mix(n.astype(np.uint64))).view(np.int64) for r in lanes]
                keys = []
                for less in (0, 1):
                    length = n - less
                    half = length // 2
                    for side, (x, y) in enumerate(((first, first + half), (end - half, end))):
                        tag = mix((length * 2 + side).astype(np.uint64))
                        keys.append(pa.array(mix(lanes[0].run(x, y) ^ tag).view(np.int64), mask=length < MIN_WORDS))
                doc, key = (part.column(k).take(pa.array(row)) for k in (0, 1))
                cols = [doc, key, pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), *map(pa.array, ids), *keys]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _LINES.split(", ")])


_VARIANTS = "variant long, place int, doc_id long, key long, line int"


#: Variants of lines that are made at once.
_AT_ONCE = 1 << 17


@frugal
def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, line, words) -> a row for the whole line (place -1) and one for each word left out."""
    names = [f.split()[0] for f in _VARIANTS.split(", ")]
    with np.errstate(over="ignore"):
        for part in (p for b in batches for p in by_size(b, 3)):
            words, off = word_hashes(part.column(3), lower=True)
            begin, end = off[:-1], off[1:]
            n = end - begin
            rolled = _Rolled(words, 0)
            line = lambda at: [part.column(k).take(pa.array(at)) for k in range(3)]  # noqa: B023, E731
            whole = mix(rolled.run(begin, end) ^ mix(n.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(np.full(len(n), -1, dtype=np.int32)), *line(np.arange(len(n)))], names=names)
            for lo in range(0, len(words), _AT_ONCE):
                every = np.arange(lo, min(lo + _AT_ONCE, len(words)))
                row = np.searchsorted(end, every, side="right")
                less = mix(rolled.without(begin[row], end[row], every) ^ mix((n[row] - 1).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(less.view(np.int64)), pa.array((every - begin[row]).astype(np.int32)), *line(row)], names=names)


def within_one_edit(x: list, y: list) -> bool:
    """True if the sequences are at most one insertion, deletion or substitution apart."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]


@frugal
def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, line, words, words) -> (doc_id, key, line) of the pairs within one edit."""
    for batch in batches:
        both = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
        keep = pa.array([i for i, (x, y) in enumerate(both) if within_one_edit(lower_words(x), lower_words(y))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in range(3)], names=list(_AT))


@frugal
def _picked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, text, lines) -> (doc_id, key, line, words) of the listed lines."""
    for batch in batches:
        row, line, words = [], [], []
        for k, (text, lines) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            parts = (_unpacked(text) or "").split("\n")
            row += [k] * len(lines)
            line += lines
            words += [parts[x] for x in lines]
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(words, pa.string())], names=[*_AT, "words"])


_AT = ("doc_id", "key", "line")


def _packed(text: str | None) -> bytes | None:
    """A text as it is shuffled: its size and its bytes, compressed."""
    if text is None:
        return None
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(text: str | bytes | None) -> str | None:
    if text is None or isinstance(text, str):
        return text
    return pa.decompress(text[8:], int.from_bytes(text[:8], "little"), codec="zstd", asbytes=True).decode()


def _pack(docs: DataFrame, at: int) -> DataFrame:
    """docs with column number at, a text, packed."""
    name = docs.columns[at]
    schema = docs.withColumn(name, F.col(name).cast("binary")).schema

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array(map(_packed, cols[at].to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(pack, schema)


def _side(df: DataFrame, rows: int) -> DataFrame:
    """The smaller side of a join, by its number of rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def text_key(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text.cast("string"))


class LineDedup:
    """Decisions about the lines of documents (doc_id, text).

    Null and empty texts have no lines.  Rows that share a doc_id are judged by their texts; rows equal in both are
    treated alike.  Rows without doc_id are left as they are.  An empty table gives empty results.  Other columns,
    whatever their names, pass through ``apply`` (n_chars, if there, follows the text).
    """

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
        hashed = rows.select("doc_id", text_key(F.col("text")).alias("key")).groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("top"))
        self.shared = materialize(hashed.filter("low <> top").select(F.col("doc_id").alias("_shared_id")), "lines-shared-ids")
        self.n_shared = self.shared.count()
        rows = self._keyed(rows, F.col("doc_id"), F.col("text")).select("doc_id", F.col("_key").alias("key"), "text")
        lines = materialize(rows.mapInArrow(_line_rows, _LINES), "lines")
        place = F.struct(*_AT)
        halves = [F.first(c).alias(c) for c in ("p0", "s0", "p1", "s1")]
        first = materialize(lines.groupBy("n", "a", "b").agg(F.min(place).alias("at"), F.max(place).alias("last"), *halves), "lines-first")
        self.near = materialize(self._near(rows, first), "lines-near")
        near_at = self.near.select(place.alias("at"), F.lit(True).alias("near"))
        judged = first.join(near_at, "at", "left").filter("near or at <> last").select("n", "a", "b", F.col("at"), F.coalesce("near", F.lit(False)).alias("near"))
        judged = materialize(judged, "lines-judged")
        here = place == F.col("at")
        dropped = lines.select(*_AT, "n", "a", "b").join(_side(judged, judged.count()), ["n", "a", "b"]).filter(F.col("near") | ~here)
        dropped = dropped.select(*_AT, (F.col("near") & here).alias("near")).distinct()
        self.dropped = materialize(dropped.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.count_if("near").alias("n_near")), "lines-dropped")

    def _near(self, rows: DataFrame, first: DataFrame) -> DataFrame:
        """(doc_id, key, line): first occurrences that are one edit from an earlier line."""
        halves = first.select("at", F.explode(F.array("p0", "s0", "p1", "s1")).alias("half")).filter("half is not null")
        # A line has a half at most once, as length and side are part of it: two rows are two lines.
        common = materialize(halves.groupBy("half").count().filter("count > 1").select("half"), "lines-halves")
        shared = halves.join(_side(common, common.count()), "half", "left_semi").select("at.*").distinct()
        wanted = materialize(shared.groupBy("doc_id", "key").agg(F.collect_list("line").alias("lines")), "lines-wanted")
        picked = self._beside(rows, F.col("doc_id"), F.col("key"), 2, wanted, "inner").select("doc_id", "key", "text", "lines").mapInArrow(_picked_rows, "doc_id long, key long, line int, words string")
        texts = materialize(picked.dropDuplicates(list(_AT)), "lines-texts")
        variants = materialize(texts.mapInArrow(_variant_rows, _VARIANTS).select("variant", "place", F.struct(*_AT).alias("at")), "lines-variants")
        # The earliest line of a group; a substitution group is (variant, place), a whole line has place -1.
        # Most variants are one line's alone; the rest of the join is about those that lines share.
        common = materialize(variants.groupBy("variant").agg(F.min("at").alias("low"), F.max("at").alias("top")).filter("low <> top").select("variant"), "lines-common")
        variants = materialize(variants.join(_side(common, common.count()), "variant", "left_semi"), "lines-shared")
        hubs = variants.groupBy("variant", "place").agg(F.min("at").alias("hub"), F.max("at").alias("last"))
        hubs = materialize(hubs.filter("place = -1 or hub <> last"), "lines-hubs")
        left_out = variants.filter("place >= 0")
        substituted = left_out.join(hubs.filter("place >= 0"), ["variant", "place"]).select(F.col("at").alias("x"), F.col("hub").alias("y"))
        inserted = left_out.join(hubs.filter("place = -1").drop("place"), "variant").select(F.col("at").alias("x"), F.col("hub").alias("y"))
        pairs = substituted.unionByName(inserted).filter("x <> y").select(F.greatest("x", "y").alias("later"), F.least("x", "y").alias("earlier")).distinct()
        pairs = materialize(pairs, "lines-pairs")
        side = texts.select(F.struct(*_AT).alias("at"), "words")
        both = pairs.join(side.select(F.col("at").alias("later"), F.col("words").alias("x")), "later").join(side.select(F.col("at").alias("earlier"), F.col("words").alias("y")), "earlier")
        return both.select("later.*", "x", "y").mapInArrow(_near_rows, "doc_id long, key long, line int").distinct()

    def _keyed(self, docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
        """docs with _key: the hash of the text where texts share the doc_id (or everywhere, if such ids are too many to broadcast), else 0."""
        if not self.n_shared:
            return docs.withColumn("_key", F.lit(0).cast("long"))
        if self.n_shared > BROADCAST_ROWS:
            return docs.withColumn("_key", text_key(text))
        marked = docs.join(F.broadcast(self.shared), doc_id == F.col("_shared_id"), "left")
        return marked.withColumn("_key", F.when(F.col("_shared_id").isNotNull(), text_key(text)).otherwise(F.lit(0).cast("long"))).drop("_shared_id")

    @staticmethod
    def _beside(docs: DataFrame, doc_id: Column, key: Column, text_at: int, by_doc: DataFrame, how: str) -> DataFrame:
        side = by_doc.withColumnsRenamed({"doc_id": "_line_doc", "key": "_line_key"})
        size = by_doc.agg(F.coalesce(F.sum(F.size("lines") + 6), F.lit(0)).alias("n")).first()["n"]
        if size > BROADCAST_ROWS:
            docs = _pack(docs, text_at)
        return docs.join(_side(side, size), (doc_id == F.col("_line_doc")) & (key == F.col("_line_key")), how).drop("_line_doc", "_line_key")

    def _cut(self, docs: DataFrame) -> DataFrame:
        """docs, columns by position, without the dropped lines; n_dropped and n_near beside (null where nothing goes): one join of the texts."""
        names = docs.columns
        text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
        doc_id, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{text_at}")
        side = self.dropped.withColumn("n_dropped", F.size("lines").cast("long"))
        rows = self._beside(self._keyed(positional(docs), doc_id, text), doc_id, F.col("_key"), text_at, side, "left")
        rows = rows.select(*[f"c{k}" for k in range(len(names))], "n_dropped", "n_near", "lines")
        schema = positional(docs).withColumns({c: F.lit(None).cast("long") for c in ("n_dropped", "n_near")}).schema
        kept, text_type = schema.names, pa.string()

        @frugal
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines = batch.column(len(kept)).to_pylist()
                texts = [_unpacked(t) for t in batch.column(text_at).to_pylist()]
                for i, gone in enumerate(lines):
                    if gone and texts[i] is not None:
                        out = set(gone)
                        texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in out)
                cols = list(batch.columns[: len(kept)])
                cols[text_at] = pa.array(texts, text_type)
                if chars_at is not None:
                    old = cols[chars_at].to_pylist()
                    cols[chars_at] = pa.array([len(t) if gone and t is not None else o for t, gone, o in zip(texts, lines, old, strict=True)], cols[chars_at].type)
                yield pa.RecordBatch.from_arrays(cols, names=kept)

        return rows.mapInArrow(cut, schema)

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs, all rows and columns, with the dropped lines cut out of text."""
        return self._cut(docs).drop("n_dropped", "n_near").toDF(*docs.columns)

    def report(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_dropped, n_near, text_sha256) of each row: lines cut, those of them that only nearly repeat, and the text left."""
        kept = self._cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
        none = F.lit(0).cast("long")
        return kept.select(F.col("c0").alias("doc_id"), F.coalesce("n_dropped", none).alias("n_dropped"), F.coalesce("n_near", none).alias("n_near"), F.sha2(F.coalesce("c1", F.lit("")).cast("binary"), 256).alias("text_sha256"))
