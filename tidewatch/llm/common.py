"""Shared helpers: materialised tables in the shared folder, and vectorised word hashing.

Word hashing works on the UTF-8 buffer of an Arrow string column, so no Python string is made
per word.  A word is a maximal run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of every operator here (space and 0x09-0x0D separate words).
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a row group in intermediate tables: a writer holds one in memory.
ROW_GROUP = 16 << 20
#: Rows of an Arrow batch at most, as texts may be long.
BATCH_ROWS = 1000

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 19
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER_TABLE = _LOWER.tobytes()
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def positional(docs: DataFrame) -> DataFrame:
    """docs with columns named c0, c1, ... by place, so that a caller's names cannot meet an operator's own."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def frugal(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f, a generator of batches in a worker, giving Arrow's spare memory back after each and at its end: workers live on idle."""

    @wraps(f)
    def run(*args: object, **kw: object) -> Iterator[pa.RecordBatch]:
        for batch in f(*args, **kw):
            yield batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return run


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches at BATCH_ROWS rows in this session, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(name, "10000"))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z in lower case."""
    return (text or "").encode().translate(_LOWER_TABLE).split()


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * _BLOCK:
            _powers[int(base)] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def by_size(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20, most_rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with so many bytes of text at most, or one row: what is made of a text is many times its size."""
    _, off = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(off, off[at] + most_bytes, side="right")) - 1
        stop = min(max(stop, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def word_bounds(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; no word crosses a row start."""
    solid = ~_SEP[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[starts[starts <= len(raw)]] = True
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = False
        before[1:] = solid[:-1]
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return begin, end


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in row order, and the row offsets into them (length rows + 1).

    The buffer is hashed in blocks that end between words, so memory stays near the block size
    beside the result, however long a text is.
    """
    raw, off = text_buffer(column)
    parts: list[np.ndarray] = []
    counts = np.zeros(len(off), dtype=np.int64)
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + _BLOCK)
        while stop < len(raw) and not _SEP[raw[stop]]:
            ahead = np.flatnonzero(_SEP[raw[stop : stop + 65536]])
            stop = stop + int(ahead[0]) if len(ahead) else min(len(raw), stop + 65536)
        block = raw[at:stop]
        lo, hi = np.searchsorted(off, at), np.searchsorted(off, stop)
        begin, end = word_bounds(block, off[lo:hi] - at)
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        val = (_LOWER[block] if lower else block).astype(np.uint64)
        val += np.uint64(1)
        val *= _power(_BASE, len(block))
        np.cumsum(val, out=sums[1:])
        h = (sums[end] - sums[begin]) * _power(_BASE_INV, len(block) + 1)[begin]
        parts.append(mix(h + (end - begin).astype(np.uint64)))
        counts += np.bincount(np.searchsorted(off, begin + at, side="right"), minlength=len(off) + 1)[: len(off)]
        at = stop
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingle_sets(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, and the row offsets into them.

    A row with fewer words than ``size`` gives one hash for its whole sequence, a row without
    words none.
    """
    mult = np.uint64(0xD6E8FEB86659FD93)
    counts = np.diff(offsets)
    rolled = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for i in range(size):
        rolled *= mult
        rolled += words[i : i + len(rolled)]
    row = np.repeat(np.arange(len(counts)), counts)
    inside = row[: len(rolled)] == row[size - 1 :][: len(rolled)]
    full = counts >= size
    length = np.where(full, counts - size + 1, counts > 0)
    out = np.empty(int(length.sum()), dtype=np.uint64)
    long_row = np.repeat(full, length)
    out[long_row] = mix(rolled[inside])
    short = []
    for r in np.flatnonzero(~full & (counts > 0)).tolist():
        h = int(counts[r])
        for w in words[offsets[r] : offsets[r + 1]].tolist():
            h = (h * int(mult) + w) & 0xFFFFFFFFFFFFFFFF
        short.append(h ^ 0x5851F42D4C957F2D)
    out[~long_row] = mix(np.array(short, dtype=np.uint64))
    begin = np.r_[0, np.cumsum(length)]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][length > 0]] = True
    return out[new], np.r_[0, np.cumsum(new)][begin]
