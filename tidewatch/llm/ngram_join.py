"""N-gram Jaccard self-join by a partitioned universe of tokens (pigeonhole), and its classes.

A document's set holds the 64-bit hashes of its distinct word shingles.  Documents with the same
set form one node.  Nodes fall into bands by set size (each ``GROWTH`` times the last); a node near a
band's lower end is also indexed in the band below, so any two sets that can reach the threshold
share a band.

Within a band the universe of hashes is cut into ``m`` equal segments.  Let |s| <= |r| and Jaccard >= t.
Then |r| <= |s|/t, and the sets differ in at most (1-t)/(1+t) (|s|+|r|) <= D(s) = floor(|s| (1-t)/t)
tokens.  Taking both sets' non-empty segments in order, fewer than D(s)+1 of either come before the
first segment in which the two agree.  So:

* A node indexes the hash of its subset in each of its first ``target(size)`` non-empty segments,
  more than D+1 of them.  A set whose tokens fall into D or fewer segments makes up for it by the
  one-deletion neighbourhoods of its subsets, which all sets of the band index in the first
  ``deletions`` segments.  ``m`` and ``deletions`` are chosen for each band from statistics over all
  documents: the coarsest choice whose keys cost little more than the cheapest.
* Of ``target`` units at least ``target - D`` agree, so nodes with fewer shared units are left out.
* A node probes its cheapest units only (cost-based allocation): those that nobody outside its component
  has are free, and of the others the ones with the fewest holders, D+1 with the free ones.
* Before that, each node is compared with the hub it shares most keys with, in rounds, until no round
  merges components.  Inside a component no further pair is looked at.
* Of any pair left, the smaller node probes a unit that the larger one holds, so only nodes that probe, or hold what
  a node of another component probes, go on (linear: each key knows its probes' least and greatest component).
* Those that go on meet over single tokens of their whole sets, ordered by holders, fewest first; tokens that no other
  component has come before all. At the first token that a pair shares, what either set has from there on bounds
  what they share. A token joins only where that reaches the threshold, so variants of one text that each have
  tokens of their own make no rows, however many they are: far less than one for each unit they share.
* A pair of that join must also pass a bound from parity sketches: two sets differ in at least as
  many tokens as their sketches differ in bits.  It is tested inside the join, so a key that many
  dissimilar nodes hold makes no rows.
* Candidates are verified on their words.

Nothing is capped: every pair at or above the threshold that joins different components is found.
The result is connectivity (classes): links inside a class are not enumerated, as a group of n near
copies has n * n of them.  Sets are told apart by 128 bits and their size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_words, materialize, mix, positional, shingle_sets, small_batches, word_hashes
from .components import connected_components

GROWTH = 8.0
#: Share of a set's tokens for which it indexes segments (at least D + 1 of them).
SPREAD = 0.42
#: Times at most that each node is compared with the most central node it shares most keys with.
HUB_ROUNDS = 4
#: Tokens for each segment at a band's upper end, by option; 0: each token is its own segment.
LOADS = (1.2, 0.4, 0.0)
#: A coarser option is taken if its keys are at most so many times those of the cheapest.
COARSER = 1.1
#: Up to so many ids (8 to 24 bytes each) are broadcast to filter documents; beyond, a shuffled join does it.
BROADCAST_IDS = 500_000
#: Longs in a parity sketch (a power of two).
SKETCH = 8
#: Documents that are looked at for very frequent keys, which are then dealt to ``SALTS`` tasks each.
#: That decides where rows go, never what is found.
HOT_SAMPLE, HOT_SHARE, HOT_KEYS, SALTS = 4000, 0.01, 50_000, 64

#: info: 0 indexed only; 1 subset in the home band; 2 one-deletion key there; from 4 on, marked as hot.
_KEYS = "key long, node long, info int"
_SKETCHES = [f"s{i}" for i in range(SKETCH)]
_NODES = "doc_id long, digest long, check long, n_shingles long, band int, " + ", ".join(f"{s} long" for s in _SKETCHES) + ", " + ", ".join(f"miss{i} int, units{i} long" for i in range(len(LOADS)))


def band_of(size: int) -> int:
    return int(math.floor(math.log(size, GROWTH) + 1e-9))


def band_low(band: int) -> int:
    return math.ceil(GROWTH**band - 1e-6)


def segments_of(band: int, load: float) -> int:
    return max(1, math.ceil(GROWTH ** (band + 1) / load))


def spare_of(size: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """D: tokens in which a set may differ from a partner at least as large (threshold num/den)."""
    return size * (den - num) // num


def target_of(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Units that a set indexes, if it has so many non-empty segments; never falls with the size."""
    return np.maximum(np.ceil(SPREAD * size).astype(np.int64), spare_of(size, num, den) + 1)


def node_ids(packed: bytes) -> tuple[int, int]:
    """128 bits of a set as two longs."""
    h = hashlib.blake2b(packed, digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch], size: int, rows: int = 300) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                yield part, *shingle_sets(*word_hashes(part.column(1), lower=True), size)


def _node_ids(hashes: np.ndarray, off: np.ndarray) -> list[tuple[int | None, int | None]]:
    return [node_ids(hashes[a:b].tobytes()) if b > a else (None, None) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _segments(hashes: np.ndarray, row: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each token (rising within a row, as hashes do), and where a row's next segment begins."""
    seg = (((hashes >> np.uint64(32)) * m.astype(np.uint64)[row]) >> np.uint64(32)).astype(np.int64)
    if not len(seg):
        return seg, seg
    return seg, np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])])


def _sketches(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Parity of the tokens on each of 64 * SKETCH bits: rows by SKETCH longs."""
    bits = 64 * SKETCH
    odd = np.bincount(row * bits + (hashes & np.uint64(bits - 1)).astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, bits), axis=1, bitorder="little").view("<i8")


def _node_rows(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for part, hashes, off in _sets(batches, size):
        count = np.diff(off)
        row = np.repeat(np.arange(len(count)), count)
        bands = np.array([band_of(n) if n else 0 for n in count.tolist()], dtype=np.int64)
        digest, check = zip(*_node_ids(hashes, off), strict=True) if len(count) else ((), ())
        sketch = _sketches(hashes, row, len(count))
        cols = [part.column(0), pa.array(digest, pa.int64()), pa.array(check, pa.int64()), pa.array(count), pa.array(bands.astype(np.int32), mask=count == 0)]
        cols += [pa.array(sketch[:, i].copy()) for i in range(SKETCH)]
        target = target_of(count, num, den)
        for load in LOADS:
            miss, filled = np.zeros(len(count), dtype=np.int64), count
            if load:
                m = np.array([segments_of(b, load) for b in bands.tolist()], dtype=np.int64)
                seg, first = _segments(hashes, row, m)
                filled = np.bincount(row[first], minlength=len(count))
                short = spare_of(count, num, den) + 1 - filled
                for r in np.flatnonzero((short > 0) & (count > 0)).tolist():
                    own, many = np.unique(seg[off[r] : off[r + 1]], return_counts=True)
                    own = own[many >= 2]  # a deletion must leave something
                    miss[r] = own[short[r] - 1] + 1 if short[r] <= len(own) else -1
            cols += [pa.array(miss.astype(np.int32)), pa.array(np.minimum(filled, target))]
        names = ["doc_id", "digest", "check", "n_shingles", "band", *_SKETCHES] + [f"{k}{i}" for i in range(len(LOADS)) for k in ("miss", "units")]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def choose_plans(nodes: DataFrame) -> dict[int, tuple[int, int]]:
    """band -> (option, deletion segments): the coarsest option near the cheapest one that serves every set.

    One row for each band comes to the driver; there are at most 22 bands of sets below 2**64.
    """
    aggs = []
    for i in range(len(LOADS)):
        aggs += [F.max(f"miss{i}").alias(f"d{i}"), F.min(f"miss{i}").alias(f"ok{i}"), F.sum(f"units{i}").alias(f"keys{i}")]
    plans = {}
    for r in nodes.filter("n_shingles > 0").groupBy("band").agg(F.count(F.lit(1)).alias("n"), *aggs).collect():
        cost = {i: r[f"keys{i}"] + r["n"] * r[f"d{i}"] * load for i, load in enumerate(LOADS) if r[f"ok{i}"] >= 0}
        option = next(i for i, c in sorted(cost.items()) if c <= COARSER * min(cost.values()))
        plans[r["band"]] = (option, r[f"d{option}"])
    return plans


def keys_of(hashes: np.ndarray, off: np.ndarray, bands: np.ndarray, plans: dict[int, tuple[int, int]], num: int, den: int) -> tuple[np.ndarray, ...]:
    """(keys, rows, levels) that sets index in the given bands; level 1: one-deletion keys."""
    count = np.diff(off)
    row = np.repeat(np.arange(len(count)), count)
    loads = [LOADS[plans[b][0]] for b in bands.tolist()]
    own = np.array([x == 0 for x in loads], dtype=bool)
    m = np.array([segments_of(b, x) if x else 1 for b, x in zip(bands.tolist(), loads, strict=True)], dtype=np.int64)
    seg, _ = _segments(hashes, row, m)
    # A token that is its own segment is numbered by its place, and told apart by its hash.
    seg = np.where(own[row], np.arange(len(hashes)) - off[:-1][row], seg)
    if not len(seg):
        return hashes, row, row
    new = np.r_[True, (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])]
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    start = np.r_[0, np.cumsum(np.bincount(row[first], minlength=len(count)))][:-1]
    inside = np.arange(len(first)) - start[row[first]] < target_of(count, num, den)[row[first]]
    h = mix(hashes)
    sums = np.add.reduceat(h, first)
    label = np.where(own[row[first]], hashes[first], seg[first].astype(np.uint64))
    tag = mix(label + mix(bands.astype(np.uint64))[row[first]])
    full = mix(sums ^ tag)[inside]
    many = np.diff(np.r_[first, len(seg)])
    deletions = np.array([plans[b][1] for b in bands.tolist()], dtype=np.int64)[row]
    cut = inside[number] & (many[number] >= 2) & (seg < deletions) & ~own[row]
    rest = mix((sums[number] - h)[cut] ^ tag[number][cut])
    return np.r_[full, rest], np.r_[row[first][inside], row[cut]], np.repeat(np.array([0, 1]), [len(full), len(rest)])


def _owned(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(nodes, hashes, offsets, texts) of rows (node, text, digest, check) whose text has that identity.

    Rows that share a doc_id may bring other texts; only a node's own set is right.
    """
    for part, hashes, off in _sets(batches, size):
        wanted = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
        own = np.array([v[0] is not None and v == w for v, w in zip(_node_ids(hashes, off), wanted, strict=True)], dtype=bool)
        count = np.diff(off)
        nodes = part.column(0).to_numpy(zero_copy_only=False)[own]
        yield nodes, hashes[np.repeat(own, count)], np.r_[0, np.cumsum(count[own])], part.column(1).filter(pa.array(own))


def _key_rows(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int, plans: dict[int, tuple[int, int]], hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Keys of rows (node, text, digest, check); hot: sorted keys whose rows are marked and dealt out by node."""
    for node, hashes, off, _ in _owned(batches, size):
        count = np.diff(off)
        home = np.array([band_of(n) for n in count.tolist()], dtype=np.int64)
        low = np.array([band_low(b) for b in home.tolist()], dtype=np.int64)
        for below in (False, True):
            rows = np.ones(len(count), dtype=bool)
            if below:
                rows = (home > 0) & (count * num <= (low - 1) * den) & np.isin(home - 1, list(plans))
            if not rows.any():
                continue
            mine = np.repeat(rows, count)
            key, row, level = keys_of(hashes[mine], np.r_[0, np.cumsum(count[rows])], home[rows] - below, plans, num, den)
            info = np.zeros_like(level) if below else 1 + level
            key = key.view(np.int64)
            if hot is not None and len(hot):
                many = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                info = np.where(many, info + 4 * (1 + node[rows][row] % SALTS), info)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, node[rows][row], info.astype(np.int32))], names=["key", "node", "info"])


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, info) in order, each once, those whose key another node has; marked ones always, unmarked."""
    key, node, info = (np.zeros(0, np.int64) for _ in range(3))
    before = np.zeros(0, dtype=bool)  # the row held back shares its key with one already gone
    for batch in batches:
        key, node, info = (np.r_[have, c.to_numpy(zero_copy_only=False)] for have, c in zip((key, node, info), batch.columns, strict=True))
        same = key[1:] == key[:-1]
        once = np.r_[np.ones(min(len(key), 1), dtype=bool), ~(same & (node[1:] == node[:-1]))]
        before = np.r_[before, np.zeros(len(key) - len(before), dtype=bool)][once]
        key, node, info = key[once], node[once], info[once]
        same = key[1:] == key[:-1]
        before[1:] |= same
        shared = before.copy()
        shared[:-1] |= same
        out = (shared | (info >= 4))[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][out]), pa.array(node[:-1][out]), pa.array((info[:-1][out] & 3).astype(np.int32))], names=["key", "node", "info"])
        key, node, info, before = key[-1:], node[-1:], info[-1:], before[-1:]
    if len(key) and (before[0] or info[0] >= 4):
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array((info & 3).astype(np.int32))], names=["key", "node", "info"])


def _token_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Every token of rows (node, text, digest, check) as a key."""
    for node, hashes, off, _ in _owned(batches, size):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (hashes.view(np.int64), np.repeat(node, np.diff(off)), np.zeros(len(hashes), np.int32))], names=["key", "node", "info"])


def _text_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for node, _, _, texts in _owned(batches, size):
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), texts], names=["node", "text"])


def _with_identity(batches: Iterator[pa.RecordBatch], text_at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows with the 128 bits of their sets added."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo in range(0, batch.num_rows, 300):
                part = batch.slice(lo, 300)
                hashes, off = shingle_sets(*word_hashes(part.column(text_at), lower=True), size)
                digest, check = zip(*_node_ids(hashes, off), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digest, pa.int64()), pa.array(check, pa.int64())], names=[*part.schema.names, "_digest", "_check"])


def shingles(text: str, size: int) -> set[tuple[bytes, ...]]:
    words = lower_words(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _linked(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text of a, text of b) -> those whose sets of shingles, word by word, reach the threshold."""
    last, y = None, set()
    for batch in batches:
        keep = []
        for i, (b, s, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
            x = shingles(s, size)
            if b != last:
                last, y = b, shingles(t, size)
            shared = len(x & y)
            if shared and den * shared >= num * (len(x) + len(y) - shared):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])


def _within(num: int, den: int) -> Column:
    """For columns n, s0.. of one set and n_b, t0.. of another: what every pair at the threshold fulfils."""
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    fit = (F.col("n") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n") * num)
    return fit & (differ * (num + den) <= (F.col("n") + F.col("n_b")) * (den - num))


class JaccardJoin:
    """Self-join of documents (doc_id, text) on shingle sets with Jaccard >= num/den.

    Null, empty and wordless texts have the empty set and link with nothing.  Rows with the same
    doc_id are separate documents of that id; rows without doc_id are left out.  Other columns are
    ignored.  An empty table gives an empty result.  Very long texts are hashed in blocks.
    """

    def __init__(self, size: int = 5, num: int = 75, den: int = 100):
        g = math.gcd(num, den)
        self.size, self.num, self.den = size, num // g, den // g

    def verified(self, pairs: DataFrame, docs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
        """The rows (a, b) of pairs whose sets reach the threshold."""
        texts = self.texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, reps, name)
        size, num, den = self.size, self.num, self.den
        texts = materialize(texts.mapInArrow(lambda it: _text_rows(it, size), "node long, text string").dropDuplicates(["node"]), f"{name}-texts")
        full = (
            pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
            .select("a", "b", "x", "y")
        )
        return materialize(full.mapInArrow(lambda it: _linked(it, size, num, den), "a long, b long"), f"{name}-links")

    @staticmethod
    def beside(rows: DataFrame, by_node: DataFrame) -> DataFrame:
        """rows joined to a table by node: broadcast up to BROADCAST_IDS rows, shuffled beyond."""
        return rows.join(F.broadcast(by_node) if by_node.count() <= BROADCAST_IDS else by_node, "node")

    @staticmethod
    def texts_of(wanted: DataFrame | None, docs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
        """(node, text, digest, check) of the wanted nodes, or of all."""
        ids = (reps if wanted is None else reps.join(wanted, "node", "left_semi")).select("node", "rep", "digest", "check")
        if wanted is not None:
            ids = materialize(ids, f"{name}-ids")
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return docs.join(side, docs["doc_id"] == side["rep"]).select("node", "text", "digest", "check")

    def shared_keys(self, docs: DataFrame, reps: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
        """Keys (key, node, info) that two nodes or more have."""
        size, num, den = self.size, self.num, self.den
        total = reps.count()
        share = min(1.0, HOT_SAMPLE / max(total, 1))
        some = reps.filter(F.xxhash64("node", F.lit(3)).bitwiseAND(F.lit((1 << 40) - 1)) <= int(share * (1 << 40)))
        seen = self.texts_of(some.select("node"), docs, reps, "ngram-sample").mapInArrow(lambda it: _key_rows(it, size, num, den, plans, None), _KEYS)
        # So few keys can be in a hundredth of the sampled nodes each: HOT_KEYS at most come to the driver.
        least = max(20, int(HOT_SHARE * share * total))
        found = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()
        hot = np.sort(np.array([r["key"] for r in found], dtype=np.int64))
        keys = self.texts_of(None, docs, reps, "ngram-all").mapInArrow(lambda it: _key_rows(it, size, num, den, plans, hot), _KEYS)
        # Rows of a key lie side by side in a sorted task and stream through it; none is gathered.
        placed = F.when(F.col("info") >= 4, F.xxhash64("key", "info")).otherwise(F.col("key"))
        lined = keys.repartition(placed).sortWithinPartitions("key", "node")
        return materialize(lined.mapInArrow(_shared_rows, _KEYS), "ngram-keys")

    def pruned(self, shared: DataFrame, reps: DataFrame) -> DataFrame:
        """Shared keys of the nodes that have enough of them for any partner."""
        num, den = self.num, self.den
        have = shared.groupBy("node").agg(F.count_if(F.col("info") == 1).alias("have"), F.count_if(F.col("info") == 0).alias("lower"), F.count_if(F.col("info") == 2).alias("cut"))
        facts = self.beside(have, reps.select("node", "n", "units"))
        n, units = F.col("n"), F.col("units")
        smaller = units - F.floor(n * (den - num) / F.lit(num))
        # A smaller partner has at least t * n tokens, and is allowed less.
        larger = F.least(F.ceil(F.lit(SPREAD) * F.ceil(n * num / F.lit(den))) - F.floor(n * (den - num) / F.lit(den)), units - F.floor(2 * n * (den - num) / F.lit(num + den)))
        enough = F.col("have") >= F.greatest(F.least(smaller, larger), F.lit(1))
        alive = facts.filter(enough | (F.col("lower") > 0) | ((F.least(smaller, larger) < 1) & (F.col("cut") > 0)))
        return materialize(self.beside(shared, materialize(alive.select("node"), "ngram-alive")), "ngram-pruned")

    def hub_pairs(self, rows: DataFrame, nodes: DataFrame, tried: DataFrame | None) -> DataFrame:
        """(a, b): each node and the most central node of other components that it shares most keys with.

        rows: (key, node); nodes: (node, n, component, central, sketch).
        """
        tagged = self.beside(rows, nodes.select("node", "component", "central"))
        # Grouped, with partial results before the shuffle, and joined back: no key lands in one task.
        hubs = tagged.groupBy("key").agg(F.max(F.struct("central", "node", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("top"))
        hubs = hubs.filter("low <> top").select("key", F.col("hub.node").alias("b"), F.col("hub.component").alias("hub_component"))
        pairs = tagged.join(hubs, "key").filter("component <> hub_component").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("common"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        left = nodes.select(F.col("node").alias("a"), "n", *_SKETCHES)
        right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), *[F.col(s).alias(f"t{i}") for i, s in enumerate(_SKETCHES)])
        near = pairs.join(left, "a").join(right, "b").filter(_within(self.num, self.den))
        return near.groupBy("a").agg(F.max_by("b", F.struct("common", "b")).alias("b"))

    def near_nodes(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """Nodes that may have a partner in another component.  rows: (key, node, info); nodes as for hub_pairs, with units."""
        num, den = self.num, self.den
        tagged = self.beside(rows, nodes.select("node", "component"))
        cost = tagged.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("top"), F.count(F.lit(1)).alias("cost"))
        others = materialize(rows.join(cost.filter("low <> top").select("key", "cost"), "key"), "ngram-others")
        home = others.filter("info = 1")
        paid = home.groupBy("node").agg(F.count(F.lit(1)).alias("paid"))
        need = F.floor(F.col("n") * (den - num) / F.lit(num)) + 1 - (F.col("units") - F.col("paid"))
        short = F.col("units") < F.floor(F.col("n") * (den - num) / F.lit(num)) + 1
        needs = self.beside(paid, nodes).select("node", need.alias("need"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("cost", "key"))
        chosen = home.withColumn("rank", rank).join(needs, "node").filter("rank <= need").select("key", "node")
        # Sets that fall into too few segments probe all that they have, deletions too.
        chosen = chosen.unionByName(self.beside(others.filter("info > 0"), nodes.filter(short).select("node")).select("key", "node")).distinct()
        chosen = materialize(chosen, "ngram-chosen")
        probed = self.beside(chosen, nodes.select("node", "component")).groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("top"))
        held = self.beside(others.select("key", "node"), nodes.select("node", "component")).join(probed, "key").filter("component <> low or component <> top")
        return materialize(chosen.select("node").unionByName(held.select("node")).distinct(), "ngram-near")

    def leading(self, near: DataFrame, docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
        """(key, node, left): tokens of near nodes at which a pair may first meet; left: how many a set has from there on."""
        num, den, size = self.num, self.den, self.size
        tokens = self.texts_of(near, docs, reps, "ngram-near-texts").mapInArrow(lambda it: _token_rows(it, size), _KEYS)
        lined = tokens.repartition("key").sortWithinPartitions("key", "node")
        tokens = materialize(lined.mapInArrow(_shared_rows, _KEYS).select("key", "node"), "ngram-tokens")
        tagged = self.beside(tokens, nodes.select("node", "component"))
        cost = tagged.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("top"), F.count(F.lit(1)).alias("cost"))
        paid = tokens.join(cost.filter("low <> top").select("key", "cost"), "key")
        # Tokens that no other component has come first.  Components that merge later leave this order as good.
        turn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cost"), F.desc("key")))
        left = self.beside(paid.withColumn("left", turn), nodes.select("node", "n")).filter(F.col("left") * den >= F.col("n") * num)
        return materialize(left.select("key", "node", "left"), "ngram-left")

    def meeting(self, left: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components to verify, by the first token that they share; pairs may repeat."""
        num, den = self.num, self.den
        known = nodes.select("node", "n", "component", *_SKETCHES)
        smaller = self.beside(left, known).filter(F.col("left") * (num + den) >= 2 * F.col("n") * num)
        larger = self.beside(left, known).select(F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("left").alias("left_b"), F.col("n").alias("n_b"), F.col("component").alias("component_b"), *[F.col(s).alias(f"t{i}") for i, s in enumerate(_SKETCHES)])
        reach = F.least("left", "left_b") * (num + den) >= (F.col("n") + F.col("n_b")) * num
        order = (F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("node") < F.col("b")))
        near_by = (F.col("component") != F.col("component_b")) & order & reach & _within(num, den)
        pairs = smaller.join(larger, (F.col("key") == F.col("key_b")) & near_by)
        return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))

    def _fitted(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes: a row for each document, with its identity (digest, check); (digest, check, component_id, head) of each set).

        component_id is the least doc_id reachable by links, head whether the set is the one that names its class.
        """
        size, num, den = self.size, self.num, self.den
        small_batches(docs.sparkSession)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        nodes = materialize(docs.mapInArrow(lambda it: _node_rows(it, size, num, den), _NODES), "ngram-nodes")
        plans = choose_plans(nodes)
        # A node is named by its least doc_id; should another set share that, by its digest.
        chosen = F.coalesce(*[F.when(F.col("band") == b, F.col(f"units{option}")) for b, (option, _) in plans.items()], F.lit(0).cast("long"))
        facts = [F.first(c).alias(c) for c in ("units", *_SKETCHES)]
        identity = ["digest", "check", F.col("n_shingles").alias("n")]
        reps = nodes.filter("n_shingles > 0 and doc_id is not null").withColumn("units", chosen).groupBy(*identity).agg(F.min("doc_id").alias("rep"), *facts)
        turn = F.row_number().over(Window.partitionBy("rep").orderBy("digest"))
        reps = materialize(reps.withColumn("turn", turn).withColumn("node", F.when(F.col("turn") == 1, F.col("rep")).otherwise(F.col("digest"))).drop("turn"), "ngram-reps")
        rows = self.pruned(self.shared_keys(docs, reps, plans), reps)
        # How common a node's keys are: the text that others of a group were made from ranks first.
        holders = rows.groupBy("key").agg(F.count(F.lit(1)).alias("holders"))
        central = rows.join(holders, "key").groupBy("node").agg(F.avg("holders").alias("central"))
        known = materialize(reps.select("node", "n", "units", *_SKETCHES).join(central, "node").withColumn("component", F.col("node")), "ngram-central")
        # A quarter of the keys is enough to find hubs; what they miss is found below.
        some = rows.filter("info < 2").filter(F.col("key").bitwiseAND(3) == 0).select("key", "node")
        links = tried = None

        def merged(keys: DataFrame, name: str) -> bool:
            """Compare each node with a hub by the keys; whether that linked any."""
            nonlocal links, tried, known
            best = materialize(self.hub_pairs(keys, known, tried), name)
            if best.isEmpty():
                return False
            found = self.verified(best, docs, reps, name)
            tried = best if tried is None else tried.unionByName(best)
            if found.isEmpty():
                return False
            links = found if links is None else links.unionByName(found)
            joined = connected_components(links, name)
            known = known.drop("component").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
            known = materialize(known, f"{name}-component")
            return True

        # The last of the rounds is over leading tokens: it finds what is linked to no central node.
        for step in range(HUB_ROUNDS - 1):
            if not merged(some, f"ngram-hub{step}"):
                break
        left = self.leading(self.near_nodes(rows, known), docs, reps, known)
        if HUB_ROUNDS:
            merged(left.select("key", "node"), "ngram-hub-leading")
        pairs = materialize(self.meeting(left, known).distinct(), "ngram-pairs")
        if not pairs.isEmpty():
            more = self.verified(pairs, docs, reps, "ngram-rest")
            links = more if links is None else links.unionByName(more)
        ids = reps.select("node", "rep", "digest", "check")
        joined = None if links is None else connected_components(links, "ngram-all")
        rep_of = ids.withColumn("component", F.col("node")) if joined is None else ids.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = rep_of.groupBy("component").agg(F.min(F.struct("rep", "digest", "check")).alias("first"))
        head = (F.col("digest") == F.col("first.digest")) & (F.col("check") == F.col("first.check"))
        return nodes, rep_of.join(first, "component").select("digest", "check", F.col("first.rep").alias("component_id"), head.alias("head"))

    def classes(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id): component_id is the least doc_id reachable by links."""
        nodes, rep_of = self._fitted(docs)
        return (
            nodes.select("doc_id", "n_shingles", *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("digest", "check")])
            .join(rep_of, ["digest", "check"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        )

    def keep(self, docs: DataFrame) -> DataFrame:
        """One row of docs for each class, with all columns: of the document that names it; of equal rows one.

        Rows, not ids, are removed: texts that share a doc_id are judged each for itself.  Rows without doc_id
        and texts without words stay.
        """
        size = self.size
        nodes, rep_of = self._fitted(docs)
        texts = nodes.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "digest", "check").agg(F.count(F.lit(1)).alias("rows"))
        stays = F.col("head") & (F.col("doc_id") == F.col("component_id"))
        marks = texts.join(rep_of, ["digest", "check"]).withColumn("stays", stays).filter("not stays or rows > 1")
        marks = materialize(marks.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("check").alias("_check"), F.col("stays").alias("_stays")), "ngram-marks")
        ids = materialize(marks.select("_id").distinct(), "ngram-marked-ids")
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        rows = positional(docs)
        doc_id = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
        schema = T.StructType([*rows.schema, T.StructField("_digest", T.LongType()), T.StructField("_check", T.LongType())])
        text_at = docs.columns.index("text")
        # Only rows whose id is marked are hashed again, to tell which of its texts they hold.
        hashed = rows.join(side, doc_id == F.col("_id"), "left_semi").mapInArrow(lambda it: _with_identity(it, text_at, size), schema)
        marked = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
        both = (doc_id == F.col("_id")) & hashed["_digest"].eqNullSafe(marked["_digest"]) & hashed["_check"].eqNullSafe(marked["_check"])
        judged = hashed.join(marked, both, "left").drop(marked["_digest"], marked["_check"])
        kept = judged.filter("_stays is null").select(*rows.columns)
        # Equal rows of a text that stays: the least of them, so that a rerun keeps the same.
        equal = judged.filter("_stays").groupBy("_id", "_digest", "_check").agg(F.min(F.struct(*rows.columns)).alias("_row")).select("_row.*")
        return rows.join(side, doc_id == F.col("_id"), "left_anti").unionByName(kept).unionByName(equal).toDF(*docs.columns)
