"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a model file (its path is a parameter; the file is read by the driver only and
reaches the tasks as a broadcast of a few MB, bounded by the vocabulary).  A unigram model's log scores
are taken as they are.  A file whose scores are merge ranks has no probabilities: there a piece of rank r
gets the logarithm of Zipf's law, 1 / (r + 1), made to sum to one over all pieces.  Nothing is trained.

Encoding is exact Viterbi.  A text is cut into units that no piece can span (before a space that follows
another character, and around newlines, if the vocabulary allows); each distinct unit of a batch is
encoded once, all of them together.  One vector step for each piece length builds the lattice of every
position; it falls into runs where no piece spans a position; one vector step for each offset in a run
extends all best paths.  Long runs (one letter many times) are walked edge by edge.  Of equal sums the
path found first wins: the one whose last piece begins earlier.

Spaces become the marker U+2581, with one more in front of a text.  A literal U+2581 and characters
without a piece are written as byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_MARK_BYTE = b"\xff"  # stands for the marker inside; never part of UTF-8
#: Bytes of units and their pieces that a worker remembers at most; then it starts afresh.
CACHE = 24_000_000
#: Length of a run in bytes from which its best path is found edge by edge.
LONG_RUN = 512
_UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """Trie over bytes in two integer arrays: child of node p by byte c is base[p] + c if check there is p."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = v
        # Nodes with several children are laid end to end; those with one fill the gaps between.
        base = [0] * len(children)
        place = [0] * len(children)
        used = bytearray(1)
        used[0] = 1
        single = []
        for node, kids in enumerate(children):
            if len(kids) > 1:
                b = len(used) - min(kids)
                base[node] = b = max(b, 1)
                used.extend(bytes(b + max(kids) + 1 - len(used)))
                for c, kid in kids.items():
                    used[b + c] = 1
                    place[kid] = b + c
            elif kids:
                single.append(node)
        free = 256
        for node in single:
            ((c, kid),) = children[node].items()
            while free < len(used) and used[free]:
                free += 1
            if free >= len(used):
                used.extend(bytes(free + 1 - len(used)))
            used[free] = 1
            base[node] = free - c
            place[kid] = free
        size = len(used) + 512
        self.base, self.check, self.leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        at = np.array(place)
        self.base[at] = base
        self.leaf[at] = value
        for node, kids in enumerate(children):
            for kid in kids.values():
                self.check[place[kid]] = place[node]


def are_ranks(scores: list[float]) -> bool:
    """True if scores are merge ranks: whole numbers, none above 0, most of them different."""
    return 2 * len(set(scores)) > len(scores) > 1 and all(x <= 0 and x == int(x) for x in scores)


def zipf(ranks: np.ndarray) -> np.ndarray:
    """Log probabilities in proportion to 1 / (rank + 1)."""
    weight = 1.0 / (ranks + 1.0)
    return np.log(weight / weight.sum())


class Vocabulary:
    """Pieces, log scores and byte pieces of a model, ready for encoding; picklable."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int], unknown: int):
        self.name = uuid.uuid4().hex  # workers tell vocabularies apart by it
        self.unknown = unknown
        self.bytes_of = [b"" for _ in pieces]
        for b, i in byte_ids.items():
            self.bytes_of[i] = bytes([b])
        plain = {}
        for i, p in enumerate(pieces):
            if i not in special and i not in byte_ids.values() and p:
                self.bytes_of[i] = p.encode().replace(MARK.encode(), b" ")
                plain[p.encode().replace(MARK.encode(), _MARK_BYTE)] = i
        self.trie = DoubleArray(plain)
        self.scores = np.array(scores, dtype=np.float64)
        self.longest = max(map(len, plain), default=1)
        self.unknown_score = min((scores[i] for i in plain.values()), default=0.0) - _UNKNOWN_PENALTY
        self.byte_id = np.full(256, unknown, dtype=np.int32)
        for b, i in byte_ids.items():
            self.byte_id[b] = i
        self.byte_id[0xFF] = self.byte_id[0x20]
        self.is_byte = np.zeros(len(pieces), dtype=bool)
        self.is_byte[list(byte_ids.values())] = True
        self.split_spaces = not any(_MARK_BYTE[0] in k.lstrip(_MARK_BYTE) for k in plain)
        self.split_lines = self.split_spaces and not any(b"\n" in k for k in plain)
        self.blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.length = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.start = np.r_[0, np.cumsum(self.length)[:-1]]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a SentencePiece model file."""
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        scores = [m.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if i not in special and i not in byte_ids.values()]
        if are_ranks([scores[i] for i in plain]):
            logs = zipf(np.array([-scores[i] for i in plain]))
            scores = [0.0] * n
            for i, x in zip(plain, logs.tolist(), strict=True):
                scores[i] = x
        return cls(pieces, scores, byte_ids, special, max(0, m.unk_id()))

    def viterbi(self, units: list[bytes]) -> list[bytes]:
        """Best piece ids (little-endian int32) of each unit."""
        text = np.frombuffer(b"".join(units), dtype=np.uint8)
        ends = np.cumsum([len(u) for u in units], dtype=np.int64)
        if not len(text):
            return [b""] * len(units)
        begins = np.r_[0, ends[:-1]]
        solid = (text & 0xC0) != 0x80
        solid[begins[begins < len(text)]] = True
        stop = np.repeat(ends, ends - begins)
        origin = np.repeat(begins, ends - begins)
        chars = np.flatnonzero(solid)
        width = np.diff(np.r_[chars, len(text)])
        base, check, leaf = self.trie.base, self.trie.check, self.trie.leaf
        # Lattice: one vector step for each piece length.
        at, node = chars, np.zeros(len(chars), dtype=np.int64)
        from_, to, ids = [], [], []
        covered = np.zeros(len(text) + 1, dtype=bool)
        wide = np.zeros(len(text) + 1, dtype=np.int64)
        wide[chars] = width
        for k in range(self.longest):
            here = at + k
            inside = here < stop[at]
            at, node, here = at[inside], node[inside], here[inside]
            if not len(at):
                break
            step = base[node] + text[here].astype(np.int64)
            ok = check[step] == node
            at, node = at[ok], step[ok]
            got = leaf[node]
            hit = got >= 0
            from_.append(at[hit])
            to.append(at[hit] + k + 1)
            ids.append(got[hit])
            covered[at[hit][wide[at[hit]] == k + 1]] = True
        bare = chars[~covered[chars]]
        from_.append(bare)
        to.append(bare + wide[bare])
        ids.append(np.full(len(bare), -1, np.int32))
        src, dst, pid = np.concatenate(from_), np.concatenate(to), np.concatenate(ids)
        score = np.where(pid >= 0, self.scores[pid], self.unknown_score)
        # Where no edge passes over a position, every path goes through it: a run ends there.
        over = np.zeros(len(text) + 2, dtype=np.int64)
        np.add.at(over, src + 1, 1)
        np.add.at(over, dst, -1)
        opens = np.cumsum(over)[: len(text)] == 0
        opens[begins[begins < len(text)]] = True
        runs = np.flatnonzero(opens)
        run_of = np.cumsum(opens) - 1
        offset = src - runs[run_of[src]]
        long_edge = np.diff(np.r_[runs, len(text)])[run_of[src]] >= LONG_RUN
        order = np.argsort(np.where(long_edge, src + len(text), offset), kind="stable")
        src, dst, pid, score, offset = src[order], dst[order], pid[order], score[order], offset[order]
        split = len(src) - int(long_edge.sum())
        # A run's end is the next one's begin, so best scores are kept by the last byte reached.
        best = np.full(len(text) + 1, -np.inf)
        back = np.full(len(text) + 1, -1, dtype=np.int64)
        edge = np.flatnonzero(np.r_[True, offset[1:split] != offset[: split - 1], True]) if split else np.zeros(0, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            s, d = src[a:b], dst[a:b] - 1
            so_far = score[a:b] if offset[a] == 0 else best[s - 1] + score[a:b]
            better = so_far > best[d]
            d = d[better]
            best[d] = so_far[better]
            back[d] = np.arange(a, b)[better]
        if split < len(src):
            top: dict[int, tuple[float, int]] = {}
            for e, (s, d, x, k) in enumerate(zip(src[split:].tolist(), dst[split:].tolist(), score[split:].tolist(), offset[split:].tolist(), strict=True), split):
                if k:
                    x += top[s - 1][0] if s - 1 in top else -np.inf
                have = top.get(d - 1)
                if x > -np.inf and (have is None or x > have[0]):
                    top[d - 1] = (x, e)
            at = np.fromiter(top.keys(), np.int64, len(top))
            back[at] = np.fromiter((e for _, e in top.values()), np.int64, len(top))
        picked = np.zeros(len(src), dtype=bool)
        live = np.r_[runs[1:], len(text)] - 1
        while len(live):
            e = back[live]
            picked[e] = True
            s = src[e]
            live = s[offset[e] > 0] - 1
        first, piece, last = src[picked], pid[picked], dst[picked]
        order = np.argsort(first)
        first, piece, last = first[order], piece[order], last[order]
        many = np.where(piece < 0, last - first, 1)
        out = np.repeat(piece, many)
        raw = np.flatnonzero(np.repeat(piece < 0, many))
        within = np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)
        out[raw] = self.byte_id[text[np.repeat(first, many)[raw] + within[raw]]]
        bounds = np.r_[0, np.cumsum(many)][np.searchsorted(first, np.r_[begins, len(text)])]
        flat = out.astype("<i4")
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _tokens(self, text: str) -> list[str]:
        """Units of a text: without a leading mark they get one; after a newline (doubled here) they get none."""
        if not text:
            return []
        if self.split_lines:
            text = text.replace("\n", " \n\n")
            parts = text.split(" ")
            if "" not in parts:
                return parts
            return _merged(parts)
        if self.split_spaces:
            return _merged(text.split(" "))
        return [text]

    def _unit(self, token: str) -> bytes:
        if self.split_lines and token.startswith("\n\n"):
            return token[1:].encode().replace(b" ", _MARK_BYTE)
        return _MARK_BYTE + token.encode().replace(b" ", _MARK_BYTE)

    def encode(self, texts: list[str | None], cache: dict[str, bytes]) -> list[bytes]:
        """Piece ids of each text (little-endian int32); null is empty.  cache holds units already encoded."""
        tokens = [self._tokens(t or "") for t in texts]
        new = list({x for part in tokens for x in part if x not in cache})
        for lo in range(0, len(new), 10_000):
            some = new[lo : lo + 10_000]
            cache.update(zip(some, self.viterbi([self._unit(x) for x in some]), strict=True))
        return [b"".join(map(cache.__getitem__, part)) for part in tokens]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text that ids stand for."""
        if not len(ids):
            return b""
        size = self.length[ids]
        total = int(size.sum())
        shift = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        text = self.blob[shift + np.arange(total)].tobytes()
        return text[1:] if text[:1] == b" " else text


def _merged(parts: list[str]) -> list[str]:
    """Empty parts (runs of spaces) joined to the part behind them, or kept as spaces at the end."""
    out, spaces = [], 0
    for p in parts:
        if p == "":
            spaces += 1
        elif p.startswith("\n\n") and spaces:
            out.append(" " * (spaces - 1))  # the token itself gets the first mark
            out.append(p)
            spaces = 0
        else:
            out.append(" " * spaces + p)
            spaces = 0
    if spaces:
        out.append(" " * (spaces - 1))
    return out


class _Memory:
    """What a worker remembers: units of one vocabulary, within CACHE bytes."""

    vocabulary = ""
    units: dict[str, bytes] = {}
    size = 0

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> dict[str, bytes]:
        if cls.vocabulary != vocabulary.name:
            cls.vocabulary, cls.units, cls.size = vocabulary.name, {}, 0
        return cls.units

    @classmethod
    def trim(cls, before: int) -> None:
        """Count the units added since there were before of them; forget all beyond CACHE."""
        for k, v in islice(cls.units.items(), before, None):
            cls.size += 150 + len(k) + len(v)
        if cls.size > CACHE:
            cls.units.clear()
            cls.size = 0


def _encoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    vocabulary = shared.value
    for batch in batches:
        for lo in range(0, batch.num_rows, 250):
            part = batch.slice(lo, 250)
            cache = _Memory.of(vocabulary)
            known = len(cache)
            ids = vocabulary.encode(part.column(1).to_pylist(), cache)
            _Memory.trim(known)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
            offsets = pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "text", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    vocabulary = shared.value
    for batch in batches:
        for lo in range(0, batch.num_rows, 250):
            part = batch.slice(lo, 250)
            rows = [np.asarray(v.values if v.is_valid else []).astype(np.int64) for v in part.column("ids")]
            texts = [vocabulary.decode(r).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])


_DIGEST = "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def _digested(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    vocabulary = shared.value
    for batch in batches:
        lists = batch.column(2)
        off = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        out = []
        for r, text in enumerate(batch.column(1).to_pylist()):
            ids = flat[off[r] : off[r + 1]]
            back = vocabulary.decode(ids)
            out.append((len(ids), int(vocabulary.is_byte[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == (text or "").encode()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[f.split()[0] for f in _DIGEST.split(", ")])


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text, ids array<int>) of documents; null and empty texts have no ids; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encoded(it, shared), "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids); null ids are empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, shared), "doc_id long, decoded string")


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Counts, digest of the ids and round trip of each document: ``encode`` and its reading back in the same tasks.

    Ids stay in the worker that made them, a few hundred documents at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _digested(_encoded(it, shared), shared), _DIGEST)
