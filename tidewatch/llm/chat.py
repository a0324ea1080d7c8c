"""Chat formatting by incremental rendering of turn prefixes.

A template is a black box: turns in, text out.  ``spans`` renders successive prefixes and compares
consecutive outputs; what the longer one appends is the turn's span.  If the longer output does not
begin with the shorter one, the template rewrites history and is reported.

Conversations are spread by id, and turns stream in order through a task.  Prefixes are whole: a task
holds the turns of one conversation, and rendering costs the square of its length.  Only a template made
turn by turn (``ByTurn``) has prefixes within a window of ``window`` turns (``look_back`` + 1 at least): a full
window starts anew with its last ``look_back`` turns, so a conversation of any length streams through, and the
result is that of whole prefixes, since the class itself puts the output together from what each turn appends.
What a template of any other class says of its ``look_back`` is a promise that nothing short of whole prefixes
can check, and ``format_turns`` does not rely on it.  No result depends on how long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
WINDOW = 16
#: Turns, and characters of text, that ``checked_spans`` holds at once.
VERIFY, VERIFY_CHARS = 4096, 8_000_000


class ByTurn:
    """A template that appends for each turn what ``piece`` makes of it and of the ``look_back`` turns before it, or fewer at the start.

    ``piece`` must be a function of its arguments.  A subclass that renders in another way is a template like any other.
    """

    look_back = 0

    def piece(self, turn: Turn, before: list[Turn]) -> str:
        raise NotImplementedError

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(self.piece(turn, turns[max(0, i - self.look_back) : i]) for i, turn in enumerate(turns))


class MarkedTurns(ByTurn):
    """``### role: text</turn>`` and a newline for each turn, control strings in texts escaped by a backslash."""

    OPEN, CLOSE = "### ", "</turn>\n"
    _PIECE = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)

    @staticmethod
    def escape(text: str) -> str:
        return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def piece(self, turn: Turn, before: list[Turn]) -> str:
        role, text = turn
        return f"{self.OPEN}{self.escape(role).replace(':', chr(92) + ':')}: {self.escape(text)}{self.CLOSE}"

    def parse(self, output: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start, end) of each turn of an output; start and end enclose the escaped text."""
        found, at = [], 0
        while at < len(output):
            m = self._PIECE.match(output, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            found.append((self.unescape(m[1]), self.unescape(m[2]), m.start(2), m.end(2)))
            at = m.end()
        return found


def spans(turns: Iterator[Turn], render: Callable[[list[Turn]], str], window: int = WINDOW, whole: bool = False) -> Iterator[tuple[Turn, str, bool]]:
    """(turn, appended text, history kept) for each turn, by rendering successive prefixes.

    Where history is rewritten, the appended text is what follows the common prefix.  window counts
    only for templates that declare their look_back, and not with whole.
    """
    prefix: list[Turn] = []
    back = None if whole else getattr(render, "look_back", None)
    if back is not None:
        window = max(window, back + 1)
    before = render([])
    yield_first = before
    for turn in turns:
        if back is not None and len(prefix) >= window:
            prefix = prefix[len(prefix) - back :]
            before = render(prefix)
        prefix.append(turn)
        after = render(prefix)
        kept = after.startswith(before)
        common = len(before)
        if not kept:
            common = next((i for i, (x, y) in enumerate(zip(before, after, strict=False)) if x != y), min(len(before), len(after)))
        yield turn, (yield_first + after[common:] if yield_first else after[common:]), kept
        yield_first = ""
        before = after


def checked_spans(turns: Iterator[Turn], render: Callable[[list[Turn]], str], window: int = WINDOW) -> Iterator[tuple[Turn, str, bool | None]]:
    """``spans``, with a template's promise to look back a few turns only checked against the whole conversation.

    For callers of their own that must not hold a long conversation: beyond VERIFY, kept is unknown (null), and pieces
    are as right as the promise.  ``format_turns`` does without it.
    """
    if getattr(render, "look_back", None) is None:
        yield from spans(turns, render, window)
        return
    head, chars = [], 0
    for turn in turns:
        head.append(turn)
        chars += len(turn[1])
        if len(head) > VERIFY or chars > VERIFY_CHARS:
            for turn, piece, kept in spans(chain(head, turns), render, window):
                yield turn, piece, None if kept else False
            return
    if len(head) <= window:
        yield from spans(iter(head), render, window)  # these prefixes are whole
        return
    found = list(spans(iter(head), render, window))
    yield from found if "".join(p for _, p, _ in found) == render(head) else spans(iter(head), render, whole=True)


def made_by_turn(render: Callable[[list[Turn]], str]) -> bool:
    """Whether a template's output is put together by ``ByTurn`` itself."""
    return isinstance(render, ByTurn) and type(render).__call__ is ByTurn.__call__


def _whose() -> Callable[[tuple], tuple[int | None, int]]:
    """Key of the conversation that a row belongs to; rows without conv_id are conversations of their own."""
    alone = count()
    return lambda row: (row[0], 0 if row[0] is not None else 1 + next(alone))


_TURNS = "conv_id long, turn_no long, role string, text string, piece string, start long, end long, history_kept boolean"


def _pieces(batches: Iterator[pa.RecordBatch], render: Callable[[list[Turn]], str], window: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int | None, str, str]]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

    names = [f.split()[0] for f in _TURNS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    out: list[tuple] = []
    held, whole = 0, not made_by_turn(render)
    for (conv, _), group in groupby(rows(), key=_whose()):
        at = 0
        for k, ((role, text), piece, kept) in enumerate(spans(((r, t) for _, r, t in group), render, window, whole)):
            out.append((conv, k, role, text, piece, at, at + len(piece), kept))
            at += len(piece)
            held += len(piece)
            if len(out) >= 2000 or held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def format_turns(conversations: DataFrame, render: Callable[[list[Turn]], str] | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each turn: its rendered piece, its place in the conversation's output, whether history was kept.

    Input (conv_id, turn, role, text); other columns are ignored.  Null role or text is empty; turns
    order by turn (null first), then role and text; repeated rows stay; a row without conv_id is a
    conversation of its own; an empty table gives an empty result.  Rows of a conversation come out
    together and in order, and stream through one task: a conversation is a sequence.
    """
    render = render or MarkedTurns()
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("role", "text", "turn"))
    placed = rows.repartition(F.col("conv_id"), lone).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return placed.mapInArrow(lambda it: _pieces(it, render, window), _TURNS)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, history_kept boolean"


def _digests(batches: Iterator[pa.RecordBatch], template: MarkedTurns, loss_role: str) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in (0, 4, 7)), strict=True)

    out = []
    for (conv, _), group in groupby(rows(), key=_whose()):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        whole: bool | None = True
        for _, piece, kept in group:
            for role, text, start, end in template.parse(piece):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
                if role == loss_role:
                    masked = template.unescape(piece[start:end])
                    loss.update(masked.encode())
                    loss_chars += len(masked)
            chars += len(piece)
            whole = False if kept is False or whole is False else None if kept is None or whole is None else True
        out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, whole))
        if len(out) >= 2000:
            yield _digest_batch(out)
            out = []
    if out:
        yield _digest_batch(out)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _DIGESTS.split(", ")])


def read_back(pieces: DataFrame, template: MarkedTurns | None = None, loss_role: str = "assistant") -> DataFrame:
    """Digests of each conversation, read back from ``format_turns`` output by parsing and unescaping it.

    Runs in the tasks that made the pieces (their rows are together and in order): no second shuffle.
    """
    template = template or MarkedTurns()
    return pieces.mapInArrow(lambda it: _digests(it, template, loss_role), _DIGESTS)
