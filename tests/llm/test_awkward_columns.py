"""Shared and absent ids, and columns whose names operators use themselves."""

import random

import pytest
from conftest_llm import frame
from pyspark.sql import functions as F

from tidewatch.llm import pii
from tidewatch.llm.line_dedup import LineDedup
from tidewatch.llm.mixing import Mixture
from tidewatch.llm.ngram_join import JaccardJoin
from tidewatch.llm.quality_model import QualityModel

NAMES = "target cut rest epochs fits ties source_size size copies lines key n_dropped c0 _lines _digest _check _size _at _id _row".split()


def crowded(docs):
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.lit(k))
    return docs


def test_lines_of_rows_that_share_an_id(spark):
    rows = [
        (1, "same line here now\nrepeated words again here"),
        (2, "first of two rows\nrepeated words again here"),
        (2, "unique alpha beta gamma\nONLY COPY OF THIS LINE"),
        (2, None),
    ]
    docs = frame(spark, rows)
    d = LineDedup(docs)
    got = sorted((r.doc_id, r.text or "") for r in d.apply(docs).collect())
    assert got == [(1, rows[0][1]), (2, ""), (2, "first of two rows"), (2, rows[2][1])]
    assert sorted((r.doc_id, r.n_dropped) for r in d.report(docs).collect()) == [(1, 0), (2, 0), (2, 0), (2, 1)]


@pytest.mark.parametrize("stage", ["quality_classifier", "line_dedup", "ngram_jaccard_join", "source_mixing"])
def test_stages_take_any_column_name(spark, corpus, stage):
    import corpus_pipeline

    docs = frame(spark, [(i, t) for i, t in corpus if i < 1000 or i >= 2000])
    run = dict(corpus_pipeline.STAGES)[stage]
    plain = run(spark, docs, "")
    wide = run(spark, crowded(docs), "")
    assert wide.columns == [*docs.columns, *NAMES]
    order = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.select("doc_id", "text").collect())
    assert order(wide) == order(plain)


def test_mixture_counts_beside_clashing_columns(spark, corpus):
    docs = crowded(frame(spark, corpus))
    counts = Mixture(docs).counts(docs)
    assert counts.filter("copies is null or size <> regexp_count(coalesce(text, ''), '[^\\\\x20\\\\x09-\\\\x0D]+')").count() == 0
    assert counts.columns.count("size") == 1 and JaccardJoin().keep(docs).columns == docs.columns


def test_quality_model_without_or_with_repeated_ids(spark, words):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 90)))
    junk = lambda: " ".join("#$%" + rng.choice(words[:9]) + "!!" for _ in range(60))
    texts = [junk() if k % 6 == 0 else prose() for k in range(600)]
    rejected = []
    for ids in (range(600), [None] * 600, [7] * 600):
        docs = frame(spark, list(zip(ids, texts, strict=True)))
        rejected.append(QualityModel(docs).score(docs).filter("not kept").count())
    assert all(80 <= n <= 120 for n in rejected)
    assert QualityModel(docs, train=50).score(docs).filter("not kept").count() > 60


def test_long_words_next_to_values_are_counted_whole(spark):
    """A word of 60 letters stands before 8 addresses and before 401 other things: it marks nothing, long or short."""
    for word in ("shortword", "w" * 60):
        rows = [(k, f"{word} user{k}@host{k}.org and more") for k in range(8)] + [(100 + k, f"{word} thing{k} here") for k in range(400)] + [(900, f"{word} price(at)shop today")]
        found = pii.find(frame(spark, rows)).collect()
        assert not any("ctx_" in r.spans for r in found)
        telling = [(k, f"{word} user{k}@host{k}.org and more") for k in range(30)] + [(900, f"{word} price(at)shop today")]
        assert any("ctx_email" in r.spans for r in pii.find(frame(spark, telling)).collect())


def test_broken_promises_are_found_out(spark, monkeypatch):
    from tidewatch.llm import chat

    class BrokenPromise:
        """Says that it looks back on nothing, and rewrites its first line once there are more than 16 turns."""

        look_back = 0

        def __call__(self, turns):
            return ("" if not turns else f"{'many' if len(turns) > 16 else 'few'}\n") + "".join(f"{r}:{t}\n" for r, t in turns)

    class Counting:
        """Declares no look_back, and numbers its turns."""

        def __call__(self, turns):
            return "".join(f"{k}:{r}:{t}\n" for k, (r, t) in enumerate(turns))

    turns = lambda n: [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(n)]
    table = lambda n: spark.createDataFrame(turns(n), "conv_id long, turn long, role string, text string")
    got = chat.format_turns(table(40), BrokenPromise()).orderBy("turn_no").collect()
    assert [r.turn_no for r in got if r.history_kept is False] == [16]
    kept = chat.format_turns(table(40), Counting()).orderBy("turn_no").collect()
    assert all(r.history_kept for r in kept) and "".join(r.piece for r in kept) == Counting()([(t[2], t[3]) for t in turns(40)])
    assert all(r.history_kept for r in chat.format_turns(table(40)).collect())
    monkeypatch.setattr(chat, "VERIFY", 20)
    pairs = list(chat.checked_spans(iter([(t[2], t[3]) for t in turns(40)]), chat.MarkedTurns()))
    assert [k for _, _, k in pairs] == [None] * 40 and "".join(p for _, p, _ in pairs) == chat.MarkedTurns()([(t[2], t[3]) for t in turns(40)])


def test_history_is_judged_alike_at_any_length(spark, monkeypatch):
    """Neither a long conversation nor long texts change what is said of a template, or what it appends."""
    from tidewatch.llm import chat

    class BrokenPromise:
        look_back = 0

        def __call__(self, turns):
            return ("" if not turns else f"{'many' if len(turns) > 16 else 'few'}\n") + "".join(f"{t}\n" for _, t in turns)

    class Restores(chat.MarkedTurns):
        """Rewrites history from the 20th turn on, and puts it back at the 30th."""

        def __call__(self, turns):
            return ("!" if 20 <= len(turns) < 30 else "") + super().__call__(turns)

    rows = lambda n, text="t": [(1, k, "user" if k % 2 == 0 else "assistant", f"{text}{k}") for k in range(n)]
    table = lambda *a: spark.createDataFrame(rows(*a), "conv_id long, turn long, role string, text string")
    lost = lambda df: [r.turn_no for r in df.orderBy("turn_no").collect() if r.history_kept is not True]
    for n in (40, 4200):
        assert lost(chat.format_turns(table(n), BrokenPromise())) == [16]
        digest = chat.read_back(chat.format_turns(table(n))).first()
        assert (digest.n_turns, digest.history_kept) == (n, True)
        assert digest.formatted_chars == len(chat.MarkedTurns()([t[2:] for t in rows(n)]))
    assert lost(chat.format_turns(table(40), Restores())) == [19, 29]
    assert lost(chat.format_turns(table(40, "long" * 60_000))) == []


def test_templates_made_by_turn_stream_in_a_window():
    from tidewatch.llm import chat

    class Echoes(chat.ByTurn):
        look_back, most = 3, 0

        def piece(self, turn, before):
            return f"{turn[1]}<{before[0][1] if len(before) == 3 else ''}>"

        def __call__(self, turns):
            self.most = max(self.most, len(turns))
            return super().__call__(turns)

    turns = [("user", f"t{i}") for i in range(60)]
    watched = Echoes()
    plain = type("Plain", (chat.ByTurn,), {"look_back": 3, "piece": Echoes.piece})()
    assert chat.made_by_turn(plain) and chat.made_by_turn(chat.MarkedTurns()) and not chat.made_by_turn(watched)
    assert "".join(p for _, p, _ in chat.spans(iter(turns), watched, window=2)) == plain(turns) and watched.most == 4
