import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import frame
from pyspark.sql import functions as F

from tidewatch.llm import chat, mixing, quality_model, rules, token_counts, unigram

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


# token counts


def totals(ledger):
    return {(r.source, r.version): (r.docs, r.tokens) for r in ledger.totals().collect()}


def test_ledger_batches(spark):
    changes = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, version string, tokens long")
    led = token_counts.TokenLedger(spark)
    assert totals(led) == {}
    assert led.commit(1, changes([(1, "a", "en", "v", 10), (2, "a", "en", "v", 5), (2, "a", "en", "v", 5), (3, None, None, "v", 7)]))
    assert totals(led) == {("a", "v"): (2, 15), (None, "v"): (1, 7)}
    assert not led.commit(1, changes([(9, "a", "en", "v", 99)]))
    led.commit(2, changes([(1, "b", "en", "v", 4), (2, "a", "en", "v", None), (8, "a", "en", "v", None)]))
    assert totals(led) == {("b", "v"): (1, 4), (None, "v"): (1, 7)}
    led.commit(3, changes([]))
    led.commit(4, changes([(2, "a", "en", "v", 6)]))
    assert totals(led) == {("a", "v"): (1, 6), ("b", "v"): (1, 4), (None, "v"): (1, 7)}


def test_late_batches_are_refused_and_nothing_is_hidden(spark):
    changes = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, version string, tokens long")
    led = token_counts.TokenLedger(spark)
    led.commit(5, changes([(1, "a", "en", "v", 10)]))
    with pytest.raises(token_counts.LateBatch):
        led.commit(3, changes([(1, "a", "en", "v", 4)]))
    led.commit(6, changes([(2, "a", "en", "v", 1)]))
    led.commit(7, changes([(1, None, None, "v", None)]))
    assert totals(led) == {("a", "v"): (1, 1)}
    assert [(r.doc_id, r.tokens) for r in led.counts().collect()] == [(2, 1)]


def test_snapshots_change_nothing(spark, monkeypatch):
    changes = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, version string, tokens long")
    rng, want = random.Random(1), {}
    monkeypatch.setattr(token_counts, "SNAPSHOT", 2)
    led = token_counts.TokenLedger(spark)
    for batch in range(5):
        rows = [(i, rng.choice("ab"), "en", "v", rng.choice([None, 1, 2, 3])) for i in rng.sample(range(6), 3)]
        led.commit(batch, changes(rows))
        want |= {r[0]: r for r in rows}
    live = [r for r in want.values() if r[4] is not None]
    docs, tokens = Counter(r[1] for r in live), Counter()
    for r in live:
        tokens[r[1]] += r[4]
    assert totals(led) == {(s, "v"): (docs[s], tokens[s]) for s in docs}


def test_every_row_of_a_corpus_counts(spark):
    rows = frame(spark, [(None, "a b"), (None, "a b"), (None, "c"), (7, "x y z"), (7, "u"), (8, None), (9, "# $"), (9, "#1")]).withColumnRenamed("n_chars", "part")
    got = {r.version: (r.docs, r.tokens) for r in token_counts.corpus_counts(rows).collect()}
    assert got == {"words-1": (5, 9), "parts-2": (5, 9)}


def test_a_failed_attempt_is_replaced(spark):
    changes = spark.createDataFrame([(1, "a", "en", "v", 10)], "doc_id long, source string, lang string, version string, tokens long")
    led = token_counts.TokenLedger(spark)
    changes.write.parquet(f"{led.path}/counts/batch=1")
    changes.groupBy("source", "lang", "version").agg(F.lit(7).cast("long").alias("docs"), F.lit(7).cast("long").alias("tokens")).write.parquet(f"{led.path}/rollup/batch=1")
    assert totals(led) == {}
    led.commit(1, changes)
    assert totals(led) == {("a", "v"): (1, 10)}


def test_counts(spark):
    rows = frame(spark, [(1, None), (2, ""), (3, "a b\tc"), (4, "x1 2é")])
    got = {r.doc_id: (r.w, r.p) for r in rows.select("doc_id", token_counts.count(F.col("text"), "words-1").alias("w"), token_counts.count(F.col("text"), "parts-2").alias("p")).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (3, 3), 4: (2, 4)}
    assert token_counts.corpus_counts(frame(spark, [])).count() == 0


# mixing


def test_allot_reshares_the_excess():
    t = mixing.allot({"a": 100, "b": 1000, None: 10, "c": 0}, (3.0, 1.0, 2.0), 1.5, 2.0)
    assert t["a"] == 200 and t["c"] == 0 and t[None] == 20 and t["b"] == pytest.approx(1.5 * 1110 - 220)
    assert mixing.allot({}, (3.0, 1.0, 2.0), 1.5, 2.0) == {}


def test_mixture_follows_keys_and_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) + ("!" * rng.randint(0, 9)), rng.choice(["x", "x", "x", "y", None])) for i in range(900)]
    rows += [(5000, None, "x"), (5001, "", "z"), (5002, "solo text", None), (5002, "solo text", None), (None, "no id here", "y")]
    docs = frame(spark, rows)
    mix = mixing.Mixture(docs)
    got = mix.counts(docs).withColumn("place", mixing.position(F.col("doc_id"), mixing.quality(F.col("text"), F.col("size").cast("double")), 0)).collect()
    for source in ("x", "y", None, "z"):
        mine = sorted((r for r in got if r.source == source), key=lambda r: r.place)
        taken = sum(r.size * r.copies for r in mine)
        assert abs(taken - mine[0].target) <= 45
        assert [r.copies for r in mine] == sorted((r.copies for r in mine), reverse=True)
        assert all(0 <= r.copies <= 2 for r in mine)
    assert sorted((r.doc_id or -1, r.copies) for r in mixing.Mixture(docs).counts(docs).collect()) == sorted((r.doc_id or -1, r.copies) for r in got)
    out = mix.take(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    empty = frame(spark, [])
    assert mixing.Mixture(empty).take(empty).count() == 0


@pytest.mark.parametrize("detail", [20_000, 5])
def test_ties_and_symbol_heavy_texts_meet_their_targets(spark, monkeypatch, detail):
    monkeypatch.setattr(mixing, "DETAIL", detail)
    tied = [(None, "a b c d e", "tied")] * 200 + [(None, f"a b c d x{i}", "ids") for i in range(200)]
    heavy = [(i, f"w{i} " + "#" * 3000, "symbols") for i in range(400)]
    rows = tied + heavy + [(10_000 + i, "one two three", "zz") for i in range(700)]
    docs = frame(spark, rows)
    got = mixing.Mixture(docs, share=0.6).counts(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in got} == dict(Counter(s for _, _, s in rows))
    assert all(abs(r.taken - r.target) <= 5 for r in got)
    again = frame(spark, random.Random(3).sample(rows, len(rows))).repartition(5)
    taken = lambda d: sorted((r.doc_id or -1, r.text, r.copies) for r in mixing.Mixture(d, share=0.6).counts(d).collect())
    assert taken(docs) == taken(again)


def test_heavier_documents_come_first(spark):
    docs = frame(spark, [(i, "word " * 10 + ("!" * 30 if i % 2 else ""), "s" if i < 400 else "t") for i in range(800)])
    got = mixing.Mixture(docs, weights=(1.0, 1.0), share=0.5).counts(docs).filter("source = 's'").groupBy((F.col("doc_id") % 2).alias("k")).agg(F.sum("copies").alias("n")).collect()
    n = {r.k: r.n for r in got}
    assert n[0] > n[1]


# chat


def convs(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip_and_masks(spark):
    tricky = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, 1, "assistant", "b\\"), (2, 0, "us:er\n", None), (2, None, None, "###\n</turn>\\"), (3, 0, "assistant", ""), (None, 0, "user", "x"), (4, 1, "assistant", "é😀"), (4, 1, "assistant", "é😀")]
    df = convs(spark, rows).withColumn("piece", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by = {1: [("user", tricky), ("assistant", tricky)], 2: [("", "###\n</turn>\\"), ("us:er\n", ""), ("assistant", "b\\")], 3: [("assistant", "")], None: [("user", "x")], 4: [("assistant", "é😀")] * 2}
    for k, turns in by.items():
        assert got[k].n_turns == len(turns) and got[k].history_kept
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k].formatted_chars == len(chat.MarkedTurns()(turns))
    assert chat.read_back(chat.format_turns(convs(spark, []))).count() == 0


def test_rows_without_conversation_are_on_their_own(spark):
    df = convs(spark, [(None, i % 3, "assistant", f"t{i}") for i in range(40)] + [(None, 0, "user", "same")] * 2 + [(5, 0, "user", "a"), (5, 1, "assistant", "b")])
    got = chat.read_back(chat.format_turns(df)).collect()
    assert sorted(r.n_turns for r in got) == [1] * 42 + [2] and all(r.history_kept for r in got)


def test_late_rewriting_and_numbering_over_forty_turns(spark):
    numbered = lambda ts: "".join(f"{i}/{r}:{t}\n" for i, (r, t) in enumerate(ts))
    late = lambda ts: ("OLD\n" if len(ts) <= 20 else "NEW\n") + "".join(f"{t}\n" for _, t in ts)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(40)]
    turns = [(r, t) for _, _, r, t in rows]
    got = chat.format_turns(convs(spark, rows), numbered).orderBy("turn_no").collect()
    assert "".join(r.piece for r in got) == numbered(turns) and all(r.history_kept for r in got)
    kept = [r.history_kept for r in chat.format_turns(convs(spark, rows), late).orderBy("turn_no").collect()]
    assert kept == [True] * 20 + [False] + [True] * 19


def test_rewriting_templates_are_seen():
    plain = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert all(k for _, _, k in chat.spans(iter(plain), chat.MarkedTurns()))
    shows_last = lambda turns: "".join(t if i == len(turns) - 1 else t[:0] for i, (_, t) in enumerate(turns))
    assert [k for _, _, k in chat.spans(iter(plain), shows_last)] == [True, False, False]


def test_long_conversations_stream_through_a_window():
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i} ###") for i in range(100)]
    template = chat.MarkedTurns()
    assert "".join(p for _, p, _ in chat.spans(iter(turns), template, window=7)) == template(turns)
    assert [(r, t) for r, t, _, _ in template.parse(template(turns))] == turns


def test_templates_that_look_back_see_whole_prefixes():
    turns = [("system", "be brief")] + [("user" if i % 2 == 0 else "assistant", f"t{i};") for i in range(49)]
    plain = lambda kept: "".join(t for _, t in kept)
    repeats = lambda ts: "".join(f"[{ts[0][1]}]{i}{t}" if r == "user" else t for i, (r, t) in enumerate(ts))
    assert "".join(p for _, p, _ in chat.spans(iter(turns), repeats)) == repeats(turns)
    drops = lambda ts: plain(ts[-20:])
    kept = [k for _, _, k in chat.spans(iter(turns), drops)]
    assert kept == [True] * 20 + [False] * 30

    def user_first(ts):
        assert not ts or ts[0][0] == "system"
        return plain(ts)

    assert "".join(p for _, p, _ in chat.spans(iter(turns), user_first)) == plain(turns)


def test_declared_look_back_streams():
    class EchoesThird:
        look_back = 3
        most = 0

        def __call__(self, turns):
            self.most = max(self.most, len(turns))
            return "".join(f"{t}<{turns[i - 3][1] if i >= 3 else ''}>" for i, (_, t) in enumerate(turns))

    turns = [("user", f"t{i}") for i in range(60)]
    template = EchoesThird()
    got = "".join(p for _, p, _ in chat.spans(iter(turns), template, window=2))
    assert template.most == 4 and got == template(turns)



# unigram


@pytest.fixture(scope="module")
def vocabulary():
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "▁ab", "abc", "c", "▁▁", "é"]
    scores = [0.0] * 257 + [-3.0, -2.0, -2.0, -2.5, -2.6, -6.0, -2.1, -3.5, -4.0]
    return unigram.Vocabulary(pieces, scores, {b: b + 1 for b in range(256)}, {0}, 0)


def best(text, pieces, scores):
    """Plain Viterbi over characters; unknown characters cost the least score less 10."""
    low = min(scores[257:]) - 10
    table = {p: s for p, s in zip(pieces[257:], scores[257:], strict=True)}
    top = [0.0] + [-1e18] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            s = table.get(text[i:j], low if j == i + 1 else None)
            if s is not None:
                top[j] = max(top[j], top[i] + s)
    return top[-1]


EDGE = ["", " ", "  ", "a", " ab", "ab ", "ab  ab", "\n", "a\n\nb", "\n a", "a \nb \n", "▁", "a▁b", "abcab zzé\x00", "日本 😀", "   lead", "trail   ", "ab" * 3000]


def test_viterbi_is_optimal_and_round_trips(vocabulary):
    rng = random.Random(3)
    texts = EDGE + ["".join(rng.choice("abcz é\n") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "▁ab", "abc", "c", "▁▁", "é"]
    for t, ids in zip(texts, vocabulary.encode(texts, {}), strict=True):
        ids = np.frombuffer(ids, "<i4")
        assert vocabulary.decode(ids).decode() == t
        if t and "▁" not in t and len(t) < 100:
            plain = "▁" + t.replace(" ", "▁")
            low = min(vocabulary.scores[257:]) - 10
            unknown = sum(1 for c in plain if c not in "▁abcé")
            got = sum(vocabulary.scores[i] for i in ids if not vocabulary.is_byte[i]) + low * unknown
            assert got == pytest.approx(best(plain, pieces, list(vocabulary.scores)))


def test_operator_edges(spark, vocabulary):
    rows = frame(spark, [(i, t) for i, t in enumerate(EDGE)] + [(99, None), (99, None)]).withColumnRenamed("lang", "ids")
    enc = unigram.encode(rows, vocabulary)
    assert {r.doc_id: r.decoded for r in unigram.decode(enc, vocabulary).collect()} == dict(enumerate(EDGE)) | {99: ""}
    assert all(r.round_trip for r in unigram.digests(rows, vocabulary).collect())
    assert unigram.digests(frame(spark, []), vocabulary).count() == 0


def test_long_units_and_runs(vocabulary):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (511, 700, 3000)] + ["a" * 2000, "ab" * 900 + "z" + "c" * 700]
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "▁ab", "abc", "c", "▁▁", "é"]
    low = min(vocabulary.scores[257:]) - 10
    for t, ids in zip(texts, vocabulary.encode(texts, {}), strict=True):
        ids = np.frombuffer(ids, "<i4")
        got = sum(vocabulary.scores[i] for i in ids if not vocabulary.is_byte[i]) + low * t.count("z")
        assert got == pytest.approx(best("▁" + t, pieces, list(vocabulary.scores)))
        assert vocabulary.decode(ids).decode() == t


def test_worker_memory_is_bounded_and_by_vocabulary(vocabulary, monkeypatch):
    other = unigram.Vocabulary(["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "x"], [0.0] * 257 + [-1.0, -2.0], {b: b + 1 for b in range(256)}, {0}, 0)
    first = unigram._Memory.of(vocabulary)
    first["x"] = b"1234"
    assert unigram._Memory.of(other) == {} and unigram._Memory.of(vocabulary) == {}
    monkeypatch.setattr(unigram, "CACHE", 1000)
    units = unigram._Memory.of(vocabulary)
    for k in range(10):
        units[str(k)] = b"1234"
        unigram._Memory.trim(len(units) - 1)
    assert len(units) < 10


def test_ranks_become_log_probabilities():
    assert unigram.are_ranks([0.0, -1.0, -5.0]) and not unigram.are_ranks([-1.5, -2.0]) and not unigram.are_ranks([-1.0, -1.0])
    assert np.exp(unigram.zipf(np.arange(100.0))).sum() == pytest.approx(1.0)


def test_registered_vocabulary_takes_best_paths():
    pytest.importorskip("sentencepiece")
    v = unigram.Vocabulary.load(PIECES)
    table = {b.decode().replace(" ", "▁"): x for i, (b, x) in enumerate(zip(v.bytes_of, v.scores.tolist(), strict=True)) if b and not v.is_byte[i]}
    assert sum(map(np.exp, table.values())) == pytest.approx(1.0, abs=1e-6)
    for t in ["The committee reviewed unbelievable results yesterday.", "antidisestablishmentarianism", "Straße und Fluss 2024"]:
        plain = "▁" + t.replace(" ", "▁")
        top = [0.0] + [-1e18] * len(plain)
        for i in range(len(plain)):
            for j in range(i + 1, min(len(plain), i + 40) + 1):
                if plain[i:j] in table:
                    top[j] = max(top[j], top[i] + table[plain[i:j]])
        ids = np.frombuffer(v.encode([t], {})[0], "<i4")
        assert v.scores[ids].sum() == pytest.approx(top[-1])


def test_public_vocabulary_round_trips():
    pytest.importorskip("sentencepiece")
    v = unigram.Vocabulary.load(PIECES)
    texts = ["Hello world, this is é test.\n\nNew  line", "x" * 300, "\t\r\n", "▁mark"]
    assert [v.decode(np.frombuffer(i, "<i4")).decode() for i in v.encode(texts, {})] == texts


# rules


def plain_counts(text):
    w = (text or "").split()
    ws = [x for x in w]
    three = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    mark = {i + k for i in range(len(ws) - 2) if three[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(mark)


def test_rules_match_plain_counts(spark, corpus, words):
    rows = [(i, t) for i, t in corpus if i != 2007] + [(4000, "é à 漢字\nx y\nx y\n\nx y "), (4001, "a b c " * 60), (4002, "w### " * 60), (4003, " ".join(words[:60]).upper()), (4004, "z " * 5000), (4005, "\n".join([" ".join(words[:9])] * 12))]
    got = {r.doc_id: r for r in rules.judge(frame(spark, rows).withColumnRenamed("lang", "kept")).collect()}
    for i, t in rows:
        r = got[i]
        n, chars, symbols, dup, repeat = plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    assert not any(got[i].kept for i in (4001, 4002, 4003, 4004, 4005)) and got[2006].kept
    assert rules.judge(frame(spark, [])).count() == 0


def test_order_changes_no_verdict(corpus):
    column = pa.array([t for _, t in corpus], pa.string())
    want = rules.cascade(rules.Texts(column), rules.RULES)
    for seed in range(4):
        shuffled = list(rules.RULES)
        random.Random(seed).shuffle(shuffled)
        assert (rules.cascade(rules.Texts(column), tuple(shuffled)) == want).all()


def test_order_is_by_rejections_per_cost(spark, corpus):
    found = rules.ordered_rules(frame(spark, corpus))
    assert sorted(r.name for r in found) == sorted(r.name for r in rules.RULES)
    # b rejects most per second; of what it leaves, a rejects nothing more, so c comes before it
    assert rules.greedy_order(["a", "b", "c"], [1.0, 1.0, 1.0], {0b011: 50, 0b010: 30, 0b100: 5}) == [1, 2, 0]
    assert rules.greedy_order(["a", "b"], [1.0, 100.0], {0b01: 10, 0b10: 50}) == [0, 1]


def plain_verdict(text):
    """The cascade's rules in plain Python, for a text that passes the base checks."""
    text = text or ""
    w = text.split()
    n, chars, symbols, dup, repeat = plain_counts(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    lines = sum(bool(line.strip(" \t\n\x0b\x0c\r")) for line in text.split("\n"))
    upper, letters = sum("A" <= c <= "Z" for c in text), sum("A" <= c <= "Z" or "a" <= c <= "z" for c in text)
    bad = 100 * symbols > 30 * n or 100 * dup > 40 * lines or (100 * upper > 60 * letters and letters >= 50)
    return not (bad or chars < 2 * n or chars > 15 * n or 100 * max(Counter(w).values()) > 35 * n)


def test_verdicts_match_plain_python(spark, words):
    rng = random.Random(6)
    rows = []
    for i in range(250):
        w = [rng.choice(words) for _ in range(rng.randint(30, 150))]
        kind = i % 10
        if kind == 1:
            w = [x + "#" * (rng.random() < 0.3) for x in w]
        elif kind == 2:
            w = [x.upper() if rng.random() < 0.6 else x for x in w]
        elif kind == 3:
            w = [rng.choice(words) * 4 if rng.random() < 0.7 else x for x in w]
        elif kind == 4:
            w = [x if rng.random() < 0.62 else "the" for x in w]
        elif kind == 5:
            w = [x[:1] if rng.random() < 0.95 else x for x in w]
        text = " ".join(w)
        if kind == 6:
            text = "\n".join([*(" ".join(w[k : k + 6]) for k in range(0, len(w), 6)), *(["same line"] * (len(w) // 9))])
        rows.append((i, text))
    docs = frame(spark, rows)
    got = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert got == {i: plain_verdict(t) for i, t in rows}
    assert 20 < sum(got.values()) < 230


# quality model


def test_labels_agree_with_held_out_truth(spark, words):
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        kind = rng.random()
        if kind < 0.1:
            w = [x + "***" for x in w]
        elif kind < 0.2:
            w = [x.upper() + "!!" for x in w[:30]] * 3
        elif kind < 0.3:
            w = [x for x in w[:5] for _ in range(20)]
        truth[i] = kind >= 0.3
        rows.append((i, " ".join(w)))
    rows += [(700, None), (701, ""), (702, "one"), (None, "x y z"), (703, rows[0][1]), (703, rows[0][1])]
    docs = frame(spark, rows).withColumnRenamed("lang", "score")
    model = quality_model.QualityModel(docs)
    got = {r.doc_id: r.kept for r in model.score(docs).collect()}
    right = [got[i] == t for i, t in truth.items()]
    assert sum(right) >= 0.97 * len(right)
    assert all(got[i] for i, t in truth.items() if t)
    assert got[700] and got[701] and got[702]
    assert model.keep(docs).columns == docs.columns
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in model.keep(docs).collect())
    assert kept == sorted((i if i is not None else -1) for i, _ in rows if got[i])
    empty = frame(spark, [])
    assert quality_model.QualityModel(empty).score(empty).count() == 0


def test_em_finds_the_bad_labeller():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.3
    k = len(quality_model.LABELLERS)
    acc = np.linspace(0.95, 0.6, k)
    v = np.where(rng.random((len(y), k)) < acc, y[:, None], ~y[:, None]).astype(np.int8)
    v[rng.random(v.shape) < 0.3] = -1
    u, c = np.unique(quality_model.pattern_of(v), return_counts=True)
    m = quality_model.fit_labels(u, c)
    assert np.abs(m.accuracy - acc).max() < 0.05


def test_em_over_patterns_is_em_over_rows():
    """The same model by plain loops over every row, and posteriors as products of probabilities."""
    rng = np.random.default_rng(5)
    k = len(quality_model.LABELLERS)
    y = rng.random(400) < 0.25
    v = np.where(rng.random((400, k)) < 0.85, y[:, None], ~y[:, None]).astype(np.int8)
    v[rng.random(v.shape) < 0.4] = -1
    u, c = np.unique(quality_model.pattern_of(v), return_counts=True)
    model = quality_model.fit_labels(u, c, rounds=7)
    prior, acc = 0.1, [0.95] * k

    def posterior(row):
        low, fine = prior, 1 - prior
        for a, x in zip(acc, row, strict=True):
            if x >= 0:
                low *= a if x == 1 else 1 - a
                fine *= a if x == 0 else 1 - a
        return low / (low + fine)

    for _ in range(7):
        p = [posterior(r) for r in v.tolist()]
        right = [sum(q if r[j] == 1 else 1 - q if r[j] == 0 else 0 for q, r in zip(p, v.tolist(), strict=True)) for j in range(k)]
        said = [sum(r[j] >= 0 for r in v.tolist()) for j in range(k)]
        acc = [min(max((a + 3.8) / (b + 4), 0.55), 0.999) for a, b in zip(right, said, strict=True)]
        prior = min(max((sum(p) + 0.1) / (len(p) + 1), 1e-4), 0.5)
    assert model.prior == pytest.approx(prior) and model.accuracy == pytest.approx(acc)
    assert model.posterior(v) == pytest.approx([posterior(r) for r in v.tolist()])
