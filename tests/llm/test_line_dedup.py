import random

from conftest_llm import frame

from tidewatch.llm import line_dedup
from tidewatch.llm.line_dedup import LineDedup, within_one_edit


def brute(rows):
    """Texts left, by doc_id."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = sorted((i, k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")))
    seen, order, out = {}, [], {}
    for i, k, line in lines:
        w = tuple(line.translate(low).split())
        if not w:
            keep = True
        elif w in seen:
            keep = False
        else:
            seen[w] = True
            keep = not any(len(w) >= line_dedup.MIN_WORDS and len(v) >= line_dedup.MIN_WORDS and within_one_edit(list(w), list(v)) for v in order)
            order.append(w)
        if keep:
            out.setdefault(i, []).append(line)
        else:
            out.setdefault(i, [])
    return {i: "\n".join(v) for i, v in out.items()}


def make(words, n=50):
    rng = random.Random(4)
    line = lambda k: [rng.choice(words) for _ in range(k)]
    pool = [line(rng.randint(1, 25)) for _ in range(30)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(pool)) if rng.random() < 0.7 else line(rng.randint(1, 20))
            kind = rng.random()
            if kind < 0.15 and len(w) > 1:
                w[rng.randrange(len(w))] = rng.choice(words)
            elif kind < 0.25 and len(w) > 1:
                w.pop(rng.randrange(len(w)))
            elif kind < 0.35:
                w.insert(rng.randrange(len(w) + 1), rng.choice(words))
            elif kind < 0.4:
                w = [x.upper() for x in w]
            text.append(" ".join(w))
            if rng.random() < 0.2:
                text.append("  ")
        rows.append((i, "\n".join(text)))
    return rows + [(900, None), (901, ""), (902, "\n\n"), (903, " ".join(words[:2000]) + "\n" + " ".join(words[:1999]))]


def test_matches_brute_force(spark, words, monkeypatch):
    rows = make(words)
    want = brute(rows)
    for limit in (500_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
        docs = frame(spark, rows)
        got = LineDedup(docs).apply(docs).collect()
        assert {r.doc_id: r.text for r in got if r.text is not None} == want
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got)
        assert len(got) == len(rows) and got[0].__fields__ == docs.columns


def test_repeated_rows_empty_table_and_null_id(spark):
    docs = frame(spark, [])
    assert LineDedup(docs).apply(docs).count() == 0
    docs = frame(spark, [(1, "x y\nx y"), (1, "x y\nx y"), (None, "x y")]).withColumnRenamed("lang", "_lines2").withColumnRenamed("source", "lines")
    got = sorted((r.doc_id or 0, r.text) for r in LineDedup(docs).apply(docs).collect())
    assert got == [(0, "x y"), (1, "x y"), (1, "x y")]


def test_hot_variant_is_linear(spark, words):
    base = words[:12]
    rows = [(i, " ".join([*base[:5], f"n{i}", *base[6:]])) for i in range(300)]
    docs = frame(spark, rows)
    d = LineDedup(docs)
    assert d.near.count() == 299
    assert [r.doc_id for r in d.apply(docs).filter("text <> ''").collect()] == [0]
