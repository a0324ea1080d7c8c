import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import frame

from tidewatch.llm import ngram_join
from tidewatch.llm.common import word_hashes
from tidewatch.llm.components import connected_components


def brute(rows, size=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = (t or "").translate(low).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def classes(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.JaccardJoin(**kw).classes(df).collect()}


def test_classes_match_brute_force(spark, corpus):
    got = classes(frame(spark, corpus))
    assert got == brute(corpus)
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("settings", [{"LOADS": (2.8, 0.0), "COARSER": 9.0, "HUB_ROUNDS": 1}, {"HUB_ROUNDS": 0, "BROADCAST_IDS": 0}, {"LOADS": (0.0,), "HOT_SHARE": 0.0, "HUB_ROUNDS": 0}])
def test_other_allocations_find_the_same(spark, corpus, monkeypatch, settings):
    """Coarse segments with deletions, no hubs and no broadcast, single tokens and salted keys."""
    for k, v in settings.items():
        monkeypatch.setattr(ngram_join, k, v)
    assert classes(frame(spark, corpus)) == brute(corpus)


def test_empty_table_and_clashing_columns(spark):
    assert classes(frame(spark, [])) == {}
    df = frame(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f")]).toDF("doc_id", "text", "node", "key", "digest")
    got = ngram_join.JaccardJoin().classes(df).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, None), (1, 1), (2, 1)]


def test_keep_removes_rows_not_ids(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "one two three four five six"
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (8, None), (8, None), (None, a), (9, a.upper() + " i"), (9, "z")]
    docs = frame(spark, rows).withColumnRenamed("lang", "node")
    for limit in (ngram_join.BROADCAST_IDS, 0):
        ngram_join.BROADCAST_IDS, had = limit, ngram_join.BROADCAST_IDS
        try:
            got = ngram_join.JaccardJoin().keep(docs)
            assert got.columns == docs.columns
            assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted([(-1, a), (3, a), (5, b), (7, c), (8, ""), (8, ""), (9, "z")])
        finally:
            ngram_join.BROADCAST_IDS = had
    assert ngram_join.JaccardJoin().keep(frame(spark, [])).count() == 0


def test_pairs_at_the_threshold_share_a_unit():
    """Any two sets that differ in as many tokens as may be share a key, under each option."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 9, 30, 60, 400):
        spare = ngram_join.spare_of(n, 3, 4)
        for load in ngram_join.LOADS:
            for _ in range(30):
                s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                k = int(rng.integers(0, spare + 1))
                r = np.unique(np.r_[s, rng.integers(0, 2**63, k).astype(np.uint64)])
                if 4 * len(s) < 3 * len(r):
                    continue
                band = ngram_join.band_of(len(s))
                option = ngram_join.LOADS.index(load)
                deletions = ngram_join.segments_of(band, load) if load else 0
                keys = [set(ngram_join.keys_of(x, np.array([0, len(x)]), np.array([band]), {band: (option, deletions)}, 3, 4)[0].tolist()) for x in (s, r)]
                assert keys[0] & keys[1]


def test_word_hashes_ignore_block_borders(monkeypatch):
    from tidewatch.llm import common

    text = pa.array(["alpha beta  gamma\u000bdelta é " * 40, None, "", "x" * 500, "alpha"])
    whole = word_hashes(text, True)
    monkeypatch.setattr(common, "_BLOCK", 64)
    parts = word_hashes(text, True)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert whole[0][0] == whole[0][-1]


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 1), (None, 2)], {}), ([(i, i + 1) for i in range(40)], dict.fromkeys(range(1, 41), 0)), ([(5, 1), (5, 9), (2, 3)], {5: 1, 9: 1, 3: 2})])
def test_components(spark, edges, want):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_variants_below_the_threshold_make_few_pairs(spark, monkeypatch):
    """Variants of one text, far from each other and from it, are not compared two by two; links among them are found."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 1200)]

    def edited(words, many, tag):
        words = list(words)
        for k in rng.choice(len(words), many, replace=False).tolist():
            words[k] = f"{tag}x{k}"
        return words

    variants = [edited(base, 48, f"v{i}") for i in range(40)]
    rows = [(0, base), *enumerate(variants, 1), *((100 + i, edited(variants[i], 6, f"c{i}")) for i in range(5)), (200, base[:1180])]
    rows = [(i, " ".join(words)) for i, words in rows]
    want = brute(rows)
    assert len({c for _, c in want.values()}) == 41
    pairs, verified = {}, ngram_join.JaccardJoin.verified

    def watched(self, some, docs, reps, name):
        pairs[name] = some.count()
        return verified(self, some, docs, reps, name)

    monkeypatch.setattr(ngram_join.JaccardJoin, "verified", watched)
    for rounds in (ngram_join.HUB_ROUNDS, 0):
        monkeypatch.setattr(ngram_join, "HUB_ROUNDS", rounds)
        assert classes(frame(spark, rows)) == want
        assert pairs.get("ngram-rest", 0) <= 60
