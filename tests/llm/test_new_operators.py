"""Operators 11 to 13: learning on planted stems, exact covariances, periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import frame
from pyspark.sql import functions as F
from tidewatch.llm import periodic, toxicity
from tidewatch.llm.toxicity import Matrix, ToxicityModel, fit_pu, risks
from tidewatch.llm.whitening import Whitening, jacobi

# ---- 13: periodic runs ---------------------------------------------------------------------------------------------


def brute_runs(w):
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_texts():
    rng = random.Random(3)
    out = [None, "", " \t\n ", "a", "a " * 5, "a " * 6, "a b " * 30, "a\x0bb\x0cc\r\n" * 9, "a a a a a a b b b b b b", "ab ab ab " * 12, "x" * 30000]
    for _ in range(80):
        words = []
        while len(words) < rng.choice([20, 60, 200]):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words += unit * rng.randint(1, 7) + unit[: rng.randrange(len(unit) + 1)]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("comparisons", [periodic.RANGE, 50])
def test_runs_and_ranges_of_lags(spark, comparisons):
    """With 50 comparisons a range, nearly every text is dealt out over many rows."""
    texts = periodic_texts()
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[20]), (7, texts[20]), (None, texts[21])]
    found = periodic.PeriodicRuns(comparisons=comparisons).find(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        runs = brute_runs(w)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        want.append((-1 if i is None else i, len(w), runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert got == sorted(want)
    assert sum(len(w[2]) for w in want) > 100


def test_run_digests(spark):
    docs = frame(spark, [(k, t) for k, t in enumerate(periodic_texts())])
    found = {r.doc_id: r for r in periodic.digests(periodic.PeriodicRuns().find(periodic.with_planted(docs))).collect()}
    for k, t in enumerate(periodic_texts()):
        w = (t or "").encode().split()
        h = zlib.crc32(str(k).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        r = found[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()


def test_runs_of_empty_table_and_other_columns(spark):
    assert periodic.digests(periodic.PeriodicRuns().find(frame(spark, []))).count() == 0
    odd = frame(spark, [(1, "a " * 8)]).withColumn("runs", F.lit(1)).withColumn("key", F.lit("x")).withColumn("collapsed", F.lit(2))
    assert periodic.PeriodicRuns().find(odd).first().collapsed == "a"
    with pytest.raises(ValueError):
        periodic.PeriodicRuns(min_exp=2)


# ---- 12: whitening -------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>"


def test_jacobi_keeps_small_eigenvalues():
    d = np.diag(10.0 ** -np.arange(0, 36, 6))
    rng = np.random.default_rng(0)
    b = rng.normal(size=(6, 6))
    b = b @ b.T / 6 + np.eye(6)
    a = d @ b @ d  # graded: relative accuracy is possible for every eigenvalue
    e, v = jacobi(a)
    assert np.allclose(np.linalg.norm(v, axis=0), 1) and (np.diff(e) < 0).all() and (e > 0).all()
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    # The product of all eigenvalues is the determinant, by exact elimination of the doubles.
    m = [[Fraction(float(x)) for x in row] for row in a]
    det = Fraction(1)
    for k in range(6):
        det *= m[k][k]
        for i in range(k + 1, 6):
            f = m[i][k] / m[k][k]
            m[i] = [x - f * y for x, y in zip(m[i], m[k], strict=True)]
    product = Decimal(1)
    for x in e:
        product *= Decimal(float(x))
    assert abs(float(product / (Decimal(det.numerator) / Decimal(det.denominator))) - 1) < 1e-12
    e, v = jacobi(np.array([[2.0, 0.0], [0.0, 2.0]]))
    assert e.tolist() == [2.0, 2.0] and np.array_equal(v, np.eye(2))


@pytest.mark.parametrize("slices", [1, 7])
def test_whitening_against_numpy(spark, slices):
    rng = np.random.default_rng(4)
    raw = rng.normal(size=(500, 12)) @ rng.normal(size=(12, 12)) * 10.0 ** -np.arange(12).clip(0, 2)
    rows = [(k, [float(c) for c in r]) for k, r in enumerate(raw)]
    rows += [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1e300] + [0.0] * 11), (906, [1.0, 2.0]), (3, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame(rows, VECTORS).repartition(slices)
    kept = [r for r in rows if r[0] is None or r[0] < 900]
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = np.array((x * n - s) / n, dtype=float)
    cov = z.T @ z / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    got = Whitening(df).apply(df).collect()
    assert len(got) == 8 * n and {r.component for r in got} == set(range(1, 9))
    one = {(r.vec_id, r.component): r for r in got}
    sign = {}
    for k, (i, _) in enumerate(kept):
        for c in range(8):
            r = one[i, c + 1]
            want = z[k] @ v[:, c] / np.sqrt(e[c])
            sign.setdefault(c, 1 if r.whitened * want > 0 else -1)
            assert abs(r.whitened - sign[c] * want) < 1e-8
            assert r.n == n and r.deviation == int(((n * x[k] - s) ** 2).sum())
            assert abs(r.explained / (e[c] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-10


def test_whitening_is_the_same_however_rows_are_dealt(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, [float(c) for c in r]) for k, r in enumerate(rng.normal(size=(300, 5)))], VECTORS)
    fits = [Whitening(df.repartition(k)).fit for k in (1, 3, 8)]
    assert all(np.array_equal(f.covariance, fits[0].covariance) and np.array_equal(f.vectors, fits[0].vectors) for f in fits)


def test_whitening_of_awkward_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert Whitening(empty).apply(empty).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [])], VECTORS)
    assert Whitening(bad).apply(bad).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)
    rows = Whitening(one).apply(one).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation) for r in rows] == [(1, None, 0.0, 0), (2, None, 0.0, 0)]
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(6)], VECTORS).withColumn("x", F.lit(1)).withColumn("component", F.lit(2))
    rows = Whitening(flat).apply(flat).collect()
    assert len(rows) == 18 and {r.component for r in rows if r.whitened is None} == {2, 3} and rows[0].identity_error < 1e-9
    far = spark.createDataFrame([(1, [1e12]), (2, [-1e12])], VECTORS)
    rows = Whitening(far).apply(far).collect()
    assert [r.deviation for r in rows] == [None, None] and sorted(round(r.whitened, 9) for r in rows) == [-1.0, 1.0]


# ---- 11: toxicity --------------------------------------------------------------------------------------------------


def planted_toxicity(n=1200, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "ru", "se", "to", "ne"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["zgork", "zgorken", "Plimf!"]))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return docs, labels, dict(labels)


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels, truth = planted_toxicity()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    first = ToxicityModel(frame(spark, docs), table).score(frame(spark, docs)).collect()
    got = {r.doc_id: r for r in first}
    assert len(first) == len(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in first)
    tests = [i for i in truth if held(i)]
    right = sum(got[i].predicted == truth[i] for i in tests)
    caught = sum(got[i].predicted for i in tests if truth[i]) / max(sum(truth[i] for i in tests), 1)
    assert right / len(tests) > 0.97 and caught > 0.9
    # Labels of held-out rows change nothing.
    flipped = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in ToxicityModel(frame(spark, docs), flipped).score(frame(spark, docs).repartition(5)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_risk_of_the_clean_part_stays_above_zero():
    """Against brute force on a sample that is separable: the plain risk would go below zero, this one does not."""
    pos = Matrix(np.array([0, 1, 2]), np.array([0, 0, 0]), 3, 1)
    every = Matrix(np.array([0, 1]), np.array([0, 0]), 20, 1)
    w = fit_pu(pos, every, 0.1, ridge=1e-6, steps=2000)
    f_pos, f_all = pos.dot(w[:-1]) + w[-1], every.dot(w[:-1]) + w[-1]
    loss = lambda z: sum(np.log1p(np.exp(-x)) for x in z) / len(z)
    assert np.allclose(risks(f_pos, f_all, 0.1), (0.1 * loss(f_pos), loss(-f_all) - 0.1 * loss(-f_pos)))
    assert f_pos[0] > 0 > f_all[-1] and risks(f_pos, f_all, 0.1)[1] > -0.05


def test_grams_of_blocks_agree(monkeypatch):
    texts = pa.array(["Ab abc abcdefgh", "", None, "a", "ééé x", "lorem ipsum dolor " * 40, "one two"])
    want = sorted((r, s) for rows, slots in toxicity.grams(texts) for r, s in zip(rows.tolist(), slots.tolist(), strict=True))
    monkeypatch.setattr(toxicity, "BLOCK", 60)
    got = [(r, s) for rows, slots in toxicity.grams(texts) for r, s in zip(rows.tolist(), slots.tolist(), strict=True)]
    assert sorted(got) == want and len(set(got)) == len(got)
    plain = set()
    for r, t in enumerate(texts.to_pylist()):
        for w in (t or "").lower().encode().split():
            w = b" " + w + b" "
            for size in toxicity.SIZES:
                for k in range(len(w) - size + 1):
                    h = size
                    for c in w[k : k + size]:
                        h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                    h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                    plain.add((r, h >> 32 - toxicity.BITS))
    assert {x for x in want} == plain


def test_toxicity_of_awkward_tables(spark):
    labels = "doc_id long, toxic int"
    none = spark.createDataFrame([], labels)
    assert ToxicityModel(frame(spark, []), none).score(frame(spark, [])).count() == 0
    rows = [(None, "zgork"), (1, None), (2, ""), (3, "zgork bad"), (3, "zgork bad"), (4, "x" * 3_000_000), (5, "fine words here")]
    assert {r.score for r in ToxicityModel(frame(spark, rows), none).score(frame(spark, rows)).collect()} == {0.0}
    marked = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (1, None)], labels)
    odd = frame(spark, rows).withColumn("key", F.lit(1)).withColumn("positive", F.lit(True)).withColumn("toxic", F.lit("1")).withColumn("id", F.lit(3))
    found = ToxicityModel(odd, marked).score(odd).collect()
    assert len(found) == len(rows) and len({r.score for r in found if r.doc_id == 3}) == 1
