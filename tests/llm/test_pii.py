import hashlib
import random
import re

from conftest_llm import frame

from tidewatch.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, p in RULES.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "x", "a@b.cd", "a@b.cd%e@f.gh and a@b", "é😀 mail bob.x+y@mail-1.example.com, +1 (555) 123-4567!", "300.1.2.3.4 then 10.0.0.255 1.2.3.4.5.6.7.8 001.02.3.4", "4111 1111 1111 1111 and 4111111111111112",
    "4111-1111-1111-1111 4111 1111 1111 1111 4111", "12 34", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "+12 +1234567 +12345678 +123456789012345678", "@@@ a@@b.c", "9" * 5000, "a" * 20000, "1 " * 4000, "+1" * 3000, "1." * 3000,
    "4111  1111 1111 1111 1111", "tel +49 (30) 1234-5678.", "a@b.c-d.e_f", "﻿x@y.zz",
]


def test_base_spans_match_plain_regex(spark):
    got = {r.doc_id: r for r in pii.find(frame(spark, list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        want = base(t)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), t[:60]
        assert [got[i][f"n_{k}"] for k in RULES] == [sum(x[0] == k for x in want) for k in RULES]
        assert got[i].spans.startswith(line)


def test_confident_context_finds_what_the_base_misses(spark):
    rows = [(i, f"Blah blah. Phone: +1 555 {i:03d} 4567 thanks. the {i} end") for i in range(100, 140)]
    rows += [(500, "Blah. Phone: 5551234567 thanks."), (501, "Nothing here: 5551234567 of it."), (502, "Phone: cheap thanks")]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert got[500].spans == "ctx_phone:13:23" and got[500].n_phone == 0
    assert got[501].spans == "" and got[502].spans == ""
    assert got[100].n_phone == 1 and got[100].spans.count(":") == 2


def planted(n=600):
    """Texts with identifiers beside telling words, some in forms that the base patterns miss, and numbers that are none."""
    rng = random.Random(11)
    filler = ["river", "stone", "and", "of", "the", "market", "walks", "over", "green", "letter"]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    seen = {"email": lambda: f"u{digits(4)}@mail{digits(1)}.example.com", "ip": lambda: f"10.{rng.randrange(256)}.{rng.randrange(256)}.7", "phone": lambda: f"+49{digits(9)}"}
    unseen = {"email": lambda: f"u{digits(4)}(at)mail.example", "ip": lambda: f"10-{rng.randrange(256)}-{rng.randrange(256)}-7", "phone": lambda: digits(9)}
    cue = {"email": ["Mail:", "address"], "ip": ["host", "from-ip"], "phone": ["Phone:", "dial"]}
    rows, truth = [], set()
    for i in range(n):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 20))]
        kind = rng.choice(list(cue))
        new = rng.random() < 0.4
        at = rng.randrange(len(words))
        value = (unseen if new else seen)[kind]()
        words[at:at] = [rng.choice(cue[kind]), value]
        if rng.random() < 0.5:  # numbers of a phone's shape in other places
            words.insert(rng.choice([0, len(words)]), digits(9))
            if len(words) > 1 and words[0][0].isdigit():
                at += 1
        text = " ".join(words)
        rows.append((i, text))
        if new:
            begin = len(" ".join(words[: at + 1])) + 1
            truth.add((i, f"ctx_{kind}:{begin}:{begin + len(value)}"))
    return rows, truth


def test_precision_and_recall_of_unseen_identifiers(spark):
    rows, truth = planted()
    got = {(r.doc_id, x) for r in pii.find(frame(spark, rows)).collect() for x in r.spans.split(",") if x.startswith("ctx_")}
    assert len(truth) > 200
    assert len(got & truth) >= 0.95 * len(got) and len(got & truth) >= 0.95 * len(truth)


def brute_scores(rows, rounds, confident, support):
    """Confident patterns by plain loops over the texts."""
    tokens = re.compile(r"(?<!\S)(?=\S*?(?:[0-9@]|\(at\)|\[at\]))\S+")
    shape = {k: re.compile(v) for k, v in pii._SHAPE.items()}
    graph, total = {}, {}
    for _, text in rows:
        for w in text.lower().split():
            total[w] = total.get(w, 0) + 1
        spans = [(k, a, b) for k, a, b in base(text)]
        taken = [(None, m.start(), m.end()) for m in tokens.finditer(text) if any(s.search(m[0]) for s in shape.values()) and not any(re.search(RULES[k], m[0]) for k in ("email", "ip", "phone"))]
        for kind, a, b in spans + taken:
            left, right = text[:a].split()[-1:], text[b:].split()[:1]
            if a and not text[a - 1].isspace():
                left = [text[:a].split()[-1]]
            for side, w in (("L:", left), ("R:", right)):
                if w:
                    e = graph.setdefault(side + w[0].lower(), {}).setdefault(text[a:b], [None, 0])
                    e[0], e[1] = e[0] or kind, e[1] + 1
    graph = {p: v for p, v in graph.items() if len(v) >= support}
    belief, scores = {}, {}
    for step in range(rounds):
        scores = {}
        for p, vals in graph.items():
            for k in RULES:
                seeds = {v: n for v, (kind, n) in vals.items() if kind == k}
                free = {v: n for v, (kind, n) in vals.items() if kind is None and shape[k].search(v)}
                if sum(1 for _ in seeds) + sum(belief.get((v, k), 0) >= confident for v in free) < support:
                    continue
                held = sum(seeds.values()) + sum(n * belief.get((v, k), 0.0) for v, n in free.items())
                spare = sum(n * (1 - belief.get((v, k), 0.0)) for v, n in free.items())
                score = held / (max(total.get(p[2:], 0) - spare, held) + 1)
                if score >= confident / 2:
                    scores[p, k] = score
        if step + 1 == rounds:
            break
        wrong = {}
        for (p, k), x in scores.items():
            for v, (kind, _) in graph[p].items():
                if kind is None and shape[k].search(v):
                    wrong[v, k] = wrong.get((v, k), 1.0) * max(1e-6, 1 - x)
        belief = {vk: 1 - w for vk, w in wrong.items()}
    return {pk: x for pk, x in scores.items() if x >= confident}


def test_scores_match_brute_force(spark):
    rows, _ = planted(300)
    docs = frame(spark, rows)
    got = {(r.pattern, r.kind): r.score for r in pii.confident_patterns(pii._edges(pii.scan(docs)), docs).collect()}
    want = brute_scores(rows, pii.ROUNDS, pii.CONFIDENT, pii.SUPPORT)
    assert got.keys() == want.keys() and len(want) >= 6
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.cd 10.0.{i % 256}.1" for i in range(8000))
    got = pii.find(frame(spark, [(1, text)])).first()
    assert got.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(text)).encode()).hexdigest()


def test_empty_repeated_and_null_id(spark):
    assert pii.find(frame(spark, [])).count() == 0
    rows = frame(spark, [(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")]).withColumnRenamed("lang", "token").withColumnRenamed("source", "base")
    got = [r.spans for r in pii.find(rows).collect()]
    assert got == ["email:0:6"] * 3


def test_only_native_operators(spark):
    plan = pii.scan(frame(spark, [(1, "a@b.cd")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
