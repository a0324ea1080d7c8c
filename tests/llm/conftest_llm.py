import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source), with the columns of the table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text): prose, exact and near copies, shared passages, and the awkward cases."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(30)
    rows = []
    for i in range(60):
        body = prose(rng.randint(3, 160))
        rows.append((i, body))
        if i % 4 == 0:
            toks = body.split()
            for k in range(3):
                copy = list(toks)
                for _ in range(max(1, len(copy) * k // 40)):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
                rows.append((100 + 10 * i + k, " ".join(copy).upper() if k == 2 else " ".join(copy)))
        if i % 5 == 0:
            rows.append((1000 + i, shared + " " + prose(rng.randint(2, 12))))
    rows += [(2000, None), (2001, ""), (2002, " \t\n "), (2003, "one"), (2004, "ONE"), (2005, "a b c d"), (2006, prose(30_000)), (2007, rows[0][1]), (2007, rows[0][1])]
    return rows
