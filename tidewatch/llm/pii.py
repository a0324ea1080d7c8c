"""Personal data: base patterns, and bootstrapped contextual extraction.

Base matches of each kind (email, ip, card, phone) are seeds.  The nearest word on either side (within 48
characters) is a lexical pattern; patterns and identifier-like values form a graph of co-occurrence.  In
each round a pattern's score for a kind is the share of its occurrences in the corpus that stand beside a
value held to be of that kind.  Unknown values of the kind's shape count neither for nor against, but as
far as they are believed; a value is believed unless all its patterns are wrong.  Believed values support
patterns in the next round.  Patterns above ``CONFIDENT`` with enough distinct values mark further values
of the kind's shape; their spans have the kind's name with ``ctx_`` before it.

Only DataFrame functions: texts are matched in the JVM (whole texts, linear patterns), and the graph is
joined and grouped by pattern and by value.  Occurrences of pattern words come from partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENT = 0.8
#: Distinct values, seeds or believed ones, that a pattern needs.
SUPPORT = 4
#: Up to so many patterns are broadcast to the words of the corpus; beyond, a shuffled join.
BROADCAST_PATTERNS = 200_000

_LOCAL = "[A-Za-z0-9._%+-]"
# The kinds' patterns.  Lookbehinds and possessive quantifiers change no match; they keep long runs
# of one character linear.  For cards, a match is a maximal chain of digits with single separators.
_PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?(?:\.|$)){4}$"
_TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*?(?:[0-9@]|\(at\)|\[at\]))[^\x20\x09-\x0D]++"
_BEFORE, _AFTER = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$", r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)"
#: A part of a gap in which the word next to the match is whole.
_BEFORE_WHOLE, _AFTER_WHOLE = r"[\x20\x09-\x0D][^\x20\x09-\x0D]++[\x20\x09-\x0D]*+$", r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]"
#: Words of more characters are named by their digest.
LONG_WORD = 48
_SPAN = "array<struct<b:int,e:int,v:string,left:string,right:string>>"
#: Shape that a value found by context must have, by kind; values with a base match inside are out.
_SHAPE = {
    "email": r"^[^@]+(?:@|\(at\)|\[at\])[^@]+$",
    "ip": r"^[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}[^0-9]?$",
    "card": r"^(?:[^0-9]{0,2}[0-9]){12,19}[^0-9]{0,2}$",
    "phone": r"^(?:[^0-9]{0,2}[0-9]){7,11}[^0-9]{0,2}$",
}


def named(word: Column) -> Column:
    """A word as patterns name it: in lower case; a long one by its digest, so that no pattern is long."""
    low = F.lower(word)
    return F.when(F.length(low) <= LONG_WORD, low).otherwise(F.concat(F.lit("#"), F.sha2(low.cast("binary"), 256)))


def _beside(gap: Column, pattern: str, end, whole: str) -> Column:
    """The word of gap next to a match.  A part of the gap is looked at first; if the word may go on beyond it, all."""
    part = end(gap, F.lit(LONG_WORD))
    return named(F.regexp_extract(F.when((F.length(gap) <= LONG_WORD) | part.rlike(whole), part).otherwise(gap), pattern, 1))


def _found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, with code-point offsets and the text on either side.

    Offsets are sums over blocks of 64 matches, so that many matches stay near linear.
    """
    none = F.array().cast(_SPAN)
    upto = lambda x, i, n: F.aggregate(F.slice(x["steps"], i + 1, n), F.lit(0), lambda a, b: a + b)

    def spans(x: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            end = F.get(x["starts"], F.shiftright(i, 6)) + upto(x, F.shiftright(i, 6) * 64, i.bitwiseAND(63) + 1)
            left, right = _beside(F.get(x["gaps"], i), _BEFORE, F.right, _BEFORE_WHOLE), _beside(F.get(x["gaps"], i + 1), _AFTER, F.left, _AFTER_WHOLE)
            return F.struct((end - F.length(hit)).alias("b"), end.alias("e"), hit.alias("v"), left.alias("left"), right.alias("right"))

        return F.when(F.size(x["hits"]) > 0, F.transform(x["hits"], span)).otherwise(none)

    def with_starts(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.size(x["steps"]) - 1, F.lit(0)), F.lit(64))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, i: F.array_append(acc, F.element_at(acc, -1) + upto(x, i, 64)))
        return F.struct(x["gaps"].alias("gaps"), x["hits"].alias("hits"), x["steps"].alias("steps"), starts.alias("starts"))

    def with_steps(x: Column) -> Column:
        steps = F.transform(x["hits"], lambda hit, i: F.length(F.get(x["gaps"], i)) + F.length(hit))
        return F.struct(x["gaps"].alias("gaps"), x["hits"].alias("hits"), steps.alias("steps"))

    parts = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")))
    return F.element_at(F.transform(F.transform(F.transform(parts, with_steps), with_starts), spans), 1)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        twice = 2 * digit
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


_VALID = {
    "email": None,
    "ip": lambda v: v.rlike(_OCTETS),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """Array of the kind's base matches in text."""
    spans = _found(text, _PATTERN[kind])
    valid = _VALID[kind]
    if valid is not None:
        spans = F.filter(spans, lambda s: valid(s["v"]))
    return F.when(text.rlike(_HINT[kind]), spans).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, token): spans of each row; token: identifier-like words without a base match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = "|".join(f"(?:{_PATTERN[k]})" for k in ("email", "ip", "phone"))
    shape = "|".join(f"(?:{s})" for s in _SHAPE.values())
    tokens = F.filter(_found(F.col("text"), _TOKEN), lambda s: s["v"].rlike(shape) & ~s["v"].rlike(known))
    tokens = F.when(F.col("text").rlike(r"[0-9@]|\(at\)|\[at\]"), tokens).otherwise(F.array().cast(_SPAN))
    return rows.select("doc_id", F.xxhash64("text").alias("key"), *[base_spans(F.col("text"), k).alias(k) for k in KINDS], tokens.alias("token"))


def _tagged(column: str) -> Column:
    kind = F.lit(None if column == "token" else column).cast("string")
    return F.transform(column, lambda s: F.struct(kind.alias("kind"), s.alias("s")))


def _written(column: str, kind: str) -> Column:
    return F.transform(column, lambda s: F.concat_ws(":", F.lit(kind), s["b"].cast("string"), s["e"].cast("string")))


def _edges(scanned: DataFrame) -> DataFrame:
    """One row for each occurrence and side: (doc_id, key, b, e, value, kind, pattern); kind is null for unknown tokens."""
    parts = F.flatten(F.array(*[_tagged(k) for k in (*KINDS, "token")]))
    rows = scanned.select("doc_id", "key", F.explode(parts).alias("x")).select("doc_id", "key", "x.kind", "x.s.*")
    sides = F.array(F.concat(F.lit("L:"), F.col("left")), F.concat(F.lit("R:"), F.col("right")))
    return rows.select("doc_id", "key", "b", "e", F.col("v").alias("value"), "kind", F.explode(sides).alias("pattern")).filter(F.length("pattern") > 2)


def shaped(kind: Column, value: Column) -> Column:
    """True if a value has the shape that its kind asks for."""
    return F.coalesce(*[F.when(kind == k, value.rlike(p)) for k, p in _SHAPE.items()])


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each pattern's word occurs in the texts."""
    word = F.expr("substring(pattern, 3)")
    wanted = patterns.select(word.alias("word")).distinct()
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_PATTERNS else wanted
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(f"({WORD})"))).alias("word")).select(named(F.col("word")).alias("word"))
    totals = words.join(side, "word").groupBy("word").agg(F.count(F.lit(1)).alias("total"))
    return patterns.withColumn("word", word).join(totals, "word", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))


def confident_patterns(edges: DataFrame, docs: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, score) of the patterns that may mark new values."""
    graph = edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    graph = materialize(graph.join(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") >= support).select("pattern"), "pattern"), "pii-graph")
    totals = materialize(occurrences(docs, graph.select("pattern").distinct()), "pii-totals")
    # Every unknown value stands once for each kind whose shape it has.
    kinds = F.array(*[F.lit(k) for k in KINDS])
    unknown = graph.filter("kind is null").select("pattern", "value", "n", F.explode(kinds).alias("kind")).filter(shaped(F.col("kind"), F.col("value")))
    seeds = graph.filter("kind is not null").select("pattern", "value", "n", "kind", F.lit(1.0).alias("belief"), F.lit(False).alias("open"))
    values = seeds.unionByName(unknown.withColumns({"belief": F.lit(0.0), "open": F.lit(True)}))
    scores = None
    for step in range(rounds):
        held = values.groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("belief")).alias("held"),
            F.sum(F.when(F.col("open"), F.col("n") * (1.0 - F.col("belief"))).otherwise(0.0)).alias("spare"),
            F.count_if(F.col("belief") >= confident).alias("support"),
        )
        # A word that stands between two values is beside both, so a total is at least what is held.
        total = F.greatest(F.col("total") - F.col("spare"), F.col("held"))
        scored = held.filter(F.col("support") >= support).join(totals, "pattern").withColumn("score", F.col("held") / (total + 1.0))
        scores = materialize(scored.filter(F.col("score") >= confident / 2).select("pattern", "kind", "score"), f"pii-patterns{step}")
        if step + 1 == rounds or scores.isEmpty():
            break
        wrong = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1.0 - F.col("score")))))
        guess = unknown.join(scores, ["pattern", "kind"]).groupBy("value", "kind").agg((1.0 - wrong).alias("belief"))
        values = unknown.join(guess, ["value", "kind"], "left").select("pattern", "value", "n", "kind", F.coalesce("belief", F.lit(0.0)).alias("belief"), F.lit(True).alias("open"))
        values = seeds.unionByName(values)
    return scores.filter(F.col("score") >= confident)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs (doc_id, text).

    Counts and digest are of base spans, which are never changed; ``spans`` adds those found by
    context.  Null and empty texts have none; repeated rows are reported alike; other columns are
    ignored; very long texts and texts of many matches are scanned whole; an empty table gives an empty
    result.
    """
    scanned = materialize(scan(docs), "pii-scan")
    edges = _edges(scanned)
    patterns = confident_patterns(edges, docs)
    new = edges.filter("kind is null").drop("kind").join(patterns, "pattern").filter(shaped(F.col("kind"), F.col("value")))
    new = new.groupBy("doc_id", "key", "b", "e").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    new = new.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("kind", "b", "e"))).alias("new"))
    new = materialize(new, "pii-new")
    rows = scanned.drop("token")
    if new.isEmpty():
        rows = rows.withColumn("new", F.lit(None).cast(new.schema["new"].dataType))
    else:
        rows = rows.join(new.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "new"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    base = F.flatten(F.array(*[_written(k, k) for k in KINDS]))
    every = F.flatten(F.array(*[F.transform(k, lambda s: F.struct(s["b"], s["e"])) for k in KINDS]))
    free = F.filter(F.coalesce("new", F.array().cast(new.schema["new"].dataType)), lambda n: ~F.exists("every", lambda s: (s["b"] < n["e"]) & (n["b"] < s["e"])))
    rows = rows.withColumn("base", base).withColumn("every", every)
    added = F.transform(free, lambda n: F.concat_ws(":", F.concat(F.lit("ctx_"), n["kind"]), n["b"].cast("string"), n["e"].cast("string")))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat("base", added), ",").alias("spans"),
    )
