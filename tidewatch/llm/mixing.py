"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, -ln(u) / quality, with u hashed from its id; documents of a
source are taken in key order.  A source's target is first spent on complete epochs (every document
once each), then the rest goes to the documents with the least keys whose sizes, summed in that
order, fill it.

No source is sorted as a whole.  The place where the running size meets the budget is found by radix:
sums by 4,096 ranges of the key, then by ranges inside the one range that is cut, until few rows are
left in it.  Equal keys go on by doc_id, then by a hash of the text.  Rows equal in all three have one
size and are counted, so that as many of them are taken as fit.  What remains is one cut point for each
source, and whether a document is taken is an expression on its own row.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, positional

#: A mixing recipe names its sources; more than this many is refused rather than sent to the driver.
MAX_SOURCES = 100_000
_LEVEL = 4096
#: Rows of a source in its cut bucket that are put in order, at most; beyond, the bucket is divided again.
DETAIL = 20_000
_KEY = ("_at", "_id", "_text")
_SYMBOLS = "#*$%&|<>!"


def quality(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: words over words and symbols; 1 for texts without words."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, _SYMBOLS, "")), F.lit(0))
    return F.when(size > 0, size / (size + symbols).cast("double")).otherwise(F.lit(1.0))


def position(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight in units of 2 ** -32, as a long."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.least(-F.log(u) / weight * float(1 << 32), F.lit(float(1 << 62))).cast("long")


def allot(sizes: dict[str | None, int], weights: Sequence[float], share: float, ceiling: float) -> dict[str | None, float]:
    """Target of each source: weights repeat over sources by code point (null last); what exceeds
    ceiling times a source's size goes to the others by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = dict(zip(names, cycle(weights)))
    left = share * sum(sizes.values())
    target: dict[str | None, float] = {}
    active = names
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > ceiling * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in active}
            break
        target |= {s: ceiling * sizes[s] for s in over}
        left -= sum(ceiling * sizes[s] for s in over)
        active = [s for s in active if s not in target]
    return target


class Mixture:
    """Sampling plan of a corpus (doc_id, text, source).

    Null text has size 0; null source is a source of its own; a null doc_id is hashed as such.  Rows
    with the same doc_id have one key if they have one quality, and are told apart by their texts; of
    equal rows as many are taken as the target allows.  Very long texts count with their whole size.  An
    empty table gives an empty mix.  Other columns pass through ``take``, whatever their names; ``counts`` leaves out
    a caller's column that has the name of one of its results.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0, seed: int = 0):
        self.seed = seed
        rows = materialize(self._placed(docs)[0].select(self._source(docs).alias("source"), "_size", *_KEY), "mixing-rows")
        totals = rows.groupBy("source").agg(F.sum("_size").alias("size")).limit(MAX_SOURCES + 1).collect()
        if len(totals) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.sizes = {r["source"]: r["size"] for r in totals}
        self.targets = allot(self.sizes, weights, share, ceiling)
        self.plan = self._cut(rows)

    @staticmethod
    def _source(docs: DataFrame) -> Column:
        return F.col(f"c{docs.columns.index('source')}").cast("string")

    def _placed(self, docs: DataFrame) -> tuple[DataFrame, list[str]]:
        """docs by position (names c0, c1, ...) with _size and the key, and the positional names."""
        rows = positional(docs)
        text, doc_id = (F.col(f"c{docs.columns.index(c)}") for c in ("text", "doc_id"))
        text = text.cast("string")
        placed = rows.withColumn("_size", n_words(text))
        return placed.withColumns({
            "_at": position(doc_id, quality(text, F.col("_size").cast("double")), self.seed),
            "_id": F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))),
            "_text": F.xxhash64(text),
        }), rows.columns

    @staticmethod
    def _cut_bucket(inside: DataFrame, bucket: Column, name: str) -> DataFrame:
        """The rows of each source in the one bucket where the running size passes rest, with what is left of rest."""
        sums = inside.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("_size").alias("size"))
        so_far = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        cut = sums.withColumn("end", so_far).filter((F.col("end") > F.col("rest")) & (F.col("end") - F.col("size") <= F.col("rest")))
        cut = materialize(cut.select(F.col("source").alias("goal_source"), "bucket", (F.col("rest") - F.col("end") + F.col("size")).alias("rest")), f"{name}-cut")
        same = F.col("source").eqNullSafe(F.col("goal_source")) & (bucket == F.col("bucket"))
        return materialize(inside.drop("rest").join(F.broadcast(cut), same).drop("goal_source", "bucket"), name)

    def _cut(self, rows: DataFrame) -> DataFrame:
        """(source, source_size, target, epochs, rest, cut, fits, ties): rows with keys below cut are taken, and fits of the ties rows at cut."""
        spark = rows.sparkSession
        table = [(s, int(self.sizes[s]), float(t), int(t // self.sizes[s]) if self.sizes[s] else 0) for s, t in self.targets.items()]
        # A row for each source, at most MAX_SOURCES of them: small enough to broadcast.
        goals = spark.createDataFrame(table, "source string, source_size long, target double, epochs int").withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        found = goals.filter("rest > 0").select(F.col("source").alias("goal_source"), "rest")
        inside = rows.join(F.broadcast(found), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
        # Keys are close to exponential, so the first buckets are about even.
        even = F.least(F.floor((1.0 - F.exp(F.col("_at") / -float(1 << 32))) * float(_LEVEL)), F.lit(_LEVEL - 1))
        inside = self._cut_bucket(inside, even, "mixing-0")
        for step in range(1, 60):
            # Later buckets divide what is left of each source, by the first part of the key that still differs.
            ends = [f(c).alias(f"{p}{c}") for c in _KEY for f, p in ((F.min, "lo"), (F.max, "hi"))]
            left = materialize(inside.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *ends), f"mixing-left{step}")
            differs = [F.col(f"lo{c}") < F.col(f"hi{c}") for c in _KEY]
            if left.filter((F.col("n") > DETAIL) & (differs[0] | differs[1] | differs[2])).isEmpty():
                break
            at, lo, hi = (F.coalesce(*[F.when(d, F.col(p + c)) for d, c in zip(differs, _KEY, strict=True)], F.lit(0)).cast("double") for p in ("", "lo", "hi"))
            bucket = F.floor((at - lo) / F.greatest(hi - lo, F.lit(1.0)) * float(_LEVEL))
            sides = left.drop("n").withColumnRenamed("source", "left_source")
            inside = inside.join(F.broadcast(sides), F.col("source").eqNullSafe(F.col("left_source"))).withColumn("_bucket", bucket)
            inside = self._cut_bucket(inside.select("source", "_size", *_KEY, "rest", "_bucket"), F.col("_bucket"), f"mixing-{step}").drop("_bucket")
        groups = inside.groupBy("source", "rest", F.struct(*_KEY).alias("cut")).agg(F.count(F.lit(1)).alias("ties"), F.max("_size").alias("size"))
        before = F.sum(F.col("ties") * F.col("size")).over(Window.partitionBy("source").orderBy("cut")) - F.col("ties") * F.col("size")
        groups = groups.withColumn("room", F.col("rest") - before)
        fits = F.when(F.col("size") == 0, F.when(F.col("room") >= 0, F.col("ties")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("ties"), F.floor(F.col("room") / F.col("size") + 0.5))))
        # The last key of which a row fits; if none does, the first key, with none.
        last = groups.withColumn("fits", fits.cast("long")).groupBy(F.col("source").alias("goal_source"))
        last = last.agg(F.max(F.when(F.col("fits") > 0, F.struct("cut", "fits", "ties"))).alias("some"), F.min(F.struct("cut", "fits", "ties")).alias("none"))
        last = last.select("goal_source", F.coalesce("some", "none").alias("x")).select("goal_source", "x.*")
        return materialize(goals.join(last, F.col("source").eqNullSafe(F.col("goal_source")), "left").drop("goal_source"), "mixing-plan")

    def counts(self, docs: DataFrame) -> DataFrame:
        """docs with size, source_size, target and copies (times that the mix takes the row)."""
        found = self._counted(docs)
        own = ["size", "source_size", "target", "copies"]
        return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in own], *own)

    def _counted(self, docs: DataFrame) -> DataFrame:
        """Columns of docs by position, with size, source_size, target and copies."""
        plan = F.broadcast(self.plan.withColumnRenamed("source", "plan_source"))
        placed, columns = self._placed(docs)
        placed = placed.join(plan, self._source(docs).eqNullSafe(F.col("plan_source")), "left")
        key = F.struct(*_KEY)
        split = (F.col("fits") > 0) & (F.col("fits") < F.col("ties"))
        whole = F.coalesce(((key < F.col("cut")) | ((key == F.col("cut")) & (F.col("fits") == F.col("ties")))).cast("int"), F.lit(0))
        out = [*columns, F.col("_size").alias("size"), "source_size", "target"]
        if self.plan.filter(split).isEmpty():
            return placed.select(*out, (F.col("epochs") + whole).alias("copies"))
        # Of equal rows at a cut only some fit: they are counted, numbered by their other columns, and dealt out again.
        at_cut = F.coalesce(split & (key == F.col("cut")), F.lit(False))
        tied = placed.filter(at_cut).groupBy(*columns, "_size", "source_size", "target", "epochs", "fits", "plan_source").agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("plan_source").orderBy(F.xxhash64(*columns)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        tied = tied.withColumn("_upto", upto).withColumn("_i", F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, F.col("_upto"))))
        tied = tied.select(*out, (F.col("epochs") + (F.col("_i") <= F.col("fits")).cast("int")).alias("copies"))
        return placed.filter(~at_cut).select(*out, (F.col("epochs") + whole).alias("copies")).unionByName(tied)

    def take(self, docs: DataFrame) -> DataFrame:
        """The mix: rows of docs, each as often as it is taken, with the columns of docs."""
        found = self._counted(docs).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
