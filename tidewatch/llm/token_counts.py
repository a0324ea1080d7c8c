"""Token counts as rollups kept up to date by signed deltas.

A ledger lives in a folder of the shared store:

* ``rollup/batch=<id>``: the signed change of (docs, tokens) by source, lang and tokenizer version;
* ``counts/batch=<id>``: the counts that the batch set, one row for each document and version (null
  tokens: deleted);
* ``snapshot/batch=<id>``: all counts in force after that batch, written every ``SNAPSHOT`` batches, so
  that a commit reads one snapshot and the batches since, not all batches ever.

Totals are the sums of all deltas, so a batch never rewrites what is there.  A batch names what it
changes; its delta is the new counts less those in force before it.  A batch is in force once its
marker in ``commits/batch=<id>`` is written, after both tables.  Committing an id again does nothing
if the marker is there, and replaces whatever a failed attempt left if it is not.  Ids rise: an id below
one in force is refused, as its delta would be taken against counts that came after it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, new_path

#: Tokenizer versions made of patterns, counted in the JVM.
TOKENIZERS = {
    "words-1": WORD,
    # runs of letters, single digits, and any other single character that is not white space
    "parts-2": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]",
}
#: Batches between two snapshots of the counts in force.
SNAPSHOT = 16

_IDENTITY = ("doc_id", "part", "version")
_COUNTS = "doc_id long, part long, version string, source string, lang string, docs long, tokens long"
_ROLLUP = "source string, lang string, version string, docs long, tokens long"


def count(text: Column, version: str) -> Column:
    """Number of tokens; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


def inserts(docs: DataFrame, versions: Iterable[str] = tuple(TOKENIZERS)) -> DataFrame:
    """Changes that set the counts of docs (doc_id, text, source, lang) under each version."""
    each = [F.struct(F.lit(v).alias("version"), count(F.col("text").cast("string"), v).alias("tokens")) for v in versions]
    rows = docs.select("doc_id", "source", "lang", F.explode(F.array(*each)).alias("x"))
    return rows.select("doc_id", "source", "lang", "x.version", "x.tokens")


class LateBatch(ValueError):
    """A batch whose id is below one in force."""


class TokenLedger:
    """Changes have columns doc_id, source, lang, version and tokens; null tokens deletes.

    A document is identified by doc_id and version, and by ``part`` if given (where rows that share a
    doc_id are documents of their own); nulls are values like others.  ``docs``, if given, is the number
    of equal documents that a row stands for, 1 otherwise; tokens are their sum.  Within a batch the last
    row wins, by ``seq`` if given and then by the largest (tokens, source, lang), a deletion being least;
    rows that repeat another change nothing.  A revision may move a document to another source or
    language.  Deleting what is not there changes nothing.  Other columns are ignored; an empty batch
    commits and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "token-ledger")

    def _read(self, name: str, schema: str, batches: Iterable[int]) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={b}" for b in sorted(batches)]
        if not paths:
            return self.spark.createDataFrame([], schema + ", batch long")
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema + ", batch long").parquet(*paths)

    def _marked(self, name: str) -> set[int]:
        """Ids with a marker; one row each."""
        try:
            rows = self.spark.read.schema("id long").parquet(f"{self.path}/{name}").distinct().collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return set()
            raise
        return {r["id"] for r in rows}

    def _mark(self, name: str, batch: int) -> None:
        self.spark.range(1).select(F.lit(batch).cast("long").alias("id")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def counts(self) -> DataFrame:
        """Counts in force: (doc_id, part, version, source, lang, docs, tokens)."""
        whole = max(self._marked("snapshots"), default=None)
        since = [b for b in self._marked("commits") if whole is None or b > whole]
        rows = self._read("counts", _COUNTS, since)
        if whole is not None:
            rows = rows.unionByName(self._read("snapshot", _COUNTS, [whole]))
        last = rows.groupBy(*_IDENTITY).agg(F.max_by(F.struct("source", "lang", "docs", "tokens"), "batch").alias("x"))
        return last.select(*_IDENTITY, "x.*").filter("tokens is not null")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch of changes once; False if it was in force already.  LateBatch if a later one is."""
        done = self._marked("commits")
        if batch in done:
            return False
        if done and batch < max(done):
            raise LateBatch(f"batch {batch} comes after {max(done)} is in force")
        order = [F.col("seq").desc_nulls_last()] if "seq" in changes.columns else []
        order += [F.col(c).desc_nulls_last() for c in ("tokens", "source", "lang")]
        rank = F.row_number().over(Window.partitionBy(*_IDENTITY).orderBy(*order))
        new = changes.withColumns({c: F.col(c) if c in changes.columns else F.lit(d) for c, d in (("part", 0), ("docs", 1))})
        new = new.withColumn("_rank", rank).filter("_rank = 1")
        new = new.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in _COUNTS.split(", ")])
        new.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/counts/batch={batch}")
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/counts/batch={batch}")
        signed = new.filter("tokens is not null").withColumn("sign", F.lit(1))
        if done:
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in _IDENTITY]
            old = self.counts().alias("o").join(new.select(*_IDENTITY).alias("n"), same[0] & same[1] & same[2], "left_semi")
            signed = signed.unionByName(old.withColumn("sign", F.lit(-1)))
        delta = signed.groupBy("source", "lang", "version").agg(F.sum(F.col("sign") * F.col("docs")).alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        delta.filter("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/rollup/batch={batch}")
        self._mark("commits", batch)
        if (len(done) + 1) % SNAPSHOT == 0:
            self.snapshot()
        return True

    def snapshot(self) -> None:
        """Write down all counts in force; readers use it once its marker is there."""
        last = max(self._marked("commits"), default=None)
        if last is not None and last not in self._marked("snapshots"):
            self.counts().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/snapshot/batch={last}")
            self._mark("snapshots", last)

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all batches in force."""
        rows = self._read("rollup", _ROLLUP, self._marked("commits")).drop("batch")
        sums = rows.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")


def corpus_counts(docs: DataFrame) -> DataFrame:
    """Totals of a corpus after it is loaded, revised and loaded again.

    Batch 1 inserts all documents.  Batch 2 recounts all without symbols (revising those whose counts
    change) and deletes the documents that have no letter.  Batch 1 is then replayed, to no effect.

    Every row counts: rows that share a doc_id, or have none, are told apart by a hash of their other
    columns, and rows equal in all of them are counted as often as they are there.
    """
    ledger = TokenLedger(docs.sparkSession)
    text = F.col("text").cast("string")
    clean = F.translate(text, "#*$%&|<>", "")
    each = [F.struct(F.lit(v).alias("version"), count(text, v).alias("tokens"), count(clean, v).alias("revised")) for v in TOKENIZERS]
    gone = ~F.coalesce(clean.rlike("[A-Za-z]"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source", "lang", text).alias("part"), "source", "lang", gone.alias("gone"), F.explode(F.array(*each)).alias("x"))
    counted = rows.select("doc_id", "part", "source", "lang", "gone", "x.*").groupBy("doc_id", "part", "source", "lang", "gone", "version")
    first = materialize(counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum("revised").alias("revised")), "token-changes")
    ledger.commit(1, first)
    changes = first.filter("gone or revised <> tokens").withColumn("tokens", F.when(~F.col("gone"), F.col("revised")))
    ledger.commit(2, changes)
    ledger.commit(1, first)
    return ledger.totals()
