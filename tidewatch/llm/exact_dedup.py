"""Exact deduplication as a stateful stream over a disk-backed (RocksDB) state store.

A first stream hashes every text once and keeps (digest, doc_id, locator) of each row as files.  A second,
stateful stream takes those in several micro-batches: its state, keyed by the SHA-256 of the normalised
text, holds for each distinct text the identifier and content locator of the row that stays and the number
of rows, and never expires (no watermark).  Each micro-batch writes its changed keys under its batch id, so
a batch that is run again after a failure replaces its own output.  Rows whose digest was seen more than
once are read again by their locators, and their full normalised bytes are compared: the least and the
greatest text of a digest are equal if all are, which needs no group in one task.  Texts that share a
digest but differ are told apart.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path

#: Up to so many digests or rows seen twice (a few hundred bytes each) are broadcast to find their rows; beyond, a shuffled join.
BROADCAST_DIGESTS = 100_000
#: Micro-batches that the files of one feed are dealt over.
BATCHES = 3

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: no disk is set aside ahead of use.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normal(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def with_locator(rows: DataFrame) -> DataFrame:
    """(doc_id, text, locator) of rows read from files: file and row number."""
    locator = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", locator.alias("locator"))


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "locator", normal(F.col("text")).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))


class ExactDedup:
    """Keeps, of equal texts, the row with the largest doc_id (the largest locator among equals).

    A null doc_id ranks lowest; a group of such rows keeps one and has a null keep_id.  Null text
    counts as empty, and empty texts are equal to each other.  Other columns are ignored.
    """

    def __init__(self, spark: SparkSession, state_dir: str | None = None):
        self.spark = spark
        self.dir = state_dir or new_path(spark, "exact-dedup")

    def feed(self, stream: DataFrame) -> None:
        """Take in all rows (doc_id, text, locator) that the stream has now; may be called again later."""
        hashed = _digest(stream).select("digest", "doc_id", "locator")
        hashed.writeStream.format("parquet").option("path", self._digests).option("checkpointLocation", f"{self.dir}/hashing").trigger(availableNow=True).start().awaitTermination()
        rows = self.digests()
        files = max(1, -(-len(rows.inputFiles()) // BATCHES))
        best = F.max(F.struct("doc_id", "locator"))
        seen = self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(self._digests)
        state = seen.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        updates = f"{self.dir}/updates"

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={batch_id}")

        before = {k: self.spark.conf.get(k, None) for k in _ROCKS}
        try:
            for k, v in _ROCKS.items():
                self.spark.conf.set(k, v)
            run = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.dir}/checkpoint").foreachBatch(save).trigger(availableNow=True).start()
            run.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    @property
    def _digests(self) -> str:
        return f"{self.dir}/digests"

    def digests(self) -> DataFrame:
        """(digest, doc_id, locator) of every row fed so far."""
        return self.spark.read.schema("digest binary, doc_id long, locator string").parquet(self._digests)

    def state(self) -> DataFrame:
        """(digest, keep_id, keep_at, group_size): the last state of each digest."""
        rows = self.spark.read.schema("digest binary, best struct<doc_id: long, locator: string>, group_size long, batch long").parquet(f"{self.dir}/updates")
        last = rows.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s"))
        return last.select("digest", F.col("s.best.doc_id").alias("keep_id"), F.col("s.best.locator").alias("keep_at"), F.col("s.group_size").alias("group_size"))

    @staticmethod
    def _beside(rows: DataFrame, side: DataFrame, on: str, how: str) -> DataFrame:
        """A join with a table that is broadcast while it has at most BROADCAST_DIGESTS rows."""
        return rows.join(F.broadcast(side) if side.count() <= BROADCAST_DIGESTS else side, on, how)

    def differing(self, rows: DataFrame, repeated: DataFrame) -> DataFrame:
        """Rows whose bytes differ from those kept under their digest (a collision; none are expected)."""
        hits = materialize(self._beside(self.digests(), repeated, "digest", "inner").select("locator", "digest", "keep_at"), "dedup-hits")
        texts = self._beside(rows.select("doc_id", "locator", normal(F.col("text")).alias("body")), hits, "locator", "inner")
        apart = texts.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest")).filter("least <> greatest").select("digest")
        apart = materialize(apart, "dedup-apart")
        if apart.isEmpty():
            return texts.filter(F.lit(False)).select("digest", "doc_id", "locator", "body")
        texts = materialize(self._beside(texts, apart, "digest", "inner"), "dedup-apart-texts")
        kept = texts.filter(F.col("locator") == F.col("keep_at")).select("digest", F.col("body").alias("kept_body"))
        return texts.join(kept, "digest").filter(F.col("body") != F.col("kept_body")).select("digest", "doc_id", "locator", "body")

    def result(self, rows: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of every row fed so far; rows: the same (doc_id, text, locator)."""
        repeated = materialize(self.state().filter("group_size > 1"), "dedup-repeated")
        # A digest seen once needs no look at the state: its only row stays.
        found = self._beside(self.digests(), repeated, "digest", "left")
        one = F.col("group_size").isNull()
        plain = found.select("doc_id", "locator", "digest", *[F.when(one, F.col(c)).otherwise(F.col(k)).alias(k) for c, k in (("doc_id", "keep_id"), ("locator", "keep_at"))], F.coalesce("group_size", F.lit(1)).alias("group_size"))
        differing = materialize(self.differing(rows, repeated), "dedup-differing")
        if not differing.isEmpty():
            group = Window.partitionBy("digest", "body")
            best = F.max(F.struct("doc_id", "locator")).over(group)
            size = F.count(F.lit(1)).over(group)
            fixed = differing.select("digest", "doc_id", "locator", best["doc_id"].alias("keep_id"), best["locator"].alias("keep_at"), size.alias("group_size"))
            lost = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("others"))
            plain = plain.join(differing.select("locator"), "locator", "left_anti").join(lost, "digest", "left")
            plain = plain.withColumn("group_size", F.col("group_size") - F.coalesce("others", F.lit(0))).drop("others")
            plain = plain.unionByName(fixed)
        return plain.select("doc_id", "keep_id", "group_size", (F.col("locator") == F.col("keep_at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_files(spark: SparkSession, path: str, state_dir: str | None = None) -> DataFrame:
    """Stream the Parquet files under path through ``ExactDedup`` and return its result."""
    batch = spark.read.parquet(path)
    dedup = ExactDedup(spark, state_dir)
    # As a pattern, the path may be a single file as well as a folder.
    dedup.feed(with_locator(spark.readStream.schema(batch.schema).parquet(f"{path[:-1]}[{path[-1]}]")))
    return dedup.result(with_locator(batch))
