"""Paced replay of a stored feed, as a streaming source.

``number_feed`` gives the rows of a feed their place once, by Spark: blocks of rows in file order, each row with its
number and the number of accepted rows up to it.  ``ReplaySource`` then streams them.  An offset is a row number, and
how far it may go is a function of the clock alone: accepted rows are due one after the other, ``interval`` / ``speed``
seconds apart from the start on, and rejected rows come with the accepted row before them.  So a query that is
started again from its checkpoint repeats and loses nothing; what came due meanwhile comes at once.  A row's
``received_time`` is when it was due, and the same in every run.
"""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Iterator

import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Rows of a block: what one task of a batch reads, at least.
BLOCK = 100_000
_OWN = ("row", "accepted", "accepted_upto")


def number_feed(feed: DataFrame, path: str, accepted: Column, block: int = BLOCK) -> None:
    """Write feed, in file order, under path: blocks of numbered rows, and a manifest with a row for each block.

    feed: rows read from files (``feeds.read_feed``); accepted says whether a row is good, as limits and pacing count
    good rows only.  Rows are ordered by range, so no task holds more than its part.
    """
    names = feed.columns
    spark = feed.sparkSession
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    rows = feed.withColumn("_at", at).withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    parts = rows.repartitionByRange("_at").sortWithinPartitions("_at").withColumn("_part", F.spark_partition_id())
    parts.write.parquet(f"{path}/ordered")
    ordered = spark.read.parquet(f"{path}/ordered")
    mine = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.count_if("accepted").alias("_good"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_good").over(before), F.lit(0)).alias("_goods"))
    numbered = ordered.join(F.broadcast(sizes), "_part").select(
        *names, "accepted", (F.col("_rows") + F.count(F.lit(1)).over(mine) - 1).alias("row"), (F.col("_goods") + F.count_if("accepted").over(mine)).alias("accepted_upto")
    )
    numbered.withColumn("block", F.expr(f"row div {block}")).repartition("block").sortWithinPartitions("row").write.partitionBy("block").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks").groupBy(F.col("block").cast("long").alias("block")).agg(F.min("row").alias("first"), F.max("row").alias("last"), (F.min("accepted_upto") - F.min_by("accepted", "row").cast("long")).alias("before"), F.max("accepted_upto").alias("upto"))
    blocks.orderBy("block").coalesce(1).write.parquet(f"{path}/manifest")


def _table(path: str):
    """A Parquet folder on any file system that pyarrow reads."""
    files, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return pq.read_table(inner, filesystem=files, partitioning=None)


class _Rows(InputPartition):
    def __init__(self, block: int, first: int, stop: int):
        super().__init__((block, first, stop))


class ReplayReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict):
        self.names = [f.name for f in schema.fields]
        self.path = options["path"].rstrip("/")
        self.limit = int(options["limit"]) if options.get("limit") else None
        interval, speed = float(options.get("interval", 1.0)), float(options.get("speed", 0.0))
        if interval < 0 or speed < 0 or (self.limit is not None and self.limit < 0):
            raise ValueError("interval, speed and limit must not be negative")
        self.delay = interval / speed if speed else 0.0
        self.start = float(options["start"])
        self.clock = options.get("clock")
        self.blocks = sorted(_table(f"{self.path}/manifest").to_pylist(), key=lambda b: b["block"])

    def now(self) -> float:
        """The time of day; or, for tests, the number in the file that the option ``clock`` names."""
        if not self.clock:
            return time.time()
        with open(self.clock) as f:
            return float(f.read())

    def due(self, now: float) -> int:
        """The row before which everything is due: up to the last accepted row that is, and the rejected ones right after it.

        Once the limit is reached nothing more comes, not even rejected rows.
        """
        if not self.blocks:
            return 0
        total = self.blocks[-1]["upto"]
        good = total if not self.delay else min(total, max(0, math.floor((now - self.start) / self.delay + 1e-9)))
        if self.limit is not None and good >= self.limit:
            return self._after(self.limit)
        return self.blocks[-1]["last"] + 1 if good == total else self._after(good + 1) - 1

    def _after(self, good: int) -> int:
        """The row after accepted row number good (from 1); row 0 for none."""
        if good <= 0:
            return 0
        b = next((b for b in self.blocks if b["upto"] >= good), None)
        if b is None:
            return self.blocks[-1]["last"] + 1
        t = _table(f"{self.path}/blocks/block={b['block']}")
        rows = sorted(r for r, ok, n in zip(*(t[c].to_pylist() for c in ("row", "accepted", "accepted_upto")), strict=True) if ok and n == good)
        return rows[0] + 1

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": self.due(self.now())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["row"], end["row"]
        return [_Rows(x["block"], max(a, x["first"]), min(b, x["last"] + 1)) for x in self.blocks if x["first"] < b and x["last"] >= a]

    def read(self, partition: InputPartition) -> Iterator:
        block, first, stop = partition.value
        t = _table(f"{self.path}/blocks/block={block}")
        numbers = t["row"].to_numpy()
        t = t.filter((numbers >= first) & (numbers < stop)).sort_by("row")
        # An accepted row is received when it is due; a rejected one with the accepted row before it.
        at = [int((self.start + n * self.delay) * 1e6) for n in t["accepted_upto"].to_pylist()]
        import pyarrow as pa

        t = t.append_column("received_time", pa.array(at, pa.timestamp("us", tz="UTC")))
        yield from t.select(self.names).to_batches()

    def commit(self, end: dict) -> None:
        pass


class ReplaySource(DataSource):
    """``spark.readStream.format("tidewatch-replay")``; options path, start (epoch seconds), interval, speed, limit, clock, columns (a DDL of the feed's columns)."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch-replay"

    def schema(self) -> str:
        return f"{self.options['columns']}, row long, accepted boolean, accepted_upto long, received_time timestamp"

    def streamReader(self, schema) -> ReplayReader:
        return ReplayReader(schema, dict(self.options))


def replay(spark: SparkSession, path: str, interval: float = 1.0, speed: float = 0.0, limit: int | None = None, clock: str | None = None, start: float | None = None) -> DataFrame:
    """The numbered feed under path as a stream: its columns, row, accepted, accepted_upto and received_time.

    speed 0 gives everything out at once; limit counts accepted rows.  The start is kept beside the feed when a
    replay begins, so that a later run goes on by the same clock.
    """
    spark.dataSource.register(ReplaySource)
    fields = spark.read.parquet(f"{path}/blocks").drop("block", *_OWN).dtypes
    begun = spark.read.text(f"{path}/started").first()[0] if _exists(spark, f"{path}/started") else None
    if begun is None:
        begun = json.dumps(time.time() if start is None else start)
        spark.createDataFrame([(begun,)], "value string").coalesce(1).write.text(f"{path}/started")
    options = {"path": path, "columns": ", ".join(f"`{c}` {t}" for c, t in fields), "start": begun, "interval": interval, "speed": speed} | ({"limit": limit} if limit is not None else {}) | ({"clock": os.path.abspath(clock)} if clock else {})
    return spark.readStream.format("tidewatch-replay").options(**options).load()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
