"""Structured Streaming: replay, quarantine split, tumbling drift windows, stateful episodes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.integrity import KEY
from ..operators.monitoring import EPISODES, EpisodeFold


def tumbling(stream: DataFrame, days: int = 7, anchor: str = "2024-01-01 00:00:00", late_hours: int = 48) -> DataFrame:
    """Counts and means of tumbling windows anchored at a replay's start (not at the epoch's Thursday).

    Rows more than late_hours late are dropped by the watermark: split them off with ``late_split`` before.
    """
    shift = int(pd.Timestamp(anchor).timestamp()) % (86400 * days)
    w = F.window("event_time", f"{days} days", f"{days} days", f"{shift} seconds")
    return stream.withWatermark("event_time", f"{late_hours} hours").groupBy("location_id", w).agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean_value"))


def late_split(rows: DataFrame, late_hours: int = 48) -> tuple[DataFrame, DataFrame]:
    """(on time, historical) by arrival lag, so that a stateful operator never drops rows silently."""
    late = F.unix_seconds("received_time") - F.unix_seconds("event_time") > 3600 * late_hours
    return rows.filter(~late), rows.filter(late)


def representatives(stream: DataFrame, late_hours: int = 48) -> DataFrame:
    """First arrival of each observation key within the watermark; links between duplicates come from the batch path."""
    return stream.withWatermark("event_time", f"{late_hours} hours").dropDuplicatesWithinWatermark([c for c in KEY if c in stream.columns])


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, batch by batch; a batch that is repeated replaces its own output."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append to path what a source has now, for sources that know no availableNow trigger."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def split_to_end(stream: DataFrame, valid: str, quarantine: str, checkpoint: str) -> None:
    """Run a parsed stream (column error), writing good and bad rows to two places."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.filter("error is null").write.mode("overwrite").parquet(f"{valid}/batch={batch_id}")
        batch.filter("error is not null").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


_STATE = "episode_id string, onset timestamp, last_seen timestamp, events long, peak double, kinds array<string>, candidates long, last_candidate timestamp"


def stream_episodes(evaluations: DataFrame, required: tuple[str, ...] = ("prediction",), cooldown_days: int = 28) -> DataFrame:
    """Episodes of evaluations (stream, detected_at, kinds, magnitude) as they close or grow; the fold is the batch one.

    State holds the open episode and the last candidate, so a cooldown outlives the episode that began it.
    """
    stamp = lambda x: None if x is None or pd.isna(x) else pd.Timestamp(x)
    plain = lambda x: None if x is None or pd.isna(x) else x.to_pydatetime()
    names = [c.split()[0] for c in EPISODES.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = EpisodeFold(cooldown_days, required)
        if state.exists:
            ident, onset, last, n, peak, kinds, raised, candidate = state.get
            f.last_candidate = stamp(candidate)
            if ident is not None:
                f.open = {"episode_id": ident, "onset": stamp(onset), "last_seen": stamp(last), "closed_at": None, "events": n, "peak": peak, "kinds": list(kinds), "candidates": raised}
        # The rows of one stream in one trigger: a few instants, in any order over the batches.
        for r in pd.concat(list(batches)).sort_values("detected_at").itertuples():
            f.observe(r.detected_at, r.kinds, r.magnitude)
        e = f.open
        if e:
            state.update((e["episode_id"], plain(e["onset"]), plain(e["last_seen"]), int(e["events"]), float(e["peak"]), list(e["kinds"]), int(e["candidates"]), plain(f.last_candidate)))
        else:
            state.update((None, None, None, 0, 0.0, [], 0, plain(f.last_candidate)))
        yield pd.DataFrame([{"stream": key[0], **x} for x in [*f.done, *([e] if e else [])]], columns=names)

    return evaluations.groupBy("stream").applyInPandasWithState(fold, EPISODES, _STATE, "update", GroupStateTimeout.NoTimeout)


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a file stream of observations; a single file or a folder."""
    batch = spark.read.parquet(path)
    rows = spark.readStream.schema(batch.schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.select(
        F.col("ts").cast("timestamp").alias("event_time"), "value",
        F.concat(F.lit("ZONE-"), F.substring(F.lit("ABCD"), (F.col("user_id") % 4).cast("int") + 1, F.lit(1))).alias("location_id"), F.col("event_type").alias("metric"),
    )
