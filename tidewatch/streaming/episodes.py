"""Drift episodes and duplicate links of a stream, by event time.

Both keep what came until the watermark has passed it, and only then act on it, in the order of event time.  So rows
that come late (within the watermark's delay), or in another order, or dealt over other triggers, give what a batch
over the same rows gives.  State is in RocksDB, with event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.integrity import KEY
from ..operators.monitoring import EPISODES, EpisodeFold

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FOLD = "episode_id string, onset timestamp, last_seen timestamp, events long, peak double, kinds array<string>, candidates long, last_candidate timestamp"
_NAMES = [c.split()[0] for c in EPISODES.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and typed state need this provider; it is a setting of the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _stamp(x):
    return None if x is None or pd.isna(x) else pd.Timestamp(x)


def _plain(x):
    return None if x is None or pd.isna(x) else pd.Timestamp(x).to_pydatetime()


def _millis(x) -> int:
    return int(pd.Timestamp(x).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(x).tzinfo is None else int(pd.Timestamp(x).timestamp() * 1000)


class EpisodeProcessor(StatefulProcessor):
    """Evaluations of one stream wait under their instant until the watermark passes it; then they are folded in order."""

    def __init__(self, required: tuple[str, ...], cooldown_days: int):
        self.required, self.cooldown_days = required, cooldown_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "detected_at timestamp, kinds array<string>, magnitude double")
        self.folded = handle.getValueState("fold", _FOLD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples():
                at = _millis(r.detected_at)
                self.waiting.updateValue((at,), (_plain(r.detected_at), list(r.kinds), None if pd.isna(r.magnitude) else float(r.magnitude)))
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(((k[0], tuple(v)) for k, v in self.waiting.iterator() if k[0] <= until), key=lambda x: x[0])
        if not due:
            return iter([])
        f = EpisodeFold(self.cooldown_days, self.required)
        if self.folded.exists():
            ident, onset, last, n, peak, kinds, raised, candidate = self.folded.get()
            f.last_candidate = _stamp(candidate)
            if ident is not None:
                f.open = {"episode_id": ident, "onset": _stamp(onset), "last_seen": _stamp(last), "closed_at": None, "events": n, "peak": peak, "kinds": list(kinds), "candidates": raised}
        for at, (moment, kinds, magnitude) in due:
            f.observe(pd.Timestamp(moment), list(kinds), magnitude)
            self.waiting.removeKey((at,))
        e = f.open
        self.folded.update((e["episode_id"], _plain(e["onset"]), _plain(e["last_seen"]), int(e["events"]), float(e["peak"]), list(e["kinds"]), int(e["candidates"]), _plain(f.last_candidate)) if e else (None, None, None, 0, 0.0, [], 0, _plain(f.last_candidate)))
        rows = [{"stream": key[0], **x} for x in [*f.done, *([e] if e else [])]]
        return iter([pd.DataFrame(rows, columns=_NAMES)]) if rows else iter([])

    def close(self) -> None:
        pass


def stream_episodes(evaluations: DataFrame, required: tuple[str, ...] = ("prediction",), cooldown_days: int = 28, late: str = "7 days") -> DataFrame:
    """Episodes of a stream of evaluations (stream, detected_at, kinds, magnitude), each as it grows and once it is closed.

    An evaluation is folded when the watermark, late behind the newest evaluation, has passed it; one that comes later
    than that is dropped.  The last row of (stream, episode_id) is the episode.
    """
    use_rocksdb(evaluations.sparkSession)
    rows = evaluations.select("stream", "detected_at", "kinds", F.col("magnitude").cast("double").alias("magnitude")).withWatermark("detected_at", late)
    return rows.groupBy("stream").transformWithStateInPandas(EpisodeProcessor(required, cooldown_days), EPISODES, "Update", "EventTime")


LINKS = "observation_id string, representative_id string, received_time timestamp, members long"


class LinkProcessor(StatefulProcessor):
    """Observations of one key wait until the watermark passes their event time; the first received then represents them all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getMapState("members", "observation_id string", "received_time timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples():
                self.members.updateValue((r.observation_id,), (_plain(r.received_time),))
            if len(pdf):
                self.handle.registerTimer(_millis(pdf["event_time"].max()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = sorted((v[0], k[0]) for k, v in self.members.iterator())
        for _, ident in found:
            self.members.removeKey((ident,))
        if not found:
            return iter([])
        first = found[0][1]
        return iter([pd.DataFrame([{"observation_id": i, "representative_id": first, "received_time": t, "members": len(found)} for t, i in found])])

    def close(self) -> None:
        pass


def stream_links(observations: DataFrame, late: str = "48 hours") -> DataFrame:
    """(observation_id, representative_id, received_time, members) of every observation, once its key is complete.

    A key is complete when the watermark passes its event time: all that share it have come, or are too late.
    """
    use_rocksdb(observations.sparkSession)
    keys = [c for c in KEY if c in observations.columns]
    rows = observations.withWatermark("event_time", late)
    same = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in keys]).alias("key")
    return rows.select(same, "observation_id", "received_time", "event_time").groupBy("key").transformWithStateInPandas(LinkProcessor(), LINKS, "Append", "EventTime")
