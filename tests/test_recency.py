"""Recency bands at their bounds: the operator to the microsecond, the queries against their SQL."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.plans import catalog, decisions  # noqa: F401

T0 = datetime(2024, 1, 1)
TICK = timedelta(microseconds=1)


def test_bounds_are_inclusive_to_the_microsecond(spark):
    event = T0 + timedelta(seconds=9, microseconds=700_000)
    h = lambda n: timedelta(hours=n)
    lags = [(-h(1), "current"), (h(2), "current"), (h(2) + TICK, "recent"), (h(48), "recent"), (h(48) + TICK, "historical"), (h(48) + timedelta(seconds=0.4), "historical")]
    rows = [(event, event + lag, band) for lag, band in lags] + [(None, event, None), (event, None, None)]
    df = spark.createDataFrame(rows, "event timestamp_ntz, received timestamp_ntz, band string")
    got = df.select("band", C.recency(F.col("event"), F.col("received")).alias("found")).collect()
    assert [r.found for r in got] == [r.band for r in got]
    half = df.filter("received is not null and event is not null").select(F.sum((C.recency(F.col("event"), F.col("received"), 1.5, 2) == "recent").cast("int"))).first()
    assert half[0] == 1  # two hours sharp


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events that arrive 0 to 59 hours late, within a second of every hour, some without a time or an id."""
    offsets = [timedelta(0), TICK, timedelta(seconds=0.5), timedelta(seconds=1) - TICK, timedelta(seconds=1), timedelta(seconds=1) + TICK, timedelta(hours=1) - TICK]
    rows = [(60 * k + n, T0 + timedelta(days=k) + x) for k, x in enumerate(offsets) for n in (0, 1, 2, 3, 47, 48, 49, 59)]
    rows += [(-58, T0 + TICK), (-12, T0), (902, datetime(1960, 2, 3, 4) + TICK), (948, datetime(1960, 2, 3, 4) + TICK), (902, None), (None, T0), (None, None)]
    path = str(tmp_path_factory.mktemp("events"))
    data = [(i, ts, None if j % 9 == 8 else j, "view", float(j)) for j, (i, ts) in enumerate(rows)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return path


def same_as_sql(spark, path: str, name: str) -> None:
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, path)
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_counts_by_recency_at_the_bounds(spark, events):
    same_as_sql(spark, events, "counts_by_recency")


def test_recency_bands_at_the_bounds(spark, events):
    same_as_sql(spark, events, "recency_bands")
