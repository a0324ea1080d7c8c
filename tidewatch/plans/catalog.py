"""Every registered query of the sensor engine, with its SQL oracle.

Doubles are rounded on both sides, since sums of floating-point numbers depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluation, features, integrity, monitoring, patterns, statistics
from ..sources import feeds
from ..streaming import streams
from .observations import OBS_SQL, observations, recency_band

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OFFSET = 5.5


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def r(c: str | Column, places: int = 7) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, places)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    return C.seconds(F.col(c))


def local_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with local hour, weekday and month, and the rain of the hour (mean purchase value over 100)."""
    obs = observations(spark, sf_dir)
    local = C.local_time(F.col("event_time"), OFFSET)
    return obs.withColumns({"hour": F.hour(local), "weekday": F.weekday(local)})


LOCAL_SQL = f"""{OBS_SQL},
loc AS (SELECT *, CAST(hour(event_time + INTERVAL 330 MINUTE) AS INTEGER) AS hour, CAST(isodow(event_time + INTERVAL 330 MINUTE) - 1 AS INTEGER) AS weekday FROM obs)"""
HOURLY_SQL = f"""{OBS_SQL},
hourly AS (SELECT location_id, event_time, avg(value) AS value FROM obs GROUP BY ALL)"""
FORECAST_SQL = f"""{HOURLY_SQL},
fc AS (SELECT a.location_id, a.event_time, a.value AS actual, b.value AS predicted FROM hourly a
  LEFT JOIN hourly b ON a.location_id = b.location_id AND b.event_time = a.event_time - INTERVAL 1 HOUR)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.hourly(observations(spark, sf_dir))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last-value forecast: the value of exactly an hour before."""
    rows = features.lag_features(hourly(spark, sf_dir), (1,))
    return rows.select("location_id", "event_time", F.col("value").alias("actual"), F.col("lag_1h").alias("predicted"))


_GROUPS_SQL = f"""{OBS_SQL},
g AS (SELECT location_id, metric, event_time, count(*) AS members, count(DISTINCT source_id) AS sources, min(value) AS lo, max(value) AS hi,
  arg_min(observation_id, (received_time, observation_id)) AS representative_id,
  coalesce(max(value) - min(value) > greatest(0.5, 0.05 * max(abs(value))), false) AS dissent FROM obs GROUP BY ALL),
k AS (SELECT *, CASE WHEN members = 1 THEN 'unified' WHEN dissent THEN 'conflicted' ELSE 'duplicate' END AS placement FROM g)"""
_PLACED_SQL = f"""{_GROUPS_SQL},
p AS (SELECT o.*, k.representative_id, k.members, CASE WHEN k.placement = 'conflicted' THEN 'conflicted' WHEN o.observation_id = k.representative_id THEN 'unified' ELSE 'duplicate_linked' END AS placement
  FROM obs o JOIN k USING (location_id, metric, event_time))"""


@query("reconcile_placement", f"WITH {_PLACED_SQL} SELECT placement, count(*) AS observations, count(DISTINCT source_id) AS sources, round(sum(value), 2) AS total FROM p GROUP BY placement")
def _placement(spark, sf):
    placed = integrity.place(observations(spark, sf))
    return placed.groupBy("placement").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("source_id").alias("sources"), r(F.sum("value"), 2).alias("total"))


@query("duplicate_groups", f"WITH {_GROUPS_SQL} SELECT location_id, metric, CAST(epoch(event_time) AS BIGINT) AS event_s, members, sources, representative_id, CASE WHEN sources = 1 THEN 'same_source_repeat' ELSE 'cross_source_agreement' END AS kind FROM k WHERE placement = 'duplicate'")
def _duplicates(spark, sf):
    return integrity.key_groups(observations(spark, sf)).filter("placement = 'duplicate'").select("location_id", "metric", micros("event_time").alias("event_s"), "members", "sources", "representative_id", "kind")


@query("conflict_groups", f"WITH {_GROUPS_SQL} SELECT location_id, metric, CAST(epoch(event_time) AS BIGINT) AS event_s, members, sources, sources > 1 AS cross_source, round(hi - lo, 7) AS spread FROM k WHERE placement = 'conflicted'")
def _conflicts(spark, sf):
    g = integrity.key_groups(observations(spark, sf)).filter("placement = 'conflicted'")
    return g.select("location_id", "metric", micros("event_time").alias("event_s"), "members", "sources", (F.col("sources") > 1).alias("cross_source"), r("spread").alias("spread"))


@query("conservation_check", f"WITH {_PLACED_SQL} SELECT count(*) AS rows_in, count(DISTINCT observation_id) AS distinct_ids, count(*) FILTER (placement = 'unified') + count(*) FILTER (placement = 'duplicate_linked') + count(*) FILTER (placement = 'conflicted') = count(*) AS conserved FROM p")
def _conservation(spark, sf):
    p = integrity.place(observations(spark, sf))
    parts = sum((F.count_if(F.col("placement") == x) for x in ("duplicate_linked", "conflicted")), F.count_if(F.col("placement") == "unified"))
    return p.agg(F.count(F.lit(1)).alias("rows_in"), F.count_distinct("observation_id").alias("distinct_ids"), (parts == F.count(F.lit(1))).alias("conserved"))


@query("placement_by_kind", f"WITH {_GROUPS_SQL} SELECT coalesce(CASE WHEN placement = 'duplicate' THEN CASE WHEN sources = 1 THEN 'same_source_repeat' ELSE 'cross_source_agreement' END END, placement) AS kind, count(*) AS groups FROM k GROUP BY 1")
def _by_kind(spark, sf):
    return integrity.key_groups(observations(spark, sf)).groupBy(F.coalesce("kind", "placement").alias("kind")).agg(F.count(F.lit(1)).alias("groups"))


def _feed(spark, sf) -> DataFrame:
    """A dirty text feed derived from the events: bad stamps, missing offsets, bad numbers, empty ids."""
    e = table(spark, sf, "events")
    stamp = F.date_format(F.col("ts") + F.expr("INTERVAL 330 MINUTE"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 97
    return e.select(
        F.when(k == 1, "").otherwise(F.concat(F.lit("R"), F.col("event_id").cast("string"))).alias("record_id"),
        F.when(k == 2, "not-a-stamp").when(k == 3, stamp).otherwise(F.concat(stamp, F.lit("+05:30"))).alias("interval_end_local"),
        F.when(k == 4, " ").otherwise("ZONE-A").alias("location_id"),
        F.col("event_type").alias("metric"),
        F.when(k == 5, "abc").when(k == 6, "").otherwise(F.col("value").cast("decimal(12,2)").cast("string")).alias("value"),
        F.when(k == 7, "furlong").otherwise("km/h").alias("unit"),
    )


@query("parse_feed", """
WITH f AS (SELECT event_id % 97 AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, round(value, 2) AS v FROM events),
x AS (SELECT k, s, v, CASE WHEN k = 1 THEN 'schema_error' WHEN k IN (2, 3) THEN 'invalid_timestamp' WHEN k = 4 THEN 'schema_error' WHEN k = 7 THEN 'unknown_unit' WHEN k = 5 THEN 'invalid_value' ELSE 'ok' END AS outcome FROM f)
SELECT outcome, count(*) AS rows, count(*) FILTER (outcome = 'ok' AND k = 6) AS missing,
       CAST(sum(CASE WHEN outcome = 'ok' THEN (round_even((s + 19800) / 3600.0, 0) * 3600 - 19800 - 3600) END) AS BIGINT) AS event_seconds FROM x GROUP BY outcome""")
def _parse(spark, sf):
    parsed = integrity.parse_feed(_feed(spark, sf), 60, OFFSET, ["km/h"])
    return parsed.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("error").isNull() & F.col("number").isNull()).alias("missing"), F.sum(F.when(F.col("error").isNull(), micros("event_time"))).alias("event_seconds")
    )


@query("snap_interval", f"WITH {OBS_SQL} SELECT CAST(round_even((epoch(source_time) + 19800) / 900.0, 0) * 900 - 19800 AS BIGINT) AS start_s, count(*) AS rows FROM obs GROUP BY 1")
def _snap(spark, sf):
    return observations(spark, sf).groupBy(C.seconds(C.snap(F.col("source_time"), 15, OFFSET)).alias("start_s")).agg(F.count(F.lit(1)).alias("rows"))


@query("range_quarantine", f"""WITH {OBS_SQL}, x AS (SELECT *, CASE WHEN CAST(substr(observation_id, 5) AS BIGINT) % 97 = 0 THEN NULL WHEN CAST(substr(observation_id, 5) AS BIGINT) % 89 = 0 THEN -value ELSE value END AS v FROM obs)
SELECT metric, coalesce(CASE WHEN v < 0 THEN 'negative' WHEN v < 5 THEN 'below_minimum' WHEN v > 400 THEN 'above_maximum' END, 'valid') AS outcome, count(*) AS rows FROM x GROUP BY ALL""")
def _ranges(spark, sf):
    k = F.expr("cast(substr(observation_id, 5) as bigint)")
    v = F.when(k % 97 == 0, None).when(k % 89 == 0, -F.col("value")).otherwise(F.col("value"))
    reason = C.range_check(v, F.lit(5.0), F.lit(400.0), F.lit(True))
    return observations(spark, sf).groupBy("metric", F.coalesce(reason, F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


@query("unit_normalize", f"""WITH {OBS_SQL}, x AS (SELECT value, ['km/h', 'm/s', 'mph', 'kmph', 'mm', 'furlong'][CAST(CAST(substr(observation_id, 5) AS BIGINT) % 6 AS INTEGER) + 1] AS unit FROM obs)
SELECT unit, count(*) AS rows, count(*) FILTER (unit NOT IN ('mm', 'furlong')) AS converted,
 round(sum(CASE unit WHEN 'km/h' THEN value * 1.0 / 1.0 WHEN 'kmph' THEN value * 1.0 / 1.0 WHEN 'm/s' THEN value * 3.6 / 1.0 WHEN 'mph' THEN value * 1.609344 / 1.0 END), 3) AS total FROM x GROUP BY unit""")
def _units(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ("km/h", "m/s", "mph", "kmph", "mm", "furlong"))), (F.expr("cast(substr(observation_id, 5) as bigint)") % 6 + 1).cast("int"))
    x = observations(spark, sf).select("value", unit.alias("unit")).withColumn("v", C.convert(F.col("value"), F.col("unit"), F.lit("km/h")))
    return x.groupBy("unit").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("converted"), r(F.sum("v"), 3).alias("total"))


@query("recency_bands", f"WITH {OBS_SQL} SELECT source_id, CASE WHEN epoch(received_time) - epoch(event_time) <= 7200 THEN 'current' WHEN floor(epoch(received_time)) - epoch(event_time) <= 172800 THEN 'recent' ELSE 'historical' END AS band, count(*) AS rows FROM obs GROUP BY ALL")
def _recency(spark, sf):
    return observations(spark, sf).groupBy("source_id", recency_band().alias("band")).agg(F.count(F.lit(1)).alias("rows"))


@query("quarantine_by_reason", f"""WITH {OBS_SQL}, x AS (SELECT *, CASE WHEN value > 480 THEN 'invalid_value' WHEN metric = 'signup' AND value < 5 THEN 'suspicious_measurement' WHEN epoch(received_time) - epoch(event_time) > 200000 THEN 'future_event_time' END AS reason FROM obs)
SELECT coalesce(reason, 'valid') AS reason, source_id, count(*) AS rows FROM x GROUP BY ALL""")
def _quarantine(spark, sf):
    lag = (F.unix_micros(F.col("received_time").cast("timestamp")) - F.unix_micros(F.col("event_time").cast("timestamp"))) / 1e6
    reason = integrity.first_failure([(F.col("value") > 480, "invalid_value"), ((F.col("metric") == "signup") & (F.col("value") < 5), "suspicious_measurement"), (lag > 200000, "future_event_time")])
    valid, bad = integrity.split_quarantine(observations(spark, sf), reason)
    return valid.unionByName(bad).groupBy(F.coalesce("quarantine_reason", F.lit("valid")).alias("reason"), "source_id").agg(F.count(F.lit(1)).alias("rows"))


_MAD = """m AS (SELECT {cell}, median(value) AS group_median, count(*) AS group_size FROM loc WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 12),
d AS (SELECT l.*, m.group_median, m.group_size, abs(l.value - m.group_median) AS gap FROM loc l JOIN m USING ({cell})),
s AS (SELECT {cell}, median(gap) * 1.4826 AS group_mad FROM d GROUP BY ALL HAVING median(gap) > 0)
SELECT observation_id, group_size, round(group_median, 7) AS group_median, round(group_mad, 7) AS group_mad, round(gap / group_mad, 7) AS deviation FROM d JOIN s USING ({cell}) WHERE gap / group_mad > {k}"""


def _mad(rows: DataFrame, cell: tuple[str, ...], k: float) -> DataFrame:
    found = integrity.mad_outliers(rows, cell, threshold=k)
    return found.select("observation_id", "group_size", r("group_median").alias("group_median"), r("group_mad").alias("group_mad"), r("deviation").alias("deviation"))


@query("mad_outliers", f"WITH {LOCAL_SQL}, " + _MAD.format(cell="location_id, metric, hour", k=6))
def _mad_hour(spark, sf):
    return _mad(local_obs(spark, sf), ("location_id", "metric", "hour"), 6.0)


@query("mad_outliers_weekday", f"WITH {LOCAL_SQL}, " + _MAD.format(cell="location_id, weekday, hour", k=3))
def _mad_weekday(spark, sf):
    return _mad(local_obs(spark, sf), ("location_id", "weekday", "hour"), 3.0)


@query("source_health", f"""WITH {OBS_SQL}, t AS (SELECT DISTINCT source_id, event_time FROM obs),
g AS (SELECT source_id, max(gap) AS max_gap_hours FROM (SELECT source_id, (epoch(event_time) - epoch(lag(event_time) OVER (PARTITION BY source_id ORDER BY event_time))) / 3600 AS gap FROM t) GROUP BY source_id),
c AS (SELECT source_id, count(*) AS observations, count(*) - count(value) AS missing, max(event_time) AS last_time, count(DISTINCT location_id) AS locations FROM obs GROUP BY source_id)
SELECT source_id, observations, missing, locations, round(max_gap_hours, 3) AS max_gap_hours, round((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_time)) / 3600, 3) AS trailing_gap_hours,
 CASE WHEN (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_time)) / 3600 > 24 THEN 'failed' WHEN (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_time)) / 3600 > 6 OR max_gap_hours > 24 OR missing / observations > 0.1 THEN 'warning' ELSE 'ok' END AS status
FROM c JOIN g USING (source_id)""")
def _health(spark, sf):
    h = integrity.source_health(observations(spark, sf), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return h.select("source_id", "observations", "missing", "locations", r("max_gap_hours", 3).alias("max_gap_hours"), r("trailing_gap_hours", 3).alias("trailing_gap_hours"), "status")


@query("frozen_runs", f"""WITH {OBS_SQL}, q AS (SELECT *, CASE WHEN floor(value / 50) <> 0 THEN floor(value / 50) END AS v FROM obs),
c AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY location_id, metric ORDER BY event_time, observation_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY location_id, metric ORDER BY event_time, observation_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT location_id, metric, v AS run_value, CAST(epoch(min(event_time)) AS BIGINT) AS start_s, CAST(epoch(max(event_time)) AS BIGINT) AS end_s, count(*) AS length FROM i WHERE v IS NOT NULL GROUP BY location_id, metric, run, v HAVING count(*) >= 6""")
def _frozen(spark, sf):
    runs = integrity.frozen_runs(observations(spark, sf), ("location_id", "metric"), F.floor(F.col("value") / 50).cast("double"))
    return runs.select("location_id", "metric", "run_value", micros("start").alias("start_s"), micros("end").alias("end_s"), "length")


@query("invariants", f"WITH {OBS_SQL} SELECT count(*) FILTER (received_time >= event_time) AS received_after_event, count(*) AS ids_present, count(*) AS value_is_number FROM obs")
def _invariants(spark, sf):
    x = integrity.check_invariants(observations(spark, sf))
    return x.agg(*[F.count_if(c).alias(c) for c in x.columns if c != "observation_id"])


@query("provenance_lookup", f"""WITH {_PLACED_SQL}, w AS (SELECT * FROM p WHERE value > 485)
SELECT w.observation_id, w.placement, w.representative_id, w.members, string_agg(q.observation_id, ',' ORDER BY q.observation_id) AS peers
FROM w LEFT JOIN p q ON q.location_id = w.location_id AND q.metric = w.metric AND q.event_time = w.event_time AND q.observation_id <> w.observation_id GROUP BY ALL""")
def _provenance(spark, sf):
    obs = observations(spark, sf)
    return integrity.provenance(obs, obs.filter("value > 485").select("observation_id"))


def _lag_sql(n: int) -> str:
    return f"(SELECT b.value FROM hourly b WHERE b.location_id = a.location_id AND b.event_time = a.event_time - INTERVAL {n} HOUR)"


@query("lag_features", f"WITH {HOURLY_SQL} SELECT location_id, CAST(epoch(event_time) AS BIGINT) AS event_s, round(a.value, 7) AS value, round({_lag_sql(1)}, 7) AS lag_1h, round({_lag_sql(24)}, 7) AS lag_24h, round({_lag_sql(168)}, 7) AS lag_168h FROM hourly a")
def _lags(spark, sf):
    x = features.lag_features(hourly(spark, sf), (1, 24, 168))
    return x.select("location_id", micros("event_time").alias("event_s"), *[r(c).alias(c) for c in ("value", "lag_1h", "lag_24h", "lag_168h")])


def _roll_sql(n: int) -> str:
    w = f"(PARTITION BY location_id ORDER BY event_time RANGE BETWEEN INTERVAL {n - 1} HOUR PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count(value) OVER {w} >= 2 THEN avg(value) OVER {w} END + 3e-8, 7) AS mean_{n}h"  # exact halves are moved off the rounding edge


@query("rolling_features", f"WITH {HOURLY_SQL} SELECT location_id, CAST(epoch(event_time) AS BIGINT) AS event_s, {_roll_sql(3)}, {_roll_sql(24)}, {_roll_sql(168)} FROM hourly")
def _rolling(spark, sf):
    x = features.rolling_features(hourly(spark, sf), (3, 24, 168))
    return x.select("location_id", micros("event_time").alias("event_s"), *[r(F.col(f"mean_{n}h") + 3e-8).alias(f"mean_{n}h") for n in (3, 24, 168)])


@query("calendar_features", f"""WITH {HOURLY_SQL}, l AS (SELECT location_id, event_time, event_time + INTERVAL 330 MINUTE AS t FROM hourly)
SELECT location_id, CAST(epoch(event_time) AS BIGINT) AS event_s, CAST(hour(t) AS INTEGER) AS hour, CAST(isodow(t) - 1 AS INTEGER) AS weekday, isodow(t) >= 6 AS is_weekend, CAST(month(t) AS INTEGER) AS month,
 round(sin(hour(t) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(t) * 2 * pi() / 24), 6) + 0.0 AS hour_cos FROM l""")
def _calendar(spark, sf):
    x = features.calendar_features(hourly(spark, sf), OFFSET)
    return x.select("location_id", micros("event_time").alias("event_s"), "hour", "weekday", "is_weekend", "month", (r("hour_sin", 6) + 0.0).alias("hour_sin"), (r("hour_cos", 6) + 0.0).alias("hour_cos"))


@query("rain_covariate", f"""WITH {OBS_SQL}, t AS (SELECT location_id, event_time, avg(value) AS value FROM obs WHERE metric = 'view' GROUP BY ALL), rain AS (SELECT event_time, avg(value) AS rain FROM obs WHERE metric = 'purchase' GROUP BY ALL)
SELECT location_id, CAST(epoch(event_time) AS BIGINT) AS event_s, round(value, 7) AS value, round(rain, 7) AS rain FROM t LEFT JOIN rain USING (event_time)""")
def _rain(spark, sf):
    obs = observations(spark, sf)
    rain = obs.filter("metric = 'purchase'").groupBy("event_time").agg(F.avg("value").alias("value"))
    x = features.covariate(features.hourly(obs.filter("metric = 'view'")), rain, "rain")
    return x.select("location_id", micros("event_time").alias("event_s"), r("value").alias("value"), r("rain").alias("rain"))


@query("feature_table", f"""WITH {HOURLY_SQL}
SELECT a.location_id, CAST(epoch(a.event_time) AS BIGINT) AS target_s, round(a.value, 7) AS target, round({_lag_sql(1)}, 7) AS lag_1h, round({_lag_sql(24)}, 7) AS at_24h,
 (SELECT round(CASE WHEN count(b.value) >= 2 THEN avg(b.value) END, 7) FROM hourly b WHERE b.location_id = a.location_id AND b.event_time > a.event_time - INTERVAL 4 HOUR AND b.event_time < a.event_time) AS mean_3h FROM hourly a""")
def _features(spark, sf):
    x = features.feature_table(hourly(spark, sf), offset_hours=OFFSET)
    return x.select("location_id", micros("target_time").alias("target_s"), r("target").alias("target"), r("lag_1h").alias("lag_1h"), r("at_24h").alias("at_24h"), r("mean_3h").alias("mean_3h"))


@query("temporal_split", f"""WITH {HOURLY_SQL}, t AS (SELECT event_time, row_number() OVER (ORDER BY event_time) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT event_time FROM hourly)),
b AS (SELECT max(event_time) FILTER (k = greatest(0, CAST(floor(n * 0.6) AS INTEGER) - 1)) AS x, max(event_time) FILTER (k = greatest(0, CAST(floor(n * 0.8) AS INTEGER) - 1)) AS y FROM t),
s AS (SELECT h.event_time, CASE WHEN event_time <= x THEN 'train' WHEN event_time > x + INTERVAL 24 HOUR AND event_time <= y THEN 'validation' WHEN event_time > y + INTERVAL 24 HOUR THEN 'test' END AS segment FROM hourly h, b)
SELECT coalesce(segment, 'gap') AS segment, count(*) AS rows, CAST(epoch(min(event_time)) AS BIGINT) AS first_s, CAST(epoch(max(event_time)) AS BIGINT) AS last_s FROM s GROUP BY 1""")
def _split(spark, sf):
    x = features.temporal_split(hourly(spark, sf))
    return x.groupBy(F.coalesce("segment", F.lit("gap")).alias("segment")).agg(F.count(F.lit(1)).alias("rows"), F.min(micros("event_time")).alias("first_s"), F.max(micros("event_time")).alias("last_s"))


@query("leakage_probe", f"""WITH {HOURLY_SQL}, times AS (SELECT event_time, row_number() OVER (ORDER BY event_time) - 1 AS k, greatest(1, count(*) OVER () // 24) AS step FROM (SELECT DISTINCT event_time FROM hourly WHERE event_time >= (SELECT min(event_time) FROM hourly) + INTERVAL 24 HOUR)),
probe AS (SELECT event_time AS t FROM times WHERE k % step = 0 AND k < step * 24), nx AS (SELECT *, lead(event_time) OVER (PARTITION BY location_id ORDER BY event_time) AS next_time FROM hourly)
SELECT location_id, 'next_value' AS feature, 'future_event' AS kind, CAST(epoch(t) AS BIGINT) AS event_s FROM nx JOIN probe ON event_time = t WHERE next_time <= t + INTERVAL 24 HOUR""")
def _leakage(spark, sf):
    """Four honest features, which the probe leaves alone, and a planted one that reads the next value, which it finds."""
    series = hourly(spark, sf)
    peeking = lambda x: _probed(x).withColumn("next_value", F.lead("value").over(Window.partitionBy("location_id").orderBy("event_time")))  # noqa: E731  the probe's stretch of one zone
    found = features.leakage_probe(series, peeking, features.probe_instants(series, 24), [*_PROBED, "next_value"])
    return found.select("location_id", "feature", "kind", micros("event_time").alias("event_s"))


_PROBED = ["lag_1h", "lag_24h", "mean_3h", "mean_24h"]


def _probed(series: DataFrame) -> DataFrame:
    return features.rolling_features(features.lag_features(series, (1, 24)), (3, 24))


@query("leakage_probe_receipts", f"""WITH {HOURLY_SQL}, times AS (SELECT event_time, row_number() OVER (ORDER BY event_time) - 1 AS k, greatest(1, count(*) OVER () // 24) AS step FROM (SELECT DISTINCT event_time FROM hourly WHERE event_time >= (SELECT min(event_time) FROM hourly) + INTERVAL 24 HOUR)),
probe AS (SELECT event_time AS t FROM times WHERE k % step = 0 AND k < step * 24 AND event_time >= (SELECT min(received_time) FROM obs) AND event_time < (SELECT max(received_time) FROM obs)),
pr AS (SELECT h.location_id, p.t, count(x.value) FILTER (x.event_time > p.t - INTERVAL 3 HOUR) AS n3, count(x.value) AS n24 FROM probe p JOIN hourly h ON h.event_time = p.t
  JOIN hourly x ON x.location_id = h.location_id AND x.event_time > p.t - INTERVAL 24 HOUR AND x.event_time <= p.t GROUP BY ALL),
late AS (SELECT DISTINCT pr.*, (epoch(t) - epoch(o.event_time)) / 3600 AS age FROM pr JOIN obs o ON o.location_id = pr.location_id AND o.received_time > t AND o.event_time <= t AND o.event_time >= t - INTERVAL 24 HOUR WHERE o.value IS NOT NULL),
f AS (SELECT location_id, t, unnest([CASE WHEN age = 1 THEN 'lag_1h' END, CASE WHEN age = 24 THEN 'lag_24h' END, CASE WHEN age < 3 AND n3 >= 2 THEN 'mean_3h' END, CASE WHEN age < 24 AND n24 >= 2 THEN 'mean_24h' END]) AS feature FROM late)
SELECT DISTINCT location_id, feature, 'late_arrival' AS kind, CAST(epoch(t) AS BIGINT) AS event_s FROM f WHERE feature IS NOT NULL""")
def _leakage_receipts(spark, sf):
    """Hourly means take readings as known at their event time, so late receipts move them: what is found is real."""
    obs = observations(spark, sf).select("location_id", "event_time", "received_time", "value")
    found = features.leakage_probe(obs, lambda o: _probed(features.hourly(o)), features.probe_instants(features.hourly(obs), 24), _PROBED)
    return found.select("location_id", "feature", "kind", micros("event_time").alias("event_s"))


@query("zone_thresholds", f"WITH {HOURLY_SQL} SELECT location_id, round(quantile_cont(value, 0.9), 7) AS threshold FROM hourly GROUP BY 1")
def _thresholds(spark, sf):
    return evaluation.thresholds(hourly(spark, sf)).select("location_id", r("threshold").alias("threshold"))


_GRADED_SQL = f"""{HOURLY_SQL}, th AS (SELECT location_id, quantile_cont(value, 0.75) AS threshold FROM hourly GROUP BY 1),
gr AS (SELECT h.*, value / threshold AS ratio, value > threshold AS congested, CASE WHEN value / threshold >= 1.8 THEN 'severe' WHEN value / threshold >= 1.3 THEN 'high' WHEN value / threshold >= 1.0 THEN 'moderate' ELSE 'low' END AS severity FROM hourly h JOIN th USING (location_id))"""


def _graded(spark, sf) -> DataFrame:
    h = hourly(spark, sf)
    return evaluation.graded(h, evaluation.thresholds(h, 0.75))


@query("severity_bands", f"WITH {_GRADED_SQL} SELECT location_id, severity, count(*) AS rows, round(avg(CAST(congested AS INTEGER)), 6) AS congested_rate FROM gr GROUP BY ALL")
def _severity(spark, sf):
    return _graded(spark, sf).groupBy("location_id", "severity").agg(F.count(F.lit(1)).alias("rows"), r(F.avg(F.col("congested").cast("int")), 6).alias("congested_rate"))


@query("congestion_windows", f"""WITH {_GRADED_SQL}, i AS (SELECT *, epoch(event_time) - 3600 * row_number() OVER (PARTITION BY location_id ORDER BY event_time) AS island FROM gr WHERE congested)
SELECT location_id, CAST(epoch(min(event_time)) AS BIGINT) AS start_s, CAST(epoch(max(event_time)) + 3600 AS BIGINT) AS end_s, count(*) AS hours, round(max(value), 7) AS peak_value,
 ['low', 'moderate', 'high', 'severe'][max(list_position(['low', 'moderate', 'high', 'severe'], severity))] AS peak_severity FROM i GROUP BY location_id, island""")
def _windows(spark, sf):
    w = evaluation.congestion_windows(_graded(spark, sf))
    return w.select("location_id", micros("start").alias("start_s"), micros("end").alias("end_s"), "hours", r("peak_value").alias("peak_value"), "peak_severity")


_METRICS_SQL = """count(*) AS rows, round(avg(coalesce(abs(predicted - actual), abs(actual))), 7) AS mae, round(sqrt(avg(pow(coalesce(abs(predicted - actual), abs(actual)), 2))), 7) AS rmse,
 round(avg(CASE WHEN predicted IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage, round(avg(actual), 7) AS mean_actual"""


def _metrics(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "rows", r("mae").alias("mae"), r("rmse").alias("rmse"), r("coverage", 6).alias("coverage"), r("mean_actual").alias("mean_actual"))


@query("slice_metrics", f"""WITH {FORECAST_SQL}, s AS (
 SELECT 'ZONE-B' AS slice, * FROM fc WHERE location_id = 'ZONE-B' UNION ALL
 SELECT 'ZONE-B Fri 18-20', * FROM fc WHERE location_id = 'ZONE-B' AND isodow(event_time + INTERVAL 330 MINUTE) = 5 AND hour(event_time + INTERVAL 330 MINUTE) BETWEEN 18 AND 19 UNION ALL
 SELECT 'weekend', * FROM fc WHERE isodow(event_time + INTERVAL 330 MINUTE) >= 6)
SELECT slice, {_METRICS_SQL} FROM s GROUP BY slice""")
def _slices(spark, sf):
    local = C.local_time(F.col("event_time"), OFFSET)
    zone = F.col("location_id") == "ZONE-B"
    slices = {"ZONE-B": zone, "ZONE-B Fri 18-20": zone & (F.weekday(local) == 4) & F.hour(local).between(18, 19), "weekend": F.weekday(local) >= 5}
    return _metrics(evaluation.slice_metrics(forecasts(spark, sf), slices), "slice")


@query("error_breakdowns", f"""WITH {FORECAST_SQL}, d AS (SELECT *, CAST(isodow(event_time + INTERVAL 330 MINUTE) - 1 AS VARCHAR) AS weekday,
 CASE WHEN hour(event_time + INTERVAL 330 MINUTE) < 6 THEN 'night' WHEN hour(event_time + INTERVAL 330 MINUTE) < 12 THEN 'morning' WHEN hour(event_time + INTERVAL 330 MINUTE) < 17 THEN 'afternoon' ELSE 'evening' END AS time_of_day FROM fc)
SELECT 'zone' AS dimension, location_id AS member, {_METRICS_SQL} FROM d GROUP BY location_id UNION ALL
SELECT 'weekday', weekday, {_METRICS_SQL} FROM d GROUP BY weekday UNION ALL
SELECT 'time_of_day', time_of_day, {_METRICS_SQL} FROM d GROUP BY time_of_day UNION ALL
SELECT 'overall', 'all', {_METRICS_SQL} FROM d""")
def _breakdowns(spark, sf):
    local = C.local_time(F.col("event_time"), OFFSET)
    dims = {"zone": F.col("location_id"), "weekday": F.weekday(local), "time_of_day": C.time_of_day(F.hour(local))}
    return _metrics(evaluation.error_breakdowns(forecasts(spark, sf), dims), "dimension", "member")


@query("weakest_slices", f"""WITH {FORECAST_SQL}, s AS (SELECT location_id || ' h' || hour(event_time) AS slice, {_METRICS_SQL} FROM fc GROUP BY 1)
SELECT slice, rows, mae, round(mae / abs(mean_actual), 3) AS relative_mae FROM s WHERE rows >= 10 ORDER BY mae / abs(mean_actual) DESC, slice LIMIT 5""")
def _weakest(spark, sf):
    fc = forecasts(spark, sf).withColumn("slice", F.concat_ws(" h", "location_id", F.hour("event_time").cast("string")))
    by = fc.groupBy("slice").agg(*[c.alias(n) for n, c in evaluation.error_metrics().items()])
    return evaluation.weakest(_metrics(by, "slice"), "slice", least=10).select("slice", "rows", "mae", r("relative_mae", 3).alias("relative_mae"))


_PROB_SQL = f"{HOURLY_SQL}, pr AS (SELECT location_id, least(1.0, greatest(0.0, value / 500)) AS probability, value > 250 AS outcome FROM hourly)"


def _probabilities(spark, sf) -> DataFrame:
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 500))
    return hourly(spark, sf).select("location_id", p.alias("probability"), (F.col("value") > 250).alias("outcome"))


@query("brier_score", f"WITH {_PROB_SQL} SELECT count(*) AS rows, round(avg(pow(probability - CAST(outcome AS INTEGER), 2)), 6) AS brier, round(avg(CAST(outcome AS INTEGER)), 6) AS base_rate, round(avg(CAST(outcome AS INTEGER)) * (1 - avg(CAST(outcome AS INTEGER))), 6) AS reference_brier FROM pr")
def _brier(spark, sf):
    return evaluation.brier(_probabilities(spark, sf)).select("rows", r("brier", 6).alias("brier"), r("base_rate", 6).alias("base_rate"), r("reference_brier", 6).alias("reference_brier"))


@query("reliability_table", f"WITH {_PROB_SQL} SELECT CAST(least(floor(probability * 10), 9) AS INTEGER) AS bin, count(*) AS count, round(avg(probability), 6) AS mean_predicted, round(avg(CAST(outcome AS INTEGER)), 6) AS observed FROM pr GROUP BY 1")
def _reliability(spark, sf):
    b = evaluation.reliability(_probabilities(spark, sf))
    return b.select("bin", "count", r("mean_predicted", 6).alias("mean_predicted"), r("observed", 6).alias("observed"))


@query("calibration_error", f"WITH {_PROB_SQL}, b AS (SELECT count(*) AS n, abs(avg(probability) - avg(CAST(outcome AS INTEGER))) AS gap FROM pr GROUP BY least(floor(probability * 10), 9)) SELECT round(sum(n * gap) / sum(n), 6) AS calibration_error FROM b")
def _ece(spark, sf):
    return evaluation.expected_calibration_error(evaluation.reliability(_probabilities(spark, sf))).select(r("calibration_error", 6).alias("calibration_error"))


@query("classification_counts", f"""WITH {FORECAST_SQL}, c AS (SELECT count(*) FILTER (predicted > 250 AND actual > 250) AS tp, count(*) FILTER (predicted > 250 AND NOT actual > 250) AS fp,
 count(*) FILTER (NOT predicted > 250 AND actual > 250) AS fn, count(*) FILTER (NOT predicted > 250 AND NOT actual > 250) AS tn FROM fc WHERE predicted IS NOT NULL)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def _classes(spark, sf):
    fc = forecasts(spark, sf).filter("predicted is not null").select((F.col("predicted") > 250).alias("p"), (F.col("actual") > 250).alias("a"))
    return evaluation.classification(fc, "p", "a").select("tp", "fp", "fn", "tn", *[r(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("residual_interval", f"WITH {FORECAST_SQL} SELECT location_id, count(*) AS rows, round(quantile_cont(actual - predicted, 0.1), 7) AS lower_offset, round(quantile_cont(actual - predicted, 0.9), 7) AS upper_offset FROM fc WHERE predicted IS NOT NULL GROUP BY 1")
def _intervals(spark, sf):
    return evaluation.residual_intervals(forecasts(spark, sf)).select("location_id", "rows", r("lower_offset").alias("lower_offset"), r("upper_offset").alias("upper_offset"))


_CELL_TREAT = "weekday IN (4, 5)"
_MWU_SQL = f"""{LOCAL_SQL}, x AS (SELECT location_id, hour, value, {_CELL_TREAT} AS treated FROM loc WHERE value IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY location_id, hour ORDER BY value) + (count(*) OVER (PARTITION BY location_id, hour, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY location_id, hour, value) AS t FROM x),
g AS (SELECT location_id, hour, CAST(count(*) FILTER (treated) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT treated) AS DOUBLE) AS n2, sum(r) FILTER (treated) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties,
 median(value) FILTER (treated) / median(value) FILTER (NOT treated) AS effect FROM k GROUP BY ALL),
mw AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM g WHERE n1 >= 12 AND n2 >= 12)"""


def _mwu(spark, sf) -> DataFrame:
    rows = local_obs(spark, sf).withColumn("treated", F.col("weekday").isin(4, 5))
    return statistics.mann_whitney(rows, ["location_id", "hour"], "treated")


@query("mwu_statistic", f"WITH {_MWU_SQL} SELECT location_id, hour, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 2) AS u, round(z, 5) AS z, round(effect, 5) AS effect FROM mw")
def _mwu_query(spark, sf):
    return _mwu(spark, sf).select("location_id", "hour", "n1", "n2", r("u", 2).alias("u"), r("z", 5).alias("z"), r("effect", 5).alias("effect"))


@query("bh_adjusted", f"""WITH {_MWU_SQL}, p AS (SELECT location_id, hour, round(exp(-greatest(z, 0)), 9) AS p FROM mw), q AS (SELECT *, row_number() OVER (ORDER BY p, location_id, hour) AS k, count(*) OVER () AS m FROM p)
SELECT location_id, hour, p, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted_p FROM q""")
def _bh(spark, sf):
    p = _mwu(spark, sf).select("location_id", "hour", F.round(F.exp(-F.greatest(F.col("z"), F.lit(0.0))), 9).alias("p"))
    return statistics.benjamini_hochberg(p, "p").select("location_id", "hour", "p", r("adjusted_p", 6).alias("adjusted_p"))


# erf(x) = exp(-x^2) * sum of x^(2n+1) / gamma(n + 3/2)
@query("mwu_p_values", f"""WITH {_MWU_SQL} SELECT location_id, hour, round(least(1.0, 1 - exp(-greatest(0, z) * greatest(0, z) / 2) * list_sum(list_transform(range(80), lambda n: pow(greatest(0, z) / sqrt(2), 2 * n + 1) / gamma(n + 1.5)))), 6) AS p_value FROM mw""")
def _mwu_p(spark, sf):
    return _mwu(spark, sf).select("location_id", "hour", r(statistics.two_sided(F.col("z")), 6).alias("p_value"))


@query("cell_medians", f"WITH {LOCAL_SQL} SELECT location_id, weekday, hour, count(*) AS rows, round(median(value), 7) AS median_value FROM loc GROUP BY ALL")
def _cells(spark, sf):
    return local_obs(spark, sf).groupBy("location_id", "weekday", "hour").agg(F.count(F.lit(1)).alias("rows"), r(F.median("value")).alias("median_value"))


_CELL_SQL = f"""{LOCAL_SQL}, cell AS (SELECT DISTINCT location_id, hour, weekday AS w FROM loc WHERE value IS NOT NULL), cx AS (SELECT l.location_id, l.hour, c.w, l.value, l.weekday = c.w AS treated FROM loc l JOIN cell c ON l.location_id = c.location_id AND l.hour = c.hour WHERE l.value IS NOT NULL),
cg AS (SELECT location_id, hour, w, median(value) FILTER (treated) / median(value) FILTER (NOT treated) AS effect FROM cx GROUP BY ALL HAVING count(*) FILTER (treated) >= 12 AND count(*) FILTER (NOT treated) >= 12),
cl AS (SELECT *, effect / median(effect) OVER (PARTITION BY hour, w) AS lift FROM cg)"""


@query("spatiotemporal_cells", f"""WITH {_CELL_SQL}, ck AS (SELECT *, rank() OVER (PARTITION BY location_id, hour, w ORDER BY value) + (count(*) OVER (PARTITION BY location_id, hour, w, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY location_id, hour, w, value) AS t FROM cx),
cs AS (SELECT location_id, hour, w, CAST(count(*) FILTER (treated) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT treated) AS DOUBLE) AS n2, sum(r) FILTER (treated) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM ck GROUP BY ALL HAVING count(*) FILTER (treated) >= 12 AND count(*) FILTER (NOT treated) >= 12),
cz AS (SELECT location_id, hour, w, greatest(0, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))) / sqrt(2) AS x FROM cs),
cp AS (SELECT location_id, hour, w, least(1.0, greatest(0.0, 1 - exp(-x * x) * list_sum(list_transform(range(80), lambda n: pow(x, 2 * n + 1) / gamma(n + 1.5))))) AS p FROM cz),
cq AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM cp), ca AS (SELECT location_id, hour, w, least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted FROM cq)
SELECT location_id, hour, w AS weekday_tested, round(effect, 7) AS effect, round(lift, 7) AS localized_lift, round(adjusted, 5) AS adjusted_p FROM cl JOIN ca USING (location_id, hour, w)""")
def _cell_tests(spark, sf):
    """All cells with their adjusted p value; those below the level and above the lift are the patterns (discovered_patterns)."""
    t = patterns.discovered(patterns.cell_tests(local_obs(spark, sf).filter("value is not null")), level=2.0, lift=0.0)
    return t.select("location_id", "hour", "weekday_tested", r("effect").alias("effect"), r("localized_lift").alias("localized_lift"), r("adjusted_p", 5).alias("adjusted_p"))


@query("pattern_hours", f"""WITH {_CELL_SQL}, i AS (SELECT *, hour - row_number() OVER (PARTITION BY location_id, w ORDER BY hour) AS island FROM cl WHERE lift >= 1.25)
SELECT location_id, w AS weekday_tested, list_sort(list(hour)) AS hours, round(max(lift), 7) AS lift FROM i GROUP BY location_id, w, island""")
def _pattern_hours(spark, sf):
    t = patterns.cell_tests(local_obs(spark, sf).filter("value is not null"))
    return patterns.merge_hours(t.filter(F.col("localized_lift") >= 1.25)).select("location_id", "weekday_tested", "hours", r("lift").alias("lift"))


@query("hotspots", f"""WITH {OBS_SQL}, z AS (SELECT DISTINCT location_id AS zone FROM obs)
SELECT zone AS location_id, round(median(value) FILTER (location_id = zone), 7) AS zone_median, round(median(value) FILTER (location_id <> zone), 7) AS other_median, median(value) FILTER (location_id = zone) / median(value) FILTER (location_id <> zone) >= 1.3 AS hotspot FROM obs, z GROUP BY zone""")
def _hotspots(spark, sf):
    return patterns.hotspots(observations(spark, sf)).select("location_id", r("zone_median").alias("zone_median"), r("other_median").alias("other_median"), "hotspot")


@query("profiles", f"""WITH {LOCAL_SQL}, m AS (SELECT location_id, hour, median(value) AS m FROM loc GROUP BY ALL HAVING count(*) >= 12)
SELECT location_id, count(*) AS buckets, arg_max(hour, (m, hour)) AS peak, round(max(m), 7) AS peak_median, arg_min(hour, (m, hour)) AS trough, round(min(m), 7) AS trough_median, round(max(m) / min(m), 7) AS ratio FROM m GROUP BY 1 HAVING count(*) >= 2 AND min(m) > 0""")
def _profiles(spark, sf):
    p = patterns.profiles(local_obs(spark, sf), "hour")
    return p.select("location_id", "buckets", "peak", r("peak_median").alias("peak_median"), "trough", r("trough_median").alias("trough_median"), r("ratio").alias("ratio"))


_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 1998) for m in range(1, 13)]


def _monthly(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.concat(F.lit("Z"), (F.col("l_suppkey") % 4).cast("string")).alias("location_id"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_quantity").cast("double").alias("value"))


@query("level_shift_scan", f"""WITH li AS (SELECT 'Z' || (l_suppkey % 4) AS location_id, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_quantity AS DOUBLE) AS value FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '{_MONTHS[0]}' AND '{_MONTHS[-1]}'),
c AS (SELECT unnest([{", ".join(repr(m) for m in _MONTHS[2:-1])}]) AS change_point),
g AS (SELECT location_id, change_point, median(value) FILTER (month >= change_point) / median(value) FILTER (month < change_point) AS raw_ratio, count(*) FILTER (month < change_point) AS n_before, count(*) FILTER (month >= change_point) AS n_after FROM li, c GROUP BY ALL),
p AS (SELECT *, raw_ratio / quantile_cont(raw_ratio, 0.25) OVER (PARTITION BY change_point) AS adjusted_ratio FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY abs(adjusted_ratio - 1) DESC, change_point) AS k FROM p)
SELECT location_id, change_point, n_before, n_after, round(raw_ratio, 5) AS raw_ratio, round(adjusted_ratio, 5) AS adjusted_ratio FROM k WHERE k = 1""")
def _shifts(spark, sf):
    """Of 1995 to 1997 only, as its oracle; level_shift_scan_whole has all months."""
    return _shift_columns(patterns.level_shifts(_monthly(spark, sf).filter(F.col("month").between(_MONTHS[0], _MONTHS[-1])), _MONTHS))


def _shift_columns(s: DataFrame) -> DataFrame:
    return s.select("location_id", "change_point", "n_before", "n_after", r("raw_ratio", 5).alias("raw_ratio"), r("adjusted_ratio", 5).alias("adjusted_ratio"))


@query("level_shift_scan_whole", """WITH li AS (SELECT 'Z' || (l_suppkey % 4) AS location_id, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_quantity AS DOUBLE) AS value FROM lineitem),
m AS (SELECT month AS change_point, row_number() OVER (ORDER BY month) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT month FROM li WHERE month IS NOT NULL)),
c AS (SELECT change_point FROM m WHERE k BETWEEN 3 AND n - 1),
g AS (SELECT location_id, change_point, median(value) FILTER (month >= change_point) / median(value) FILTER (month < change_point) AS raw_ratio, count(*) FILTER (month < change_point) AS n_before, count(*) FILTER (month >= change_point) AS n_after FROM li, c GROUP BY ALL),
p AS (SELECT *, raw_ratio / quantile_cont(raw_ratio, 0.25) OVER (PARTITION BY change_point) AS adjusted_ratio FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY abs(adjusted_ratio - 1) DESC, change_point) AS k FROM p)
SELECT location_id, change_point, n_before, n_after, round(raw_ratio, 5) AS raw_ratio, round(adjusted_ratio, 5) AS adjusted_ratio FROM k WHERE k = 1""")
def _shifts_whole(spark, sf):
    return _shift_columns(patterns.level_shifts(_monthly(spark, sf)))


_ISQL = ", ".join(f"count(*) FILTER (a = {a} AND b = {b}) AS n{a}{b}, avg(y) FILTER (a = {a} AND b = {b}) AS m{a}{b}, coalesce(var_samp(y) FILTER (a = {a} AND b = {b}), 0) AS v{a}{b}" for a in (0, 1) for b in (0, 1))


@query("interaction_effect", f"""WITH {LOCAL_SQL}, x AS (SELECT location_id, ln(value) AS y, CAST(weekday >= 5 AS INTEGER) AS a, CAST(hour BETWEEN 17 AND 20 AS INTEGER) AS b FROM loc WHERE value > 0), g AS (SELECT location_id, {_ISQL} FROM x GROUP BY 1)
SELECT location_id, n00, n01, n10, n11, round(m11 - m10 - m01 + m00, 5) AS effect,
 round(CASE WHEN least(n00, n01, n10, n11) >= 8 THEN sqrt(((n00 - 1) * v00 + (n01 - 1) * v01 + (n10 - 1) * v10 + (n11 - 1) * v11) / (n00 + n01 + n10 + n11 - 4) * (1 / n00 + 1 / n01 + 1 / n10 + 1 / n11)) END, 5) AS stderr FROM g""")
def _interaction(spark, sf):
    g = patterns.interaction(local_obs(spark, sf), ["location_id"], F.col("weekday") >= 5, F.col("hour").between(17, 20))
    return g.select("location_id", "n00", "n01", "n10", "n11", r("effect", 5).alias("effect"), r("stderr", 5).alias("stderr"))


@query("rain_slope", f"""WITH {LOCAL_SQL}, rain AS (SELECT event_time, avg(value) AS v FROM obs WHERE metric = 'purchase' GROUP BY 1),
w AS (SELECT l.location_id, l.weekday, l.hour, l.value, greatest(0.0, coalesce(r.v, 0) - 60) / 10 AS wet FROM loc l LEFT JOIN rain r USING (event_time)),
d AS (SELECT location_id, weekday, hour, median(value) AS base FROM w WHERE wet <= 0 GROUP BY ALL HAVING count(*) >= 4 AND median(value) <> 0),
x AS (SELECT w.location_id, w.wet, w.value / d.base - 1 AS response FROM w JOIN d USING (location_id, weekday, hour) WHERE wet > 0)
SELECT location_id, count(*) AS n, round(regr_slope(response, wet), 5) AS slope, round(regr_intercept(response, wet), 5) AS intercept, round(regr_r2(response, wet), 6) AS r2 FROM x GROUP BY 1 HAVING count(*) >= 30""")
def _rain_slope(spark, sf):
    rows = local_obs(spark, sf)
    rain = rows.filter("metric = 'purchase'").groupBy("event_time").agg(F.avg("value").alias("v"))
    wet = rows.join(rain, "event_time", "left").withColumn("wet", F.greatest(F.lit(0.0), F.coalesce("v", F.lit(0.0)) - 60) / 10)
    s = statistics.slope(patterns.conditional_response(wet, "wet"), ["location_id"], "wet", "response")
    return s.select("location_id", "n", r("slope", 5).alias("slope"), r("intercept", 5).alias("intercept"), r("r2", 6).alias("r2"))


@query("spearman_trend", """WITH m AS (SELECT l_suppkey % 4 AS zone, strftime(l_shipdate, '%Y-%m') AS month, avg(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY ALL),
k AS (SELECT zone, rank() OVER (PARTITION BY zone ORDER BY month) AS x, rank() OVER (PARTITION BY zone ORDER BY v) + (count(*) OVER (PARTITION BY zone, v) - 1) / 2.0 AS y FROM m)
SELECT zone, count(*) AS n, round(corr(x, y), 6) AS rho FROM k GROUP BY zone""")
def _trend(spark, sf):
    m = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("zone"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.avg(F.col("l_quantity").cast("double")).alias("v"))
    return statistics.spearman(m, ["zone"], "month", "v").select("zone", "n", r("rho", 6).alias("rho"))


@query("kruskal_profile", f"""WITH {LOCAL_SQL}, k AS (SELECT location_id, weekday, rank() OVER (PARTITION BY location_id ORDER BY value) + (count(*) OVER (PARTITION BY location_id, value) - 1) / 2.0 AS r, CAST(count(*) OVER (PARTITION BY location_id, value) AS DOUBLE) AS t FROM loc WHERE value IS NOT NULL),
g AS (SELECT location_id, weekday, sum(r) AS s, count(*) AS n, sum(t * t - 1) AS c FROM k GROUP BY ALL), q AS (SELECT location_id, sum(s * s / n) AS q, CAST(sum(n) AS DOUBLE) AS n, sum(c) AS c, count(*) - 1 AS degrees FROM g GROUP BY 1)
SELECT location_id, degrees, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - c / (n * n * n - n)), 7) AS h FROM q""")
def _kruskal(spark, sf):
    return statistics.kruskal_wallis(local_obs(spark, sf), ["location_id"], "weekday", "value").select("location_id", "degrees", r("h").alias("h"))


_PRICE_SQL = "o AS (SELECT CAST(o_totalprice AS DOUBLE) AS v, o_orderdate < DATE '1998-01-01' AS ref FROM orders)"


def _prices(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_totalprice").cast("double").alias("v"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("date")).alias("ref"))


@query("psi", f"""WITH {_PRICE_SQL}, e AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM o WHERE ref),
b AS (SELECT len(list_filter(edges, lambda x: x <= v)) AS bin, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM o, e GROUP BY 1),
s AS (SELECT greatest(a / (SELECT sum(a) FROM b), 1e-6) AS p, greatest(b / (SELECT sum(b) FROM b), 1e-6) AS q FROM b)
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi, CASE WHEN sum((q - p) * ln(q / p)) >= 0.25 THEN 'drifted' WHEN sum((q - p) * ln(q / p)) >= 0.1 THEN 'minor' ELSE 'stable' END AS status FROM s""")
def _psi(spark, sf):
    p = _prices(spark, sf)
    found = statistics.psi(p.filter("ref"), p.filter("not ref"), "v")
    return found.select(r("psi", 6).alias("psi"), statistics.psi_status(F.col("psi")).alias("status"))


@query("ks_statistic", f"""WITH {_PRICE_SQL}, c AS (SELECT v, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM o GROUP BY v),
d AS (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS d, a, b FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))
SELECT round(max(d), 6) AS ks, CAST(sum(a) AS BIGINT) AS first_rows, CAST(sum(b) AS BIGINT) AS second_rows FROM d""")
def _ks(spark, sf):
    return statistics.ks_statistic(_prices(spark, sf).withColumn("one", F.lit(1)), ["one"], "ref", "v").select(r("ks", 6).alias("ks"), "first_rows", "second_rows")


_WEEK_SQL = f"""{FORECAST_SQL}, w AS (SELECT CAST(floor((epoch(event_time) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 604800) AS INTEGER) AS week, count(*) AS rows, avg(abs(predicted - actual)) AS mae, avg(predicted) AS mean_predicted FROM fc WHERE predicted IS NOT NULL GROUP BY 1)"""


@query("weekly_drift", f"WITH {_WEEK_SQL} SELECT week AS \"window\", rows, round(mae, 7) AS mae, round(mean_predicted, 7) AS mean_predicted FROM w WHERE week >= 0")
def _weekly(spark, sf):
    return monitoring.weekly_errors(forecasts(spark, sf), "2024-01-01 00:00:00").select("window", "rows", r("mae").alias("mae"), r("mean_predicted").alias("mean_predicted"))


@query("sigma_gate", f"WITH {_WEEK_SQL} SELECT count(*) AS windows, round(CASE WHEN count(*) >= 4 THEN greatest(avg(mae) + 3 * stddev_samp(mae), 1.0) END, 7) AS gate FROM w WHERE week >= 0")
def _gate(spark, sf):
    weeks = monitoring.weekly_errors(forecasts(spark, sf), "2024-01-01 00:00:00")
    return statistics.sigma_gate(weeks, "mae", floor=1.0).select("windows", r("gate").alias("gate"))


@query("performance_drift", f"""WITH {_WEEK_SQL}, b AS (SELECT mae AS base FROM w WHERE week = 0)
SELECT week AS "window", round(mae / base, 5) AS ratio, CASE WHEN rows < 30 THEN 'insufficient_data' WHEN mae / base >= 1.1 THEN 'drifted' WHEN mae / base >= 1.05 THEN 'minor' ELSE 'stable' END AS status FROM w, b WHERE week >= 0""")
def _performance(spark, sf):
    w = monitoring.weekly_errors(forecasts(spark, sf), "2024-01-01 00:00:00")
    base = F.max(F.when(F.col("window") == 0, F.col("mae"))).over(Window.partitionBy())
    x = w.withColumn("ratio", F.col("mae") / base)
    return x.select("window", r("ratio", 5).alias("ratio"), monitoring.performance_status(F.col("ratio"), F.lit(1.1), F.col("rows")).alias("status"))


@query("evolution_strength", """WITH m AS (SELECT 'Z' || (l_suppkey % 4) AS pattern_id, strftime(l_shipdate, '%Y') AS year, median(CAST(l_extendedprice AS DOUBLE)) / 30000 AS strength FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY year DESC) AS k FROM m)
SELECT pattern_id, count(*) AS windows, round(median(strength) FILTER (k > 2), 5) AS historical, round(median(strength) FILTER (k <= 2), 5) AS recent FROM k GROUP BY 1""")
def _evolution(spark, sf):
    li = table(spark, sf, "lineitem")
    m = li.groupBy(F.concat(F.lit("Z"), (F.col("l_suppkey") % 4).cast("string")).alias("pattern_id"), F.date_format("l_shipdate", "yyyy").alias("window")).agg((F.median(F.col("l_extendedprice").cast("double")) / 30000).alias("strength"))
    return patterns.evolution(m).select("pattern_id", "windows", r("historical", 5).alias("historical"), r("recent", 5).alias("recent"))


@query("neighbour_repeats", f"""WITH {OBS_SQL}, q AS (SELECT *, floor(value / 50) AS v FROM obs),
n AS (SELECT observation_id, {" + ".join(f"coalesce(CAST({f}(v, {k}) OVER w = v AS INTEGER), 0)" for f in ("lag", "lead") for k in (1, 2, 3))} AS neighbours FROM q WINDOW w AS (PARTITION BY location_id, metric ORDER BY event_time, observation_id))
SELECT neighbours, count(*) AS rows FROM n GROUP BY 1""")
def _neighbours(spark, sf):
    rows = observations(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return monitoring.repeated_neighbours(rows, ("location_id", "metric")).groupBy("neighbours").agg(F.count(F.lit(1)).alias("rows"))


ANOMALY_SQL = f"""{LOCAL_SQL}, m AS (SELECT location_id, metric, hour, median(value) AS med FROM loc GROUP BY ALL HAVING count(*) >= 12),
d AS (SELECT l.*, abs(value - med) AS gap FROM loc l JOIN m USING (location_id, metric, hour)),
s AS (SELECT location_id, metric, hour, median(gap) * 1.4826 AS mad FROM d GROUP BY ALL HAVING median(gap) > 0),
a AS (SELECT d.* FROM d JOIN s USING (location_id, metric, hour) WHERE gap / mad > 6)"""


@query("anomaly_explanations", f"""WITH {ANOMALY_SQL}, rain AS (SELECT event_time, avg(value) / 100 AS mm FROM obs WHERE metric = 'purchase' GROUP BY 1),
e AS (SELECT a.observation_id, CASE WHEN a.weekday = 4 THEN 0.8 WHEN mm > 0.5 THEN least(0.6, 0.2 + mm / 50) ELSE 0.0 END AS support, CASE WHEN a.weekday = 4 THEN 'recurring_pattern' WHEN mm > 0.5 THEN 'rainfall' ELSE 'unexplained' END AS leading_kind FROM a LEFT JOIN rain USING (event_time))
SELECT observation_id, leading_kind, round(support, 5) AS support FROM e""")
def _explanations(spark, sf):
    """With the constants of its oracle; anomaly_explanations_joined has the evidence."""
    rows = local_obs(spark, sf)
    rain = rows.filter("metric = 'purchase'").groupBy("event_time").agg((F.avg("value") / 100).alias("mm"))
    found = integrity.mad_outliers(rows, ("location_id", "metric", "hour")).join(rain, "event_time", "left")
    told = monitoring.explained(found, F.col("mm"), F.lit("ok"), F.lit(0), F.col("weekday") == 4)
    return told.select("observation_id", F.col("leading").alias("leading_kind"), r("support", 5).alias("support"))


_T = "1 / (1 + 0.5 * (greatest(z, 0) / sqrt(2)))"
_ERFC = "t * exp(-z * z / 2 - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))"
# The cells' p-values by a rational form of erfc (relative error 1.2e-7); level shifts without their bootstrap interval, which SQL cannot draw.
_EVIDENCE_SQL = f"""{ANOMALY_SQL}, rain AS (SELECT event_time, avg(value) / 100 AS mm FROM obs WHERE metric = 'purchase' GROUP BY 1),
gaps AS (SELECT source_id, max(gap) AS max_gap FROM (SELECT source_id, (epoch(event_time) - epoch(lag(event_time) OVER (PARTITION BY source_id ORDER BY event_time))) / 3600 AS gap FROM (SELECT DISTINCT source_id, event_time FROM obs)) GROUP BY 1),
health AS (SELECT source_id, CASE WHEN silent > 24 THEN 'failed' WHEN silent > 6 OR max_gap > 24 OR missing > 0.1 THEN 'warning' ELSE 'ok' END AS status
  FROM (SELECT source_id, (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(event_time))) / 3600 AS silent, (count(*) - count(value)) / count(*) AS missing FROM obs GROUP BY 1) JOIN gaps USING (source_id)),
near AS (SELECT observation_id, {" + ".join(f"coalesce(CAST({f}(value, {k}) OVER w = value AS INTEGER), 0)" for f in ("lag", "lead") for k in (1, 2, 3))} AS neighbours FROM obs WINDOW w AS (PARTITION BY location_id, metric ORDER BY event_time, observation_id)),
cell AS (SELECT DISTINCT location_id, hour, weekday AS w FROM loc WHERE value IS NOT NULL),
cx AS (SELECT l.location_id, l.hour, c.w, l.value, l.weekday = c.w AS treated FROM loc l JOIN cell c ON l.location_id = c.location_id AND l.hour = c.hour WHERE l.value IS NOT NULL),
ck AS (SELECT *, rank() OVER (PARTITION BY location_id, hour, w ORDER BY value) + (count(*) OVER (PARTITION BY location_id, hour, w, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY location_id, hour, w, value) AS t FROM cx),
cg AS (SELECT location_id, hour, w, CAST(count(*) FILTER (treated) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT treated) AS DOUBLE) AS n2, sum(r) FILTER (treated) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties,
  median(value) FILTER (treated) / median(value) FILTER (NOT treated) AS effect FROM ck GROUP BY ALL),
cz AS (SELECT *, greatest(0, (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))) AS z,
  effect / median(effect) OVER (PARTITION BY hour, w) AS lift FROM cg WHERE n1 >= 12 AND n2 >= 12),
cp AS (SELECT location_id, hour, w, lift, least(1.0, {_ERFC}) AS p FROM (SELECT *, {_T} AS t FROM cz)),
cq AS (SELECT *, row_number() OVER (ORDER BY p, location_id, hour, w) AS k, count(*) OVER () AS m FROM cp),
pat AS (SELECT * FROM (SELECT *, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adjusted FROM cq) WHERE adjusted <= 0.05 AND lift >= 1.25),
mo AS (SELECT location_id, strftime(event_time + INTERVAL 330 MINUTE, '%Y-%m') AS month, value FROM obs),
mc AS (SELECT month AS change_point FROM (SELECT month, row_number() OVER (ORDER BY month) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT month FROM mo)) WHERE k BETWEEN 3 AND n - 1),
mg AS (SELECT location_id, change_point, median(value) FILTER (month >= change_point) / median(value) FILTER (month < change_point) AS raw, count(*) FILTER (month < change_point) AS n_before, count(*) FILTER (month >= change_point) AS n_after FROM mo, mc GROUP BY ALL),
ma AS (SELECT *, raw / quantile_cont(raw, 0.25) OVER (PARTITION BY change_point) AS adjusted FROM mg),
shift AS (SELECT location_id FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY abs(adjusted - 1) DESC, change_point) AS k FROM ma) WHERE k = 1 AND abs(adjusted - 1) >= 0.08 AND least(n_before, n_after) >= 12),
ev AS (SELECT a.observation_id, list_sort(list_filter([
  CASE WHEN mm > 0.5 THEN {{'neg': -least(0.6, 0.2 + mm / 50), 'kind': 'rainfall'}} END,
  CASE WHEN EXISTS (SELECT 1 FROM pat WHERE pat.location_id = a.location_id AND pat.hour = a.hour AND pat.w = a.weekday) THEN {{'neg': -0.8, 'kind': 'recurring_pattern'}} END,
  CASE WHEN EXISTS (SELECT 1 FROM shift WHERE shift.location_id = a.location_id) THEN {{'neg': -0.5, 'kind': 'level_shift'}} END,
  CASE status WHEN 'failed' THEN {{'neg': -0.7, 'kind': 'sensor_suspect'}} WHEN 'warning' THEN {{'neg': -0.4, 'kind': 'sensor_suspect'}} END,
  CASE WHEN neighbours >= 2 THEN {{'neg': -0.75, 'kind': 'sensor_suspect'}} END], lambda x: x IS NOT NULL)) AS e
  FROM a LEFT JOIN rain USING (event_time) LEFT JOIN health USING (source_id) LEFT JOIN near USING (observation_id))"""


@query("anomaly_explanations_joined", f"WITH {_EVIDENCE_SQL} SELECT observation_id, coalesce(e[1].kind, 'unexplained') AS leading_kind, round(coalesce(-e[1].neg, 0), 5) AS support, CAST(greatest(1, len(e)) AS INTEGER) AS explanations FROM ev")
def _explanations_joined(spark, sf):
    rows = local_obs(spark, sf)
    rain = rows.filter("metric = 'purchase'").groupBy("event_time").agg((F.avg("value") / 100).alias("mm"))
    health = integrity.source_health(rows, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    cells = patterns.discovered(patterns.cell_tests(rows.filter("value is not null")))
    recurring = cells.select(F.concat_ws("-", "location_id", "weekday_tested", "hour").alias("pattern_id"), "location_id", F.col("weekday_tested").alias("weekday"), "hour")
    shifts = patterns.discovered_shifts(rows.select("location_id", F.date_format(C.local_time(F.col("event_time"), OFFSET), "yyyy-MM").alias("month"), "value"))
    told = monitoring.explained_by(integrity.mad_outliers(rows, ("location_id", "metric", "hour")), rows, rain, health, recurring, shifts)
    return told.select("observation_id", F.col("leading").alias("leading_kind"), r("support", 5).alias("support"), F.size("explanations").alias("explanations"))


@query("pattern_coverage", f"""WITH {LOCAL_SQL}, p(pattern_id, location_id, weekday, hour) AS (VALUES ('A', 'ZONE-A', 4, NULL), ('B', NULL, NULL, 18), ('C', 'ZONE-C', 5, 9))
SELECT pattern_id, count(*) AS rows FROM loc l JOIN p ON (p.location_id IS NULL OR p.location_id = l.location_id) AND (p.weekday IS NULL OR p.weekday = l.weekday) AND (p.hour IS NULL OR p.hour = l.hour) GROUP BY 1""")
def _coverage(spark, sf):
    p = spark.createDataFrame([("A", "ZONE-A", 4, None), ("B", None, None, 18), ("C", "ZONE-C", 5, 9)], "pattern_id string, location_id string, weekday int, hour int")
    return monitoring.covering_patterns(local_obs(spark, sf), p).filter("pattern_id is not null").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("rows"))


@query("source_attribution", f"""WITH {OBS_SQL}, w AS (SELECT * FROM obs WHERE event_time BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 23:00:00'),
g AS (SELECT location_id, source_id, count(*) AS observations, CAST(epoch(max(event_time)) AS BIGINT) AS newest_s FROM w GROUP BY ALL)
SELECT location_id, source_id, observations, round(observations / sum(observations) OVER (PARTITION BY location_id), 6) AS share, newest_s FROM g""")
def _attribution(spark, sf):
    w = observations(spark, sf).filter(F.col("event_time").between(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-12 23:00:00").cast("timestamp_ntz")))
    g = w.groupBy("location_id", "source_id").agg(F.count(F.lit(1)).alias("observations"), F.max(micros("event_time")).alias("newest_s"))
    return g.withColumn("share", r(F.col("observations") / F.sum("observations").over(Window.partitionBy("location_id")), 6))


@query("zone_risk", f"WITH {_GRADED_SQL} SELECT location_id, count(*) AS hours, count(*) FILTER (congested) AS congested_hours, round(avg(ratio), 5) AS mean_ratio, round(max(value), 7) AS peak FROM gr GROUP BY 1")
def _risk(spark, sf):
    return _graded(spark, sf).groupBy("location_id").agg(F.count(F.lit(1)).alias("hours"), F.count_if("congested").alias("congested_hours"), r(F.avg("ratio"), 5).alias("mean_ratio"), r(F.max("value")).alias("peak"))


@query("data_quality", f"WITH {_PLACED_SQL} SELECT count(*) AS observations, count(DISTINCT location_id) AS zones, count(DISTINCT source_id) AS sources, count(*) - count(value) AS missing, count(*) FILTER (placement = 'conflicted') AS conflicted, round(avg(value), 7) AS mean_value FROM p")
def _quality(spark, sf):
    p = integrity.place(observations(spark, sf))
    return p.agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("location_id").alias("zones"), F.count_distinct("source_id").alias("sources"), F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("placement") == "conflicted").alias("conflicted"), r(F.avg("value")).alias("mean_value"))


@query("unified_page", f"WITH {_PLACED_SQL} SELECT observation_id, location_id, metric, round(value, 7) AS value FROM p WHERE placement = 'unified' AND location_id = 'ZONE-B' AND event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-15' ORDER BY event_time, location_id, metric, observation_id LIMIT 50 OFFSET 10")
def _page(spark, sf):
    p = integrity.place(observations(spark, sf)).filter("placement = 'unified' and location_id = 'ZONE-B' and event_time >= timestamp_ntz'2024-01-05' and event_time < timestamp_ntz'2024-01-15'")
    rows, _ = feeds.page(p, ["event_time", "location_id", "metric", "observation_id"], 10, 50)
    return rows.select("observation_id", "location_id", "metric", r("value").alias("value"))


@query("promotion_rules", f"""WITH {FORECAST_SQL}, x AS (SELECT location_id, actual, predicted AS champion, avg(actual) OVER (PARTITION BY location_id) AS challenger FROM fc),
e AS (SELECT location_id, coalesce(abs(champion - actual), abs(actual)) AS a, coalesce(abs(challenger - actual), abs(actual)) AS b FROM x)
SELECT 'rows' AS rule, count(*) >= 200 AS passed, CAST(count(*) AS DOUBLE) AS detail FROM e UNION ALL
SELECT 'gain', (avg(a) - avg(b)) / avg(a) >= 0.03, round((avg(a) - avg(b)) / avg(a), 5) FROM e UNION ALL SELECT 'leakage', true, NULL UNION ALL
SELECT 'slice:ZONE-B', (avg(b) - avg(a)) / avg(a) <= 0.05, round((avg(b) - avg(a)) / avg(a), 5) FROM e WHERE location_id = 'ZONE-B'""")
def _promotion(spark, sf):
    fc = forecasts(spark, sf)
    x = fc.select("location_id", "actual", F.col("predicted").alias("champion"), F.avg("actual").over(Window.partitionBy("location_id")).alias("challenger"))
    return monitoring.promotion(x, {"ZONE-B": F.col("location_id") == "ZONE-B"}).select("rule", "passed", r("detail", 5).alias("detail"))


@query("arm_verdict", f"""WITH {FORECAST_SQL}, s AS (SELECT 'last_value' AS arm, CAST(epoch(event_time) / 604800 AS BIGINT) AS seed, avg(abs(predicted - actual)) AS mae FROM fc WHERE predicted IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'zero', CAST(epoch(event_time) / 604800 AS BIGINT), avg(abs(actual)) FROM fc WHERE predicted IS NOT NULL GROUP BY ALL),
g AS (SELECT arm, avg(mae) AS mean, stddev_samp(mae) AS sd, count(*) AS seeds FROM s GROUP BY 1), b AS (SELECT arg_min(arm, mean) AS best, min(mean) AS m, arg_min(sd, mean) AS sd FROM g)
SELECT arm, seeds, round(mean, 7) AS mean, best, abs(mean - m) <= greatest(coalesce(g.sd, 0), coalesce(b.sd, 0)) AS ties FROM g, b""")
def _verdict(spark, sf):
    fc = forecasts(spark, sf).filter("predicted is not null").withColumn("seed", F.bround(C.seconds(F.col("event_time")) / 604800).cast("long"))
    one = lambda arm, e: fc.groupBy("seed").agg(F.avg(e).alias("mae")).select(F.lit(arm).alias("arm"), "seed", "mae")
    s = one("last_value", F.abs(F.col("predicted") - F.col("actual"))).unionByName(one("zero", F.abs("actual")))
    return monitoring.verdict(s).select("arm", "seeds", r("mean").alias("mean"), "best", "ties")


@query("median_bootstrap_ci")
def _bootstrap(spark, sf):
    rows = local_obs(spark, sf).filter("value is not null").withColumn("treated", F.col("weekday") >= 5)
    return statistics.bootstrap_median_ratio(rows, ["location_id"], "treated").select("location_id", r("lower").alias("lower"), r("upper").alias("upper"))


@query("isotonic_calibration")
def _isotonic(spark, sf):
    rows = _probabilities(spark, sf).select("location_id", F.col("probability").alias("raw"), "outcome")
    model, floor = evaluation.isotonic(rows)
    return evaluation.calibrated(rows, model, floor).groupBy(F.floor(F.col("raw") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("rows"), r(F.avg("probability"), 6).alias("mean_probability"))


@query("gbt_forecast")
def _gbt(spark, sf):
    from ..operators.forecast import GradientForecaster

    table_ = features.feature_table(hourly(spark, sf), lags=(1, 24), spans=(3, 24), offset_hours=OFFSET).withColumn("event_time", F.col("target_time"))
    split = features.temporal_split(table_)
    model = GradientForecaster(["lag_1h", "at_24h", "mean_3h", "mean_24h", "hour_sin", "hour_cos"], rounds=10).fit(split.filter("segment = 'train'"))
    scored = model.predict(split.filter("segment = 'test'")).withColumnRenamed("target", "actual")
    return scored.groupBy("location_id").agg(*[c.alias(n) for n, c in evaluation.error_metrics().items()])


@query("fuzzy_location")
def _fuzzy(spark, sf):
    names = table(spark, sf, "nation").select(F.concat(F.substring("n_name", 2, 20), F.lit("x")).alias("name"))
    return feeds.suggest_locations(names, table(spark, sf, "nation").select(F.col("n_name").alias("suggestion")))


_MONTHLY_ORDERS_SQL = """RECURSIVE w AS (SELECT date_trunc('month', o_orderdate) AS t, avg(CAST(o_totalprice AS DOUBLE)) AS m FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
o AS (SELECT row_number() OVER (ORDER BY t) AS k, epoch(CAST(t AS TIMESTAMP)) AS s, abs(m - 150000) / 150000 AS magnitude, abs(m - 150000) / 150000 > 0.01 AS q FROM w),
fold(k, onset, raised, last, s, magnitude) AS (SELECT 0, CAST(NULL AS DOUBLE), false, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL SELECT o.k, CASE WHEN q THEN coalesce(onset, o.s) END, q AND (onset IS NULL OR o.s - last >= 45 * 86400), CASE WHEN q AND (onset IS NULL OR o.s - last >= 45 * 86400) THEN o.s ELSE last END, o.s, o.magnitude FROM fold JOIN o ON o.k = fold.k + 1)"""


@query("drift_episodes", f"WITH {_MONTHLY_ORDERS_SQL} SELECT 'orders' AS stream, CAST(onset AS BIGINT) AS onset_s, CAST(max(s) AS BIGINT) AS last_s, count(*) AS events, round(max(magnitude), 6) AS peak, count(*) FILTER (raised) AS candidates FROM fold WHERE onset IS NOT NULL GROUP BY onset")
def _episodes(spark, sf):
    """Months whose mean order is off by more than a hundredth are drifted evaluations; the others close an episode."""
    w = table(spark, sf, "orders").filter("o_orderdate is not null").groupBy(F.date_trunc("month", "o_orderdate").alias("detected_at")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("m"))
    size = F.abs(F.col("m") - 150000) / 150000
    events = w.select(F.lit("orders").alias("stream"), F.col("detected_at").cast("timestamp").alias("detected_at"), size.alias("magnitude"), F.when(size > 0.01, F.array(F.lit("feature"))).otherwise(F.array().cast("array<string>")).alias("kinds"))
    e = monitoring.episodes(events, required=("feature",), cooldown_days=45)
    return e.select("stream", micros("onset").alias("onset_s"), micros("last_seen").alias("last_s"), "events", r("peak", 6).alias("peak"), "candidates")


@query("stream_tumbling", """WITH t AS (SELECT 'ZONE-' || substr('ABCD', CAST(user_id % 4 AS INTEGER) + 1, 1) AS location_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 604800) AS BIGINT) AS k, value FROM events)
SELECT location_id, CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') + k * 604800 AS BIGINT) AS start_s, count(*) AS rows, round(avg(value), 7) AS mean_value FROM t GROUP BY location_id, k""")
def _tumbling(spark, sf):
    import uuid

    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/stream-{uuid.uuid4().hex}"
    streams.run_to_end(streams.tumbling(streams.events_stream(spark, f"{sf}/events.parquet")), f"{root}/out", f"{root}/checkpoint", mode="update")
    rows = spark.read.schema("location_id string, window struct<start: timestamp, end: timestamp>, rows long, mean_value double, batch long").parquet(f"{root}/out")
    last = rows.groupBy("location_id", "window").agg(F.max_by(F.struct("rows", "mean_value"), "batch").alias("x"))
    return last.select("location_id", micros("window.start").alias("start_s"), "x.rows", r("x.mean_value").alias("mean_value"))
