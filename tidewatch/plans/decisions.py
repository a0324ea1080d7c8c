"""Registered queries on normalisation, publication, drift decisions, replays and explanations, with their oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import adaptation, adaptive, attribution, evaluation, features, forecast, integrity, monitor, monitoring, normalise, output, patterns, statistics
from ..sources import artifacts, feeds
from ..streaming import replay, streams
from .catalog import ANOMALY_SQL, ORACLES, QUERIES, FORECAST_SQL, HOURLY_SQL, LOCAL_SQL, OFFSET, forecasts, hourly, local_obs, micros, query, r
from .observations import OBS_SQL, observations, recency_band

# observation keys and normalisation

_KEYED_SQL = f"""{OBS_SQL}, k AS (SELECT *, CAST(substr(observation_id, 5) AS BIGINT) AS n FROM obs),
o6 AS (SELECT location_id, event_time, metric, CASE n % 3 WHEN 0 THEN 'vehicles/15min' ELSE 'vehicles/hour' END AS unit, CASE WHEN n % 5 = 0 THEN NULL ELSE 60 END AS duration_minutes,
  CASE WHEN n % 5 = 0 THEN 'instant' ELSE 'hourly' END AS aggregation_level, observation_id, received_time, source_time, value FROM k)"""


@query("six_part_keys", f"""WITH {_KEYED_SQL}, g AS (SELECT location_id, event_time, metric, unit, duration_minutes, aggregation_level, count(*) AS members,
  arg_min(observation_id, (received_time, observation_id)) AS representative_id, coalesce(max(value) - min(value) > greatest(0.5, 0.05 * max(abs(value))), false) AS dissent FROM o6 GROUP BY ALL)
SELECT location_id, CAST(epoch(event_time) AS BIGINT) AS event_s, metric, unit, duration_minutes, aggregation_level, members, representative_id, CASE WHEN members = 1 THEN 'unified' WHEN dissent THEN 'conflicted' ELSE 'duplicate' END AS placement FROM g""")
def _six_part(spark, sf):
    n = F.expr("cast(substr(observation_id, 5) as bigint)")
    rows = observations(spark, sf).withColumns({
        "unit": F.when(n % 3 == 0, "vehicles/15min").otherwise("vehicles/hour"), "duration_minutes": F.when(n % 5 != 0, 60), "aggregation_level": F.when(n % 5 == 0, "instant").otherwise("hourly"),
    })
    return integrity.key_groups(rows).select("location_id", micros("event_time").alias("event_s"), "metric", "unit", "duration_minutes", "aggregation_level", "members", "representative_id", "placement")


def _raw(spark, sf) -> DataFrame:
    """Observations under their sources' names for metrics and units."""
    n = F.expr("cast(substr(observation_id, 5) as bigint)")
    rows = observations(spark, sf).withColumn("n", n)
    metric = F.when(F.col("metric") == "view", F.when(n % 2 == 0, " Traffic-Volume ").otherwise("VIEWS")).otherwise(F.col("metric"))
    unit = F.element_at(F.array(*map(F.lit, ("veh/h", "VPH", "vehicles/15min", "mm", "furlong", "vehicles/minute"))), (n % 6 + 1).cast("int"))
    return rows.withColumns({"metric": metric, "unit": unit})


def _metrics(spark) -> DataFrame:
    rows = [("traffic_volume", ["views", "volume"], "vehicles/hour", ["veh/h", "vph", "vehicles/15min"], 0.0, 1500.0, True)]
    return spark.createDataFrame(rows, "metric string, aliases array<string>, canonical_unit string, accepted_units array<string>, minimum double, maximum double, non_negative boolean")


@query("normalised_metrics", f"""WITH {OBS_SQL}, n AS (SELECT *, CAST(substr(observation_id, 5) AS BIGINT) AS n FROM obs),
x AS (SELECT metric AS m, value, ['veh/h', 'VPH', 'vehicles/15min', 'mm', 'furlong', 'vehicles/minute'][CAST(n % 6 AS INTEGER) + 1] AS unit FROM n),
c AS (SELECT *, m = 'view' AS known, CASE unit WHEN 'vehicles/15min' THEN value * 4.0 WHEN 'vehicles/minute' THEN value * 60.0 ELSE value END AS v FROM x),
j AS (SELECT *, CASE WHEN NOT known THEN 'valid' WHEN unit IN ('mm', 'furlong', 'vehicles/minute') THEN 'unknown_unit' WHEN v < 0 OR v > 1500 THEN 'invalid_value' ELSE 'valid' END AS outcome FROM c)
SELECT CASE WHEN known THEN 'traffic_volume' ELSE m END AS metric, outcome, count(*) AS rows, count(*) FILTER (known AND outcome = 'valid' AND unit = 'vehicles/15min') AS converted,
  round(sum(CASE WHEN outcome = 'valid' AND known THEN v ELSE value END), 3) AS total FROM j GROUP BY ALL""")
def _normalised(spark, sf):
    valid, rejected = normalise.normalised(normalise.resolve_metrics(_raw(spark, sf), _metrics(spark)))
    both = valid.select("metric", F.lit("valid").alias("outcome"), F.col("original_unit").isNotNull().cast("long").alias("c"), "value").unionByName(
        rejected.select(F.col("canonical_metric").alias("metric"), F.col("reason").alias("outcome"), F.lit(0).cast("long").alias("c"), "value")
    )
    return both.groupBy("metric", "outcome").agg(F.count(F.lit(1)).alias("rows"), F.sum("c").alias("converted"), r(F.sum("value"), 3).alias("total"))


@query("pre_quarantine_population", f"""WITH {OBS_SQL}, v AS (SELECT observation_id, value FROM obs WHERE value <= 400), q AS (SELECT observation_id, value + 1 AS value FROM obs WHERE value > 380),
u AS (SELECT * FROM v UNION ALL SELECT * FROM q WHERE observation_id NOT IN (SELECT observation_id FROM v))
SELECT count(*) AS rows, count(DISTINCT observation_id) AS ids, round(sum(value), 2) AS total, (SELECT count(*) FROM v JOIN q USING (observation_id)) AS shared, (SELECT count(*) FROM v JOIN q USING (observation_id)) = 0 AS disjoint FROM u""")
def _population(spark, sf):
    obs = observations(spark, sf).select("observation_id", "value")
    valid, bad = obs.filter("value <= 400"), obs.filter("value > 380").withColumn("value", F.col("value") + 1)
    u = normalise.union_first(valid, bad).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("observation_id").alias("ids"), r(F.sum("value"), 2).alias("total"))
    return u.crossJoin(normalise.disjoint(valid, bad)).select("rows", "ids", "total", "shared", "disjoint")


@query("counts_by_recency", f"WITH {OBS_SQL}, b AS (SELECT CASE WHEN epoch(received_time) - epoch(event_time) <= 7200 THEN 'current' WHEN floor(epoch(received_time)) - epoch(event_time) <= 172800 THEN 'recent' ELSE 'historical' END AS band FROM obs), d(band) AS (VALUES ('current'), ('recent'), ('historical'), ('future')) SELECT d.band, count(b.band) AS rows FROM d LEFT JOIN b USING (band) GROUP BY 1")
def _counts(spark, sf):
    rows = observations(spark, sf).select(recency_band().alias("band"))
    return normalise.counts_by(rows, "band", ["current", "recent", "historical", "future"])


_FROZEN_SQL = f"""{OBS_SQL}, q AS (SELECT *, CASE WHEN floor(value / 50) <> 0 THEN floor(value / 50) END AS v FROM obs), f1 AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY source_id, location_id, metric ORDER BY event_time, observation_id)),
f2 AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, location_id, metric ORDER BY event_time, observation_id ROWS UNBOUNDED PRECEDING) AS run FROM f1), f3 AS (SELECT source_id, location_id, metric, run, count(*) AS length FROM f2 WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) >= 4)"""


def _steps(spark, sf) -> DataFrame:
    return observations(spark, sf).withColumn("step", F.floor(F.col("value") / 50).cast("double"))


@query("frozen_membership", f"WITH {_FROZEN_SQL} SELECT (SELECT count(*) FROM obs) - coalesce(sum(length), 0)::BIGINT AS outside, coalesce(sum(length), 0)::BIGINT AS inside, count(*) AS runs FROM f3")
def _membership(spark, sf):
    by = ("source_id", "location_id", "metric")
    out, inside = integrity.frozen_members(_steps(spark, sf), by, F.col("step"), 4)
    runs = integrity.frozen_runs(_steps(spark, sf), by, F.col("step"), 4)
    one = lambda t, name: t.agg(F.count(F.lit(1)).alias(name))
    return one(out, "outside").crossJoin(one(inside, "inside")).crossJoin(one(runs, "runs"))  # one row each


@query("assessed_sources", f"""WITH {_FROZEN_SQL}, fr AS (SELECT source_id, count(*) AS runs, sum(length)::BIGINT AS n FROM f3 GROUP BY 1), t AS (SELECT DISTINCT source_id, event_time FROM obs), gp AS (SELECT source_id, max(gap) AS gap FROM (SELECT source_id, (epoch(event_time) - epoch(lag(event_time) OVER (PARTITION BY source_id ORDER BY event_time))) / 3600 AS gap FROM t) GROUP BY 1),
b AS (SELECT source_id, count(*) AS observations, count(*) - count(value) AS missing, (epoch(TIMESTAMP '2024-01-31 06:30:00') - epoch(max(event_time))) / 3600 AS silent FROM obs GROUP BY 1),
j AS (SELECT b.*, CASE WHEN gap > 1 THEN gap END AS gap, coalesce(runs, 0) AS frozen_runs, coalesce(n, 0) AS frozen_observations FROM b JOIN gp USING (source_id) LEFT JOIN fr USING (source_id))
SELECT source_id, observations, frozen_runs, frozen_observations, round(silent, 4) AS silent, round(gap, 4) AS gap,
 CASE WHEN frozen_runs > 0 OR silent > 24 THEN 'failed' WHEN gap > 24 OR silent > 6 OR gap > 6 OR missing / observations > 0.1 THEN 'warning' ELSE 'ok' END AS status FROM j""")
def _assessed(spark, sf):
    runs = integrity.frozen_runs(_steps(spark, sf), ("source_id", "location_id", "metric"), F.col("step"), 4)
    h = integrity.assessed_sources(observations(spark, sf), runs, F.lit("2024-01-31 06:30:00").cast("timestamp_ntz"), 1.0)
    return h.select("source_id", "observations", "frozen_runs", "frozen_observations", r("trailing_gap_hours", 4).alias("silent"), r("max_gap_hours", 4).alias("gap"), "status")


@query("row_invariants", f"WITH {OBS_SQL}, n AS (SELECT *, CAST(substr(observation_id, 5) AS BIGINT) AS n FROM obs) SELECT count(*) AS rows, count(*) FILTER (n % 11 <> 0 OR n % 22 = 0) AS received, count(*) FILTER (event_time <= TIMESTAMP '2024-01-20 00:05:00' OR n % 22 = 0) AS past, count(*) FILTER (NOT (n % 7 = 0 AND n % 14 <> 0)) AS imputation, count(*) FILTER (n % 13 <> 0) AS linked, count(*) FILTER (n % 22 <> 0 OR n % 44 = 0) AS reasoned FROM n")
def _row_invariants(spark, sf):
    n = F.expr("cast(substr(observation_id, 5) as bigint)")
    rows = observations(spark, sf).withColumns({
        "received_time": F.when(n % 11 == 0, F.col("event_time") - features.hours(1)).otherwise(F.col("received_time")), "status": F.when(n % 22 == 0, "quarantined").otherwise("valid"),
        "is_imputed": n % 7 == 0, "imputation_method": F.when(n % 14 == 0, "mean"), "links": F.array(F.when(n % 13 == 0, F.col("observation_id")).otherwise("other")), "quarantine_reason": F.when(n % 44 == 0, "invalid_value").otherwise(""),
    })
    c = integrity.row_invariants(rows, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return c.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(k)).alias(v) for k, v in (("received_after_event", "received"), ("not_in_the_future", "past"), ("imputation_declared", "imputation"), ("no_self_link", "linked"), ("quarantine_has_reason", "reasoned"))])


# feature tables

_CONFIG = {"target_metric": "view", "horizon_hours": 1, "calendar": list(features.CALENDAR), "lags": [1, 24, 168], "seasonal_lags": [24, 168], "rolling_means": [3, 24, 168], "covariates": [{"metric": "rain", "location": "CITY"}, {"metric": "rain", "location": "CITY", "window_hours": 24}], "include_zone": True}


def _series(spark, sf) -> DataFrame:
    """Hourly means of views by zone, and of purchases over the city as rain."""
    obs = observations(spark, sf)
    views = obs.filter("metric = 'view'").groupBy("location_id", "event_time").agg(F.avg("value").alias("value")).withColumn("metric", F.lit("view"))
    rain = obs.filter("metric = 'purchase'").groupBy("event_time").agg(F.avg("value").alias("value")).withColumns({"metric": F.lit("rain"), "location_id": F.lit("CITY")})
    return views.unionByName(rain)


_SERIES_SQL = f"""{OBS_SQL}, view AS (SELECT location_id, event_time, avg(value) AS value FROM obs WHERE metric = 'view' GROUP BY ALL), rain AS (SELECT event_time, avg(value) AS value FROM obs WHERE metric = 'purchase' GROUP BY 1),
z AS (SELECT location_id, CAST(row_number() OVER (ORDER BY location_id) - 1 AS INTEGER) AS zone FROM (SELECT DISTINCT location_id FROM view))"""
_at = lambda h: f"(SELECT b.value FROM view b WHERE b.location_id = a.location_id AND b.event_time = a.event_time - INTERVAL {h} HOUR)"
_mean = lambda h, t="view", own=" AND b.location_id = a.location_id": f"(SELECT CASE WHEN count(b.value) >= 2 THEN avg(b.value) END FROM {t} b WHERE b.event_time >= a.event_time - INTERVAL {h} HOUR AND b.event_time < a.event_time{own})"
_TARGET_SQL = f"""SELECT location_id, CAST(epoch(event_time) AS BIGINT) AS target_s, zone, round(value, 7) AS target, {", ".join(f"round({_at(h)}, 7) AS {n}" for n, h in (("lag_1h", 2), ("lag_24h", 25), ("lag_168h", 169), ("seasonal_lag_24h", 24), ("seasonal_lag_168h", 168)))},
 {", ".join(f"round({_mean(h)} + 3e-8, 7) AS roll_mean_{h}h" for h in (3, 24, 168))}, (SELECT round(value, 7) FROM rain b WHERE b.event_time = a.event_time - INTERVAL 1 HOUR) AS rain_0h, round({_mean(24, "rain", "")} + 3e-8, 7) AS rain_roll_24h,
 CAST(hour(event_time + INTERVAL 330 MINUTE) AS INTEGER) AS hour, CAST(isodow(event_time + INTERVAL 330 MINUTE) - 1 AS INTEGER) AS weekday, CAST(month(event_time + INTERVAL 330 MINUTE) AS INTEGER) AS month,
 round(sin((month(event_time + INTERVAL 330 MINUTE) - 1) * 2 * pi() / 12), 6) + 0.0 AS month_sin, round(cos((month(event_time + INTERVAL 330 MINUTE) - 1) * 2 * pi() / 12), 6) + 0.0 AS month_cos FROM view a JOIN z USING (location_id) WHERE value IS NOT NULL"""


def _declared(spark, sf) -> DataFrame:
    return features.build_features(_series(spark, sf), features.feature_specs(_CONFIG), "view", 1, OFFSET)


@query("declared_features", f"WITH {_SERIES_SQL} {_TARGET_SQL}")
def _declared_query(spark, sf):
    """The nineteen declared features (is_weekend and the hour's cycle are in calendar_features)."""
    t = _declared(spark, sf)
    means = [r(F.col(c) + 3e-8).alias(c) for c in ("roll_mean_3h", "roll_mean_24h", "roll_mean_168h", "rain_roll_24h")]
    plain = [r(c).alias(c) for c in ("target", "lag_1h", "lag_24h", "lag_168h", "seasonal_lag_24h", "seasonal_lag_168h", "rain_0h")]
    return t.select("location_id", micros("target_time").alias("target_s"), "zone", *plain, *means, "hour", "weekday", "month", *[(r(c, 6) + 0.0).alias(c) for c in ("month_sin", "month_cos")])


@query("feature_missing_counts", f"WITH {_SERIES_SQL}, f AS ({_TARGET_SQL}) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(*) AS rows FROM f" for c in ("lag_1h", "lag_168h", "roll_mean_3h", "rain_0h")))
def _missing(spark, sf):
    return features.missing_counts(_declared(spark, sf), ["lag_1h", "lag_168h", "roll_mean_3h", "rain_0h"])


# publication

_TH_SQL = f"{FORECAST_SQL}, th AS (SELECT location_id, quantile_cont(value, 0.75) AS threshold FROM hourly GROUP BY 1), sg AS (SELECT greatest(1e-6, stddev_pop(actual - predicted)) AS sigma FROM fc WHERE predicted IS NOT NULL)"
# erf(x) = exp(-x^2) * sum of x^(2n+1) / gamma(n + 3/2)
_SF = "0.5 * (1 - exp(-z * z / 2) * list_sum(list_transform(range(80), lambda n: pow(z / sqrt(2), 2 * n + 1) / gamma(n + 1.5))))"
_PUBLISHED_SQL = f"""{_TH_SQL}, iv AS (SELECT location_id, quantile_cont(actual - predicted, 0.1) AS lo, quantile_cont(actual - predicted, 0.9) AS hi FROM fc WHERE predicted IS NOT NULL GROUP BY 1),
pz AS (SELECT fc.*, threshold, lo, hi, (threshold - predicted) / sigma AS z FROM fc JOIN th USING (location_id) JOIN iv USING (location_id), sg WHERE predicted IS NOT NULL),
pub AS (SELECT location_id, event_time, actual, predicted, threshold, {_SF} AS probability, greatest(0.0, predicted + lo) AS interval_lower, predicted + hi AS interval_upper,
  CASE WHEN predicted / threshold >= 1.8 THEN 'severe' WHEN predicted / threshold >= 1.3 THEN 'high' WHEN predicted / threshold >= 1.0 THEN 'moderate' ELSE 'low' END AS severity FROM pz)"""


def _published(spark, sf) -> DataFrame:
    fc = forecasts(spark, sf).filter("predicted is not null").withColumnRenamed("event_time", "target_time")
    sigma = evaluation.residual_sigma(fc).first()["sigma"]  # one number
    limits = evaluation.thresholds(hourly(spark, sf), 0.75)
    return output.predictions(fc, limits, evaluation.residual_intervals(fc), sigma, "last-value", OFFSET)


@query("prediction_records", f"WITH {_PUBLISHED_SQL} SELECT location_id, CAST(epoch(event_time) AS BIGINT) AS target_s, round(predicted, 6) AS predicted, round(threshold, 6) AS threshold, round(probability, 5) AS probability, severity, round(interval_lower, 6) AS interval_lower, round(interval_upper, 6) AS interval_upper, round(greatest(0.0, least(1.0, 1 - (interval_upper - interval_lower) / predicted)), 6) AS confidence, false AS calibrated FROM pub")
def _records(spark, sf):
    p = _published(spark, sf)
    return p.select("location_id", micros("target_time").alias("target_s"), *[r(c, 6).alias(c) for c in ("predicted", "threshold", "interval_lower", "interval_upper", "confidence")], r("probability", 5).alias("probability"), "severity", "calibrated")


@query("predictions_of_a_day", f"WITH {_PUBLISHED_SQL} SELECT location_id, CAST(epoch(event_time) AS BIGINT) AS target_s, round(predicted, 6) AS predicted FROM pub WHERE location_id = 'ZONE-B' AND CAST(event_time AS DATE) = DATE '2024-01-10'")
def _day(spark, sf):
    p = output.on_date(output.selected(_published(spark, sf), location_id="ZONE-B", model_version="last-value", severity=None), "target_time", "2024-01-10")
    return p.select("location_id", micros("target_time").alias("target_s"), r("predicted", 6).alias("predicted"))


_OUTCOME_SQL = f"{_PUBLISHED_SQL}, rain AS (SELECT event_time, avg(value) / 100 AS mm FROM obs WHERE metric = 'purchase' GROUP BY 1), oc AS (SELECT pub.*, mm, predicted > threshold AS said, actual > threshold AS was, abs(predicted - actual) AS error FROM pub LEFT JOIN rain USING (event_time))"


def _outcomes(spark, sf) -> DataFrame:
    actuals = hourly(spark, sf).select("location_id", F.col("event_time").alias("target_time"), F.col("value").alias("actual"))
    rain = observations(spark, sf).filter("metric = 'purchase'").groupBy("event_time").agg((F.avg("value") / 100).alias("mm"))
    return output.outcomes(_published(spark, sf), actuals, rain)


@query("outcome_breakdowns", f"""WITH {_OUTCOME_SQL}, d AS (SELECT *, CASE WHEN mm IS NULL THEN 'unknown' WHEN mm < 0.1 THEN 'dry' WHEN mm <= 10 THEN 'light' ELSE 'heavy' END AS rain, isodow(event_time + INTERVAL 330 MINUTE) = 5 AND hour(event_time + INTERVAL 330 MINUTE) BETWEEN 18 AND 19 AS friday FROM oc)
SELECT 'rainfall' AS dimension, rain AS member, count(*) AS rows, round(avg(error), 6) AS mae FROM d GROUP BY rain UNION ALL SELECT 'severity', severity, count(*), round(avg(error), 6) FROM d GROUP BY severity
UNION ALL SELECT 'friday_evening', CAST(friday AS VARCHAR), count(*), round(avg(error), 6) FROM d GROUP BY friday UNION ALL SELECT 'overall', 'all', count(*), round(avg(error), 6) FROM d""")
def _outcome_breakdowns(spark, sf):
    dims = {"rainfall": C.rain_band(F.col("rainfall_mm")), "severity": F.col("severity"), "friday_evening": (F.col("weekday") == 4) & F.col("local_hour").between(18, 19)}
    return evaluation.error_breakdowns(_outcomes(spark, sf), dims).select("dimension", "member", "rows", r("mae", 6).alias("mae"))


@query("zone_risk_panel", f"""WITH {_OUTCOME_SQL}, g AS (SELECT location_id, round(avg(probability), 5) AS risk, round(avg(error), 6) AS mae, count(*) AS predictions, count(*) FILTER (was) AS congested_hours FROM oc WHERE location_id <> 'ZONE-D' GROUP BY 1), zn(location_id, latitude) AS (VALUES ('ZONE-A', 12.9), ('ZONE-B', 13.0), ('ZONE-X', 13.1))
SELECT location_id, risk, mae, coalesce(predictions, 0) AS predictions, coalesce(congested_hours, 0) AS congested_hours, CAST(latitude AS DOUBLE) AS latitude FROM g FULL JOIN zn USING (location_id)""")
def _panel(spark, sf):
    zones = spark.createDataFrame([("ZONE-A", 12.9), ("ZONE-B", 13.0), ("ZONE-X", 13.1)], "location_id string, latitude double")
    g = output.zone_risk(_outcomes(spark, sf).filter("location_id <> 'ZONE-D'"), zones)
    return g.select("location_id", r("risk", 5).alias("risk"), r("mae", 6).alias("mae"), "predictions", "congested_hours", "latitude")


@query("calibration_summary", f"""WITH {_OUTCOME_SQL}, c AS (SELECT probability AS p, round(probability, 1) AS q, CAST(was AS INTEGER) AS y FROM oc), b AS (SELECT count(*) AS n, avg(y) - avg(q) AS gap FROM c GROUP BY least(floor(q * 10), 9)),
s AS (SELECT count(*) AS rows, avg(y) AS base_rate, avg(pow(p - y, 2)) AS raw, avg(pow(q - y, 2)) AS cal, avg(pow(0.3 - y, 2)) AS ref FROM c), e AS (SELECT sum(n * abs(gap)) / sum(n) AS ece, sum(n * gap) AS lean FROM b)
SELECT rows, round(base_rate, 5) AS base_rate, round(raw, 4) AS raw_brier, round(cal, 4) AS calibrated_brier, round(ref, 5) AS reference_brier, cal <= raw AS improved, cal < ref AS beats_base_rate, CASE WHEN ece < 0.02 THEN 'well matched' WHEN lean > 0 THEN 'under-confident' ELSE 'over-confident' END AS direction, false AS in_sample FROM s, e""")
def _calibration(spark, sf):
    rows = _outcomes(spark, sf).select(F.col("probability").alias("raw"), F.round("probability", 1).alias("cal"), "congested_actual")
    s = evaluation.calibration_report(rows, "raw", "cal", "congested_actual", 0.3, "test", "validation")
    return s.select("rows", r("base_rate", 5).alias("base_rate"), r("raw_brier", 4).alias("raw_brier"), r("calibrated_brier", 4).alias("calibrated_brier"), r("reference_brier", 5).alias("reference_brier"), "improved", "beats_base_rate", "direction", "in_sample")


@query("input_attribution", f"""WITH {OBS_SQL}, s AS (SELECT DISTINCT location_id, event_time AS t FROM obs WHERE metric = 'view' AND hour(event_time) = 6),
u AS (SELECT DISTINCT s.location_id, s.t, o.observation_id, o.source_id, o.event_time FROM s JOIN obs o ON o.location_id = s.location_id AND o.value IS NOT NULL AND ((o.metric = 'view' AND o.event_time BETWEEN s.t - INTERVAL 24 HOUR AND s.t) OR (o.metric = 'click' AND o.event_time = s.t - INTERVAL 3 HOUR))),
g AS (SELECT location_id, t, source_id, count(*) AS observations, max(event_time) AS newest FROM u GROUP BY ALL)
SELECT location_id, CAST(epoch(t) AS BIGINT) AS sample_s, source_id, observations, round(observations / sum(observations) OVER (PARTITION BY location_id, t), 6) AS share, CAST(epoch(newest) AS BIGINT) AS newest_s FROM g""")
def _inputs(spark, sf):
    obs = observations(spark, sf)
    samples = obs.filter((F.col("metric") == "view") & (F.hour("event_time") == 6)).select("location_id", F.col("event_time").alias("sample_time"))
    found = output.attributed(obs, samples, [("roll_mean_24h", "view", 24, 0), ("lag_1h", "view", 1, 1), ("click_3h", "click", 3, 3)])
    return found.select("location_id", micros("sample_time").alias("sample_s"), "source_id", "observations", r("share", 6).alias("share"), micros("newest").alias("newest_s"))


_CITY_SQL = f"""{OBS_SQL}, s AS (SELECT DISTINCT location_id, event_time AS t FROM obs WHERE metric = 'view' AND hour(event_time) = 6),
reach(feature, metric, first, last, place) AS (VALUES ('roll_mean_24h', 'view', 24, 0, NULL), ('city_click_6h', 'click', 6, 0, 'ZONE-D'), ('lag_700h', 'view', 700, 700, NULL)),
asked AS (SELECT location_id, t, feature, metric, first, last, coalesce(place, location_id) AS place FROM s, reach),
hit AS (SELECT a.*, o.observation_id, o.source_id, o.event_time FROM asked a JOIN obs o ON o.location_id = a.place AND o.metric = a.metric AND o.value IS NOT NULL AND (epoch(a.t) - epoch(o.event_time)) / 3600 BETWEEN a.last AND a.first)"""
_CITY_REACH = [("roll_mean_24h", "view", 24, 0), ("city_click_6h", "click", 6, 0, "ZONE-D"), ("lag_700h", "view", 700, 700)]


def _city(spark, sf, make) -> DataFrame:
    obs = observations(spark, sf)
    samples = obs.filter((F.col("metric") == "view") & (F.hour("event_time") == 6)).select("location_id", F.col("event_time").alias("sample_time"))
    return make(obs, samples, _CITY_REACH)


@query("covariate_sources", f"""WITH {_CITY_SQL}, g AS (SELECT location_id, t, source_id, count(DISTINCT observation_id) AS observations, max(event_time) AS newest, min(event_time) AS oldest FROM hit GROUP BY ALL)
SELECT location_id, CAST(epoch(t) AS BIGINT) AS sample_s, source_id, observations, round(observations / sum(observations) OVER (PARTITION BY location_id, t), 6) AS share, CAST(epoch(newest) AS BIGINT) AS newest_s, CAST(epoch(oldest) AS BIGINT) AS oldest_s FROM g""")
def _covariate_sources(spark, sf):
    """Sources of predictions that also read the clicks of another place."""
    return _city(spark, sf, output.attributed).select("location_id", micros("sample_time").alias("sample_s"), "source_id", "observations", r("share", 6).alias("share"), micros("newest").alias("newest_s"), micros("oldest").alias("oldest_s"))


@query("missing_inputs", f"WITH {_CITY_SQL} SELECT location_id, CAST(epoch(t) AS BIGINT) AS sample_s, string_agg(feature, ',' ORDER BY feature) AS features FROM asked a WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.location_id = a.location_id AND h.t = a.t AND h.feature = a.feature) GROUP BY ALL")
def _missing_inputs(spark, sf):
    return _city(spark, sf, output.missing_inputs).select("location_id", micros("sample_time").alias("sample_s"), F.array_join("features", ",").alias("features"))


@query("overview_counters", f"WITH {OBS_SQL} SELECT count(*) AS observations, (SELECT count(DISTINCT source_id) FROM obs) AS sources, CAST(NULL AS BIGINT) AS models, (SELECT count(*) FROM obs WHERE value > 480) AS high FROM obs")
def _overview(spark, sf):
    obs = observations(spark, sf)
    return output.overview(observations=obs, sources=obs.select("source_id").distinct(), models=None, high=obs.filter("value > 480"))


@query("provenance_by_record", f"WITH {OBS_SQL}, i(identifier) AS (VALUES ('OBS-5'), ('17'), ('23'), ('no-such')) SELECT identifier, observation_id FROM i JOIN obs ON observation_id IN (identifier, 'OBS-' || identifier)")
def _by_record(spark, sf):
    ids = spark.createDataFrame([("OBS-5",), ("17",), ("23",), ("no-such",)], "identifier string")
    return integrity.by_identifier(observations(spark, sf), ids)


# drift

_ORIGIN = "2024-01-01 00:00:00"
_DRIFT_SQL = f"""{FORECAST_SQL}, f AS (SELECT *, CAST(floor((epoch(event_time) - epoch(TIMESTAMP '{_ORIGIN}')) / 259200) AS INTEGER) AS w FROM fc WHERE predicted IS NOT NULL),
e AS (SELECT quantile_cont(predicted, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges, count(*) AS n0, avg(abs(predicted - actual)) AS mae0 FROM f WHERE w < 3),
c AS (SELECT w, len(list_filter(edges, lambda x: x <= predicted)) AS bin FROM f, e), a AS (SELECT bin, count(*) / (SELECT n0 FROM e) AS p FROM c WHERE w < 3 GROUP BY 1),
m AS (SELECT w, count(*) AS n FROM f WHERE w >= 3 GROUP BY 1), q AS (SELECT w, bin, count(*) AS k FROM c WHERE w >= 3 GROUP BY ALL),
x AS (SELECT m.w, m.n, g.bin, greatest(coalesce(a.p, 0), 1e-6) AS p, greatest(coalesce(q.k, 0) / m.n, 1e-6) AS q FROM m CROSS JOIN (SELECT unnest(range(10)) AS bin) g LEFT JOIN a USING (bin) LEFT JOIN q ON q.w = m.w AND q.bin = g.bin),
psi AS (SELECT w, any_value(n) AS n, sum((q - p) * ln(q / p)) AS psi FROM x GROUP BY w), per AS (SELECT w, avg(abs(predicted - actual)) / (SELECT mae0 FROM e) AS ratio FROM f WHERE w >= 3 GROUP BY w),
s AS (SELECT w, n, psi, ratio, CASE WHEN psi >= 0.05 THEN 'drifted' WHEN psi >= 0.025 THEN 'minor' ELSE 'stable' END AS pred, CASE WHEN ratio >= 1.02 THEN 'drifted' WHEN ratio >= 1.01 THEN 'minor' ELSE 'stable' END AS perf FROM psi JOIN per USING (w)),
ev AS (SELECT w, CASE WHEN n < 50 THEN [] ELSE list_filter([CASE WHEN perf = 'drifted' THEN 'performance' END, CASE WHEN pred = 'drifted' THEN 'prediction' END], lambda k: k IS NOT NULL) END AS kinds,
  greatest(CASE WHEN n >= 50 AND pred = 'drifted' THEN psi / 0.05 END, CASE WHEN n >= 50 AND perf = 'drifted' THEN ratio / 1.02 END) AS magnitude FROM s)"""


def evaluations(spark, sf) -> DataFrame:
    """Three-day windows of the last-value forecast against the first nine days: prediction and performance signals, as evaluations."""
    fc = forecasts(spark, sf).filter("predicted is not null")
    w = F.floor((C.seconds(F.col("event_time")) - C.seconds(F.lit(_ORIGIN).cast("timestamp"))) / (3 * 86400)).cast("int")
    rows = fc.withColumn("w", w)
    reference, recent = rows.filter("w < 3"), rows.filter("w >= 3")
    error = F.avg(F.abs(F.col("predicted") - F.col("actual")))
    base = reference.agg(error.alias("base"))  # one row
    psi = statistics.psi_windows(reference, recent, "predicted", "w")
    both = psi.join(recent.groupBy("w").agg(error.alias("mae")), "w").crossJoin(F.broadcast(base)).withColumn("ratio", F.col("mae") / F.col("base"))
    thin = F.col("rows") < 50
    signal = lambda kind, status, value, gate: F.struct(F.lit(kind).alias("kind"), F.lit(kind).alias("subject"), F.when(thin, "insufficient_data").otherwise(status).alias("status"), value.alias("statistic"), F.lit(gate).alias("threshold"))
    told = F.array(
        signal("prediction", monitoring.prediction_status(F.col("psi"), F.lit(0.05)), F.col("psi"), 0.05),
        signal("performance", monitoring.performance_status(F.col("ratio"), F.lit(1.02), F.col("rows")), F.col("ratio"), 1.02),
    )
    at = F.timestamp_seconds(C.seconds(F.lit(_ORIGIN).cast("timestamp")) + (F.col("w") + 1) * (3 * 86400))
    return monitoring.fired(both.select(F.lit("champion").alias("stream"), at.alias("detected_at"), F.explode(told).alias("s")).select("stream", "detected_at", "s.*"))


@query("drift_evaluations", f"WITH {_DRIFT_SQL} SELECT CAST(epoch(TIMESTAMP '{_ORIGIN}') + (w + 1) * 259200 AS BIGINT) AS detected_s, array_to_string(kinds, ',') AS kinds, len(kinds) > 0 AS is_drift, round(magnitude, 4) AS magnitude FROM ev")
def _evaluations(spark, sf):
    return evaluations(spark, sf).select(micros("detected_at").alias("detected_s"), F.array_join("kinds", ",").alias("kinds"), "is_drift", r("magnitude", 4).alias("magnitude"))


_SIGNALS_SQL = f"""{FORECAST_SQL}, f AS (SELECT *, CAST(floor((epoch(event_time) - epoch(TIMESTAMP '{_ORIGIN}')) / 259200) AS INTEGER) AS w FROM fc),
u AS (SELECT w, unnest([{{'s': 'prediction', 'v': predicted}}, {{'s': 'level', 'v': actual}}, {{'s': 'swing', 'v': actual - predicted}}]) AS x FROM f), l AS (SELECT w, x.s AS s, x.v AS v FROM u WHERE x.v IS NOT NULL),
e AS (SELECT s, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges, count(*) AS n0 FROM l WHERE w < 3 GROUP BY s), b AS (SELECT w, s, v, n0, len(list_filter(edges, lambda x: x <= v)) AS bin FROM l JOIN e USING (s)),
a AS (SELECT s, bin, count(*) / any_value(n0) AS p FROM b WHERE w < 3 GROUP BY ALL), m AS (SELECT s, w, count(*) AS n, any_value(n0) AS n0 FROM b WHERE w >= 3 GROUP BY ALL), q AS (SELECT s, w, bin, count(*) AS k FROM b WHERE w >= 3 GROUP BY ALL),
x AS (SELECT m.s, m.w, m.n, m.n0, greatest(coalesce(a.p, 0), 1e-6) AS p, greatest(coalesce(q.k, 0) / m.n, 1e-6) AS q FROM m CROSS JOIN (SELECT unnest(range(10)) AS bin) g LEFT JOIN a ON a.s = m.s AND a.bin = g.bin LEFT JOIN q ON q.s = m.s AND q.w = m.w AND q.bin = g.bin),
psi AS (SELECT s, w, CASE WHEN any_value(n) >= 30 AND any_value(n0) >= 30 THEN sum((q - p) * ln(q / p)) END AS psi, any_value(n) AS n, any_value(n0) AS n0 FROM x GROUP BY ALL),
pts AS (SELECT DISTINCT s, v FROM l), cmp AS (SELECT m.s, m.w, p.v, (SELECT count(*) FROM l WHERE l.s = m.s AND l.w < 3 AND l.v <= p.v) / m.n0 AS fr, (SELECT count(*) FROM l WHERE l.s = m.s AND l.w = m.w AND l.v <= p.v) / m.n AS fw FROM m JOIN pts p ON p.s = m.s AND m.s <> 'prediction'),
ks AS (SELECT s, w, max(abs(fr - fw)) AS ks FROM cmp GROUP BY ALL), r AS (SELECT w, count(*) AS rows FROM f WHERE w >= 3 GROUP BY 1), mae AS (SELECT w, avg(abs(predicted - actual)) AS mae FROM f WHERE w >= 3 GROUP BY 1),
base AS (SELECT avg(abs(predicted - actual)) AS e0, count(*) AS n0 FROM f WHERE w < 3),
sig AS (SELECT w, CASE s WHEN 'prediction' THEN 'prediction' ELSE 'feature' END AS kind, s AS subject, CASE WHEN psi IS NULL THEN 'insufficient_data' WHEN psi >= CASE s WHEN 'prediction' THEN 0.05 ELSE 0.06 END THEN 'drifted' WHEN psi >= CASE s WHEN 'prediction' THEN 0.025 ELSE 0.03 END THEN 'minor' ELSE 'stable' END AS status,
  psi AS statistic, CASE s WHEN 'prediction' THEN 0.05 ELSE 0.06 END AS threshold, CASE WHEN n >= 30 AND n0 >= 30 THEN ks.ks END AS ks, CASE WHEN s <> 'prediction' THEN coalesce((ks.ks >= 0.1) = (psi >= 0.06), false) END AS ks_agrees, n0 AS reference_rows, n AS recent_rows FROM psi LEFT JOIN ks USING (s, w) WHERE w IN (SELECT w FROM r WHERE rows >= 50)
UNION ALL SELECT w, 'performance', 'mae', CASE WHEN mae / e0 >= 1.02 THEN 'drifted' WHEN mae / e0 >= 1.01 THEN 'minor' ELSE 'stable' END, mae / e0, 1.02, NULL, NULL, n0, rows FROM r JOIN mae USING (w), base WHERE rows >= 50
UNION ALL SELECT w, 'performance', 'window', 'insufficient_data', NULL, NULL, NULL, NULL, n0, rows FROM r, base WHERE rows < 50)"""


def _signals(spark, sf) -> DataFrame:
    rows = forecasts(spark, sf).withColumns({"level": F.col("actual"), "swing": F.col("actual") - F.col("predicted")})
    w = F.floor((C.seconds(F.col("event_time")) - C.seconds(F.lit(_ORIGIN).cast("timestamp"))) / (3 * 86400)).cast("int")
    gates = monitor.Gates(feature_psi=0.06, minor_psi=0.03, prediction_psi=0.05, performance_ratio=1.02)
    return monitor.signals(rows, ["level", "swing"], w < 3, F.when(w >= 3, w), gates)


@query("monitor_signals", f"WITH {_SIGNALS_SQL} SELECT w AS \"window\", kind, subject, status, round(statistic, 6) AS statistic, CAST(threshold AS DOUBLE) AS threshold, round(ks, 6) AS ks, ks_agrees, CAST(reference_rows AS BIGINT) AS reference_rows, CAST(recent_rows AS BIGINT) AS recent_rows FROM sig")
def _monitor_signals(spark, sf):
    """Every feature, the prediction and the error of all three-day windows against the first nine days, in one pass."""
    return _signals(spark, sf).select("window", "kind", "subject", "status", r("statistic", 6).alias("statistic"), "threshold", r("ks", 6).alias("ks"), "ks_agrees", "reference_rows", "recent_rows")


@query("monitor_evaluations", f"""WITH {_SIGNALS_SQL} SELECT w AS "window", array_to_string(list_sort(list_distinct(list(kind) FILTER (status = 'drifted'))), ',') AS kinds, count(*) AS signals, round(max(statistic / threshold) FILTER (status = 'drifted'), 5) AS magnitude FROM sig GROUP BY w HAVING count(*) FILTER (status = 'drifted') > 0""")
def _monitor_evaluations(spark, sf):
    """Evaluations that fired, with the kinds that drifted and the strongest signal."""
    at = F.timestamp_seconds(F.col("window").cast("long"))  # the window's number stands for its instant
    e = monitoring.fired(_signals(spark, sf).withColumns({"stream": F.lit("champion"), "detected_at": at})).filter("is_drift")
    return e.select(F.unix_seconds("detected_at").cast("int").alias("window"), F.array_join("kinds", ",").alias("kinds"), "signals", r("magnitude", 5).alias("magnitude"))


@query("calibrated_gates", f"""WITH {FORECAST_SQL}, f AS (SELECT *, CAST(floor((epoch(event_time) - epoch(TIMESTAMP '{_ORIGIN}')) / 259200) AS INTEGER) AS w FROM fc WHERE predicted IS NOT NULL),
e AS (SELECT quantile_cont(predicted, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges, count(*) AS n0 FROM f WHERE w < 6), c AS (SELECT w, len(list_filter(edges, lambda x: x <= predicted)) AS bin FROM f, e WHERE w < 6), a AS (SELECT bin, count(*) / (SELECT n0 FROM e) AS p FROM c GROUP BY 1),
m AS (SELECT w, count(*) AS n, avg(abs(predicted - actual)) AS mae FROM f WHERE w < 6 GROUP BY 1), q AS (SELECT w, bin, count(*) AS k FROM c GROUP BY ALL),
x AS (SELECT m.w, greatest(coalesce(a.p, 0), 1e-6) AS p, greatest(coalesce(q.k, 0) / m.n, 1e-6) AS q FROM m CROSS JOIN (SELECT unnest(range(10)) AS bin) g LEFT JOIN a USING (bin) LEFT JOIN q ON q.w = m.w AND q.bin = g.bin),
s AS (SELECT w, sum((q - p) * ln(q / p)) AS psi FROM x GROUP BY w), j AS (SELECT s.w, psi, mae / (SELECT avg(abs(predicted - actual)) FROM f WHERE w < 6) AS ratio FROM s JOIN m USING (w) WHERE n >= 50)
SELECT count(*) AS windows, round((SELECT avg(abs(predicted - actual)) FROM f WHERE w < 6), 6) AS reference_error, CASE WHEN count(*) >= 4 THEN round(avg(psi) + 3 * stddev_samp(psi), 6) END AS prediction_psi, CASE WHEN count(*) >= 4 THEN round(greatest(1.0, avg(ratio) + 3 * stddev_samp(ratio)), 6) END AS performance_ratio FROM j""")
def _gates(spark, sf):
    fc = forecasts(spark, sf).filter("predicted is not null")
    w = F.floor((C.seconds(F.col("event_time")) - C.seconds(F.lit(_ORIGIN).cast("timestamp"))) / (3 * 86400)).cast("int")
    rows = fc.withColumn("w", w).filter("w < 6")
    mae = rows.groupBy("w").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    g = monitoring.calibrated_gates(statistics.psi_windows(rows, rows, "predicted", "w").join(mae, "w"))
    return g.select("windows", *[r(c, 6).alias(c) for c in ("reference_error", "prediction_psi", "performance_ratio")])


_FOLD_SQL = f"""WITH RECURSIVE {_DRIFT_SQL}, o AS (SELECT row_number() OVER (ORDER BY w) AS k, epoch(TIMESTAMP '{_ORIGIN}') + (w + 1) * 259200 AS s, kinds, coalesce(magnitude, 0) AS magnitude FROM ev),
fold(k, onset, seen, raised, last, s, magnitude) AS (SELECT 0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL SELECT o.k, CASE WHEN len(kinds) = 0 THEN NULL ELSE coalesce(onset, o.s) END, CASE WHEN len(kinds) = 0 THEN NULL ELSE o.s END, len(kinds) > 0 AND (onset IS NULL OR last IS NULL OR o.s - last >= 518400),
    CASE WHEN len(kinds) > 0 AND (onset IS NULL OR last IS NULL OR o.s - last >= 518400) THEN o.s ELSE last END, o.s, o.magnitude FROM fold JOIN o ON o.k = fold.k + 1)"""


@query("drift_episodes_replay", f"{_FOLD_SQL} SELECT CAST(onset AS BIGINT) AS onset_s, CAST(max(s) AS BIGINT) AS last_s, count(*) AS events, round(max(magnitude), 4) AS peak, count(*) FILTER (raised) AS candidates FROM fold WHERE onset IS NOT NULL GROUP BY onset")
def _replay_episodes(spark, sf):
    e = monitoring.episodes(evaluations(spark, sf), required=(), cooldown_days=6)
    return e.select(micros("onset").alias("onset_s"), micros("last_seen").alias("last_s"), "events", r("peak", 4).alias("peak"), "candidates")


@query("drift_candidates", f"{_FOLD_SQL} SELECT 'CAND-' || strftime(make_timestamp(CAST(s AS BIGINT) * 1000000), '%Y%m%dT%H%M%S') AS candidate_id, 'EP-' || strftime(make_timestamp(CAST(onset AS BIGINT) * 1000000), '%Y%m%dT%H%M%S') AS episode_id, round(magnitude, 4) AS magnitude, 'open' AS status FROM fold WHERE raised")
def _candidates(spark, sf):
    c = monitoring.candidates(monitoring.raised(evaluations(spark, sf), required=(), cooldown_days=6), "static")
    return c.select("candidate_id", "episode_id", r("magnitude", 4).alias("magnitude"), "status")


@query("drift_credibility", f"WITH {_DRIFT_SQL}, o AS (SELECT epoch(TIMESTAMP '{_ORIGIN}') + (w + 1) * 259200 AS s, len(kinds) > 0 AS fired, list_contains(kinds, 'prediction') AS required FROM ev), pt AS (SELECT epoch(TIMESTAMP '2024-01-19 00:00:00') AS p) SELECT count(*) FILTER (fired AND s < p) AS false_alarms, count(*) FILTER (required AND s < p) AS required_alarms, (min(s) FILTER (fired AND s >= p) - any_value(p)) / 3600 AS delay_hours FROM o, pt")
def _credibility(spark, sf):
    e, point = evaluations(spark, sf), "2024-01-19 00:00:00"
    loud = monitoring.false_alarms(e, point).join(monitoring.false_alarms(e, point, ("prediction",)).withColumnRenamed("false_alarms", "required_alarms"), "stream")
    return loud.join(monitoring.detection_delay(e, point), "stream").select("false_alarms", "required_alarms", "delay_hours")


# decisions and replays

_TABLE_SQL = f"{HOURLY_SQL}, tb AS (SELECT location_id, event_time AS target_time, event_time - INTERVAL 1 HOUR AS sample_time, value AS target FROM hourly WHERE value IS NOT NULL)"


def _table(spark, sf) -> DataFrame:
    h = hourly(spark, sf).filter("value is not null")
    return h.select("location_id", F.col("event_time").alias("target_time"), (F.col("event_time") - features.hours(1)).alias("sample_time"), F.col("value").alias("target"))


@query("decision_windows", f"""WITH {_TABLE_SQL}, d AS (SELECT TIMESTAMP '2024-01-15 00:00:00' AS d)
SELECT 'expanding' AS "window", count(*) AS rows, CAST(epoch(min(sample_time)) AS BIGINT) AS first_s, CAST(epoch(max(target_time)) AS BIGINT) AS last_s FROM tb, d WHERE sample_time < d AND target_time < d UNION ALL
SELECT 'last_7_days', count(*), CAST(epoch(min(sample_time)) AS BIGINT), CAST(epoch(max(target_time)) AS BIGINT) FROM tb, d WHERE target_time < d AND sample_time >= d - INTERVAL 7 DAY UNION ALL
SELECT 'evaluation', count(*), CAST(epoch(min(sample_time)) AS BIGINT), CAST(epoch(max(target_time)) AS BIGINT) FROM tb, d WHERE sample_time >= d + INTERVAL 24 HOUR AND sample_time < d + INTERVAL 96 HOUR""")
def _decision(spark, sf):
    t, d = _table(spark, sf), "2024-01-15 00:00:00"
    parts = {"expanding": adaptation.training_window(t, d), "last_7_days": adaptation.training_window(t, d, 7), "evaluation": adaptation.evaluation_window(t, d, 24, 72)}
    rows = [p.agg(F.count(F.lit(1)).alias("rows"), F.min(micros("sample_time")).alias("first_s"), F.max(micros("target_time")).alias("last_s")).select(F.lit(n).alias("window"), "rows", "first_s", "last_s") for n, p in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("protected_slices", f"WITH {_TABLE_SQL} SELECT 'ZONE-B' AS slice, count(*) AS rows, round(avg(target), 6) AS mean_target FROM tb WHERE location_id = 'ZONE-B' UNION ALL SELECT 'ZONE-A Fri 18-20', count(*), round(avg(target), 6) FROM tb WHERE location_id = 'ZONE-A' AND isodow(target_time + INTERVAL 330 MINUTE) = 5 AND hour(target_time + INTERVAL 330 MINUTE) IN (18, 19)")
def _protected(spark, sf):
    found, _ = adaptation.parse_slices(["ZONE-B", "ZONE-A Fri 18-20", "all of it"], "target_time", OFFSET)
    t = _table(spark, sf).withColumn("slice", F.explode(F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in found.items()]))))
    return t.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), r(F.avg("target"), 6).alias("mean_target"))


_ARMS_SQL = f"""{_TABLE_SQL}, th AS (SELECT location_id, quantile_cont(value, 0.75) AS threshold FROM hourly GROUP BY 1), wk AS (SELECT unnest([0, 1, 2]) AS k), st AS (SELECT k, TIMESTAMP '2024-01-08 00:00:00' + k * INTERVAL 7 DAY AS t0 FROM wk),
stat AS (SELECT location_id, avg(target) AS predicted FROM tb WHERE target_time < TIMESTAMP '2024-01-08 00:00:00' GROUP BY 1),
sched AS (SELECT st.k, location_id, avg(target) AS predicted FROM tb JOIN st ON k >= 2 AND sample_time < t0 - INTERVAL 7 DAY AND target_time < t0 - INTERVAL 7 DAY GROUP BY ALL UNION ALL SELECT k, location_id, predicted FROM st, stat WHERE k < 2),
arm AS (SELECT 'static' AS arm, k, tb.location_id, target, predicted FROM tb JOIN st ON sample_time >= t0 AND sample_time < t0 + INTERVAL 7 DAY JOIN stat USING (location_id) UNION ALL
  SELECT 'scheduled', st.k, tb.location_id, target, predicted FROM tb JOIN st ON sample_time >= t0 AND sample_time < t0 + INTERVAL 7 DAY JOIN sched ON sched.k = st.k AND sched.location_id = tb.location_id)"""


def _arms(spark, sf) -> DataFrame:
    t = _table(spark, sf)
    champion = adaptation.zone_means(t.filter(F.col("target_time") < adaptation.instant("2024-01-08 00:00:00")))
    scored, _, _ = adaptation.replay(t, datetime(2024, 1, 8), datetime(2024, 1, 22), champion, adaptation.zone_means, 7, scheduled_days=7, least=1)
    return scored.withColumnRenamed("target", "actual")


@query("arm_scores", f"WITH {_ARMS_SQL} SELECT arm, count(*) AS rows, round(avg(abs(predicted - target)), 6) AS mae, round(sqrt(avg(pow(predicted - target, 2))), 6) AS rmse, count(*) FILTER (predicted > threshold AND target > threshold) AS tp, count(*) FILTER (predicted > threshold AND NOT target > threshold) AS fp, round(avg(CAST(target > threshold AS INTEGER)), 6) AS base_rate FROM arm JOIN th USING (location_id) GROUP BY arm")
def _arm_scores(spark, sf):
    """The static and the scheduled arm (the adaptive arm, without drift, equals the static one and is tested apart)."""
    limits = evaluation.thresholds(hourly(spark, sf), 0.75)
    s = adaptation.score_arms(_arms(spark, sf).filter("arm <> 'adaptive'"), limits, sigma=100.0)
    return s.select("arm", "rows", r("mae", 6).alias("mae"), r("rmse", 6).alias("rmse"), "tp", "fp", r("base_rate", 6).alias("base_rate"))


@query("arm_slices", f"""WITH {_ARMS_SQL}, s AS (SELECT arm, location_id AS slice, avg(abs(predicted - target)) AS mae FROM arm GROUP BY ALL)
SELECT slice, round(a.mae, 6) AS base_mae, round(b.mae, 6) AS arm_mae, round((b.mae - a.mae) / a.mae, 6) AS change FROM (SELECT * FROM s WHERE arm = 'static') a FULL JOIN (SELECT * FROM s WHERE arm = 'scheduled') b USING (slice)""")
def _arm_slices(spark, sf):
    s = _arms(spark, sf).groupBy("arm", F.col("location_id").alias("slice")).agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    return adaptation.compare_slices(s, "scheduled").select("slice", r("base_mae", 6).alias("base_mae"), r("arm_mae", 6).alias("arm_mae"), r("change", 6).alias("change"))


@query("arm_regressions", f"""WITH {_ARMS_SQL}, s AS (SELECT arm, location_id AS slice, avg(abs(predicted - target)) AS mae FROM arm GROUP BY ALL) SELECT a.arm, a.slice, round(a.mae, 6) AS mean_mae, round(min(b.mae), 6) AS best_rival FROM s a JOIN s b ON a.slice = b.slice AND a.arm <> b.arm GROUP BY a.arm, a.slice, a.mae HAVING a.mae > min(b.mae)""")
def _regressions(spark, sf):
    s = _arms(spark, sf).filter("arm <> 'adaptive'").groupBy("arm", F.col("location_id").alias("slice")).agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mean_mae"))
    return adaptation.regressions(s).select("arm", "slice", r("mean_mae", 6).alias("mean_mae"), r("best_rival", 6).alias("best_rival"))


@query("arm_summary", f"""WITH {_ARMS_SQL}, s AS (SELECT arm, k AS seed, avg(abs(predicted - target)) AS mae, sqrt(avg(pow(predicted - target, 2))) AS rmse FROM arm GROUP BY ALL), g AS (SELECT arm, avg(mae) AS m, stddev_samp(mae) AS sd, avg(rmse) AS rm, count(*) AS seeds FROM s GROUP BY arm)
SELECT arm, round(m, 6) AS mean_mae, round(sd, 6) AS sd_mae, round(rm, 6) AS mean_rmse, seeds, CAST(row_number() OVER (ORDER BY m, arm) AS INTEGER) AS rank FROM g""")
def _arm_summary(spark, sf):
    e = F.col("predicted") - F.col("actual")
    s = _arms(spark, sf).filter("arm <> 'adaptive'").groupBy("arm", "window").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return adaptation.summarise_arms(s).select("arm", r("mean_mae", 6).alias("mean_mae"), r("sd_mae", 6).alias("sd_mae"), r("mean_rmse", 6).alias("mean_rmse"), "seeds", "rank")


#: The adaptive replay: weekly steps, two training windows, three days of evaluation, any gain and any error ratio of 0.97 or more.
_STEPS, _WINDOWS, _RATIO = ("2024-01-08", "2024-01-15", "2024-01-22"), {"expanding": None, "last_7_days": 7}, 0.97


def _adaptive_sql() -> str:
    """Serving means by step: CTEs sv0, sv1, ... of which each follows from the one before."""
    parts = [f"{_TABLE_SQL}, sv0 AS (SELECT location_id, avg(target) AS p, 'static' AS version FROM tb WHERE sample_time < TIMESTAMP '{_STEPS[0]}' AND target_time < TIMESTAMP '{_STEPS[0]}' GROUP BY 1)", "ref0 AS (SELECT CAST(NULL AS DOUBLE) AS e)"]
    for k, day in enumerate(_STEPS):
        t = f"TIMESTAMP '{day}'"
        parts.append(f"w{k} AS (SELECT {k} AS \"window\", version, location_id, target, p FROM tb JOIN sv{k} USING (location_id) WHERE sample_time >= {t} AND sample_time < {t} + INTERVAL 7 DAY)")
        parts.append(f"r{k} AS (SELECT avg(abs(p - target)) AS e FROM tb JOIN sv{k} USING (location_id) WHERE sample_time >= {t} - INTERVAL 7 DAY AND sample_time < {t})")
        parts.append(f"d{k} AS (SELECT (SELECT e FROM ref{k}) IS NOT NULL AND r{k}.e >= {_RATIO} * (SELECT e FROM ref{k}) AS drifted FROM r{k})")
        tag = day.replace("-", "")
        for name, days in _WINDOWS.items():
            since = "" if days is None else f" AND sample_time >= {t} - INTERVAL {days} DAY"
            parts.append(f"m{k}_{name} AS (SELECT location_id, avg(target) AS p, '{tag}-{name}' AS version FROM tb WHERE sample_time < {t} AND target_time < {t}{since} GROUP BY 1)")
        ahead = f"tb WHERE sample_time >= {t} AND sample_time < {t} + INTERVAL 72 HOUR"
        parts.append(f"c{k} AS (" + " UNION ALL ".join(f"SELECT '{name}' AS \"window\", '{tag}-{name}' AS version, avg(abs(m.p - a.target)) AS mae, avg(abs(s.p - a.target)) AS serving FROM (SELECT * FROM {ahead}) a JOIN m{k}_{name} m USING (location_id) JOIN sv{k} s USING (location_id)" for name in _WINDOWS) + ")")
        parts.append(f"win{k} AS (SELECT arg_min(version, (mae, version)) AS version FROM c{k} WHERE (SELECT drifted FROM d{k}) AND (serving - mae) / serving >= 0.0)")
        every = " UNION ALL ".join(f"SELECT * FROM m{k}_{name}" for name in _WINDOWS)
        parts.append(f"sv{k + 1} AS (SELECT location_id, p, version FROM ({every}) WHERE version = (SELECT version FROM win{k}) UNION ALL SELECT location_id, p, version FROM sv{k} WHERE (SELECT version FROM win{k}) IS NULL)")
        parts.append(f"ref{k + 1} AS (SELECT CASE WHEN (SELECT version FROM win{k}) IS NOT NULL THEN NULL ELSE coalesce((SELECT e FROM ref{k}), (SELECT e FROM r{k})) END AS e)")
    return ",\n".join(parts)


def _adaptive_log(spark, sf) -> adaptive.StepLog:
    """The replay, broken off behind its first step and resumed from its log by a second run."""
    import uuid

    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    t, model = _table(spark, sf), adaptive.ZoneMeans()
    begin, end = datetime.fromisoformat(_STEPS[0]), datetime.fromisoformat(_STEPS[-1])
    champion = model.fit(adaptation.training_window(t, begin))
    policy = adaptive.Policy(windows=tuple(adaptive.TrainingWindow(n, d) for n, d in _WINDOWS.items()), rules=monitoring.PromotionRules(1, 0.0, 1.0, 8), drift_ratio=_RATIO, evaluation_hours=72, least_rows=1)
    log = adaptive.StepLog(spark, f"{root}/replay-{uuid.uuid4().hex}")
    for stop in (0, None):
        adaptive.run(log, t, begin, end, champion, model, policy, stop_after=stop)
    return log


@query("adaptive_arm", f"WITH {_adaptive_sql()}\nSELECT \"window\", version, count(*) AS rows, round(avg(abs(p - target)), 6) AS mae FROM (" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(len(_STEPS))) + ") GROUP BY ALL")
def _adaptive_arm(spark, sf):
    """Error of the adaptive arm in each step, with the version that it served."""
    rows = _adaptive_log(spark, sf).rows().filter("arm = 'adaptive'")
    return rows.groupBy("window", "version").agg(F.count(F.lit(1)).alias("rows"), r(F.avg(F.abs(F.col("predicted") - F.col("target"))), 6).alias("mae"))


@query("best_challengers", f"WITH {_adaptive_sql()},\nall_c AS (" + " UNION ALL ".join(f"SELECT 'CAND-{day.replace('-', '')}T000000' AS candidate_id, * FROM c{k} WHERE (SELECT drifted FROM d{k})" for k, day in enumerate(_STEPS)) + ") SELECT candidate_id, arg_min(version, (mae, version)) AS best, arg_min(version, (mae, version)) FILTER ((serving - mae) / serving >= 0.0) AS winner, count(*) AS challengers, round(min(mae), 6) AS least_mae FROM all_c GROUP BY 1")
def _best(spark, sf):
    """The best challenger of each investigation of the replay, and the best of those that passed every rule."""
    c = _adaptive_log(spark, sf).candidates()
    found = monitoring.best_challengers(c).join(c.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("challengers"), r(F.min("challenger_mae"), 6).alias("least_mae")), "candidate_id")
    return found.select("candidate_id", "best", "winner", "challengers", "least_mae")


_TREE_SQL = f"""{FORECAST_SQL}, x AS (SELECT location_id, CAST(epoch(event_time) AS BIGINT) AS s, predicted AS lag, hour(event_time) AS h, actual FROM fc WHERE predicted IS NOT NULL AND actual IS NOT NULL), md AS (SELECT median(lag) AS cut FROM x),
y AS (SELECT x.*, CAST(lag > cut AS INTEGER) AS l, CAST(h > 11 AS INTEGER) AS k FROM x, md), lk AS (SELECT l, k, count(*) AS n, avg(actual) AS m FROM y GROUP BY ALL), ll AS (SELECT l, sum(n) AS n, sum(n * m) / sum(n) AS m FROM lk GROUP BY 1),
kk AS (SELECT k, sum(ll.n * lk.m) / sum(ll.n) AS m FROM lk JOIN ll USING (l) GROUP BY k), al AS (SELECT avg(actual) AS m FROM y),
f AS (SELECT location_id, s, lk.m AS predicted, ((ll.m - al.m) + (lk.m - kk.m)) / 2 AS lag, ((kk.m - al.m) + (lk.m - ll.m)) / 2 AS hour FROM y JOIN lk USING (l, k) JOIN ll USING (l) JOIN kk USING (k), al),
c AS (SELECT location_id, s, predicted, unnest([{{'f': 'history', 'v': lag}}, {{'f': 'calendar', 'v': hour}}]) AS x FROM f)"""


@query("factor_shares", f"""WITH {_TREE_SQL} SELECT location_id, s AS event_s, x.f AS factor, round(predicted, 6) AS predicted, round(x.v, 6) AS contribution, round(abs(x.v) / sum(abs(x.v)) OVER w, 6) AS share, CAST(row_number() OVER (w ORDER BY abs(x.v) DESC, x.f) AS INTEGER) AS rank FROM c WINDOW w AS (PARTITION BY location_id, s)""")
def _factors(spark, sf):
    """Factors of a tree's forecasts: split by the last value at its median, then by the hour at noon; leaves are means."""
    x = forecasts(spark, sf).filter("predicted is not null and actual is not null").select("location_id", micros("event_time").alias("event_s"), F.col("predicted").alias("lag"), F.hour("event_time").alias("hour"), "actual")
    cut = x.agg(F.median("lag").alias("cut")).first()["cut"]
    found = {(r_["l"], r_["k"]): (r_["m"], r_["n"]) for r_ in x.groupBy((F.col("lag") > cut).alias("l"), (F.col("hour") > 11).alias("k")).agg(F.avg("actual").alias("m"), F.count(F.lit(1)).alias("n")).collect()}  # four leaves
    leaf = lambda l, k: attribution.Node(*map(float, found.get((l, k), (0.0, 0))))  # noqa: E731, E741
    half = lambda l: attribution.Node(0.0, leaf(l, False).cover + leaf(l, True).cover, 1, 11.0, leaf(l, False), leaf(l, True))  # noqa: E731, E741
    tree = attribution.Node(0.0, half(False).cover + half(True).cover, 0, cut, half(False), half(True))
    c = attribution.contributions(x, [(1.0, tree)], ["lag", "hour"], ["location_id", "event_s"])
    shares = forecast.factor_shares(c, spark.createDataFrame([("lag", "history"), ("hour", "calendar")], "feature string, factor string"), ["location_id", "event_s", "predicted"])
    return shares.select("location_id", "event_s", "factor", r("predicted", 6).alias("predicted"), r("contribution", 6).alias("contribution"), r("share", 6).alias("share"), "rank")


@query("gbt_factor_shares")
def _gbt_factors(spark, sf):
    """Mean share of each factor in the forecasts of boosted trees: exact attribution of every row."""
    x = forecasts(spark, sf).filter("actual is not null").select("location_id", micros("event_time").alias("event_s"), F.col("predicted").alias("lag"), F.hour("event_time").alias("hour"), F.dayofweek("event_time").alias("weekday"), F.col("actual").alias("target"))
    model = forecast.GradientForecaster(["lag", "hour", "weekday"], rounds=8, depth=3).fit(x)
    c = model.attribution(x, ["location_id", "event_s"])
    shares = forecast.factor_shares(c, spark.createDataFrame([("lag", "history"), ("hour", "calendar"), ("weekday", "calendar")], "feature string, factor string"), ["location_id", "event_s", "predicted", "base_value"])
    whole = shares.groupBy("location_id", "event_s", "predicted", "base_value").agg(F.sum("contribution").alias("_c"))
    off = whole.agg(F.max(F.abs(F.col("predicted") - F.col("base_value") - F.col("_c"))).alias("largest_gap"))  # one row
    return shares.groupBy("factor").agg(F.avg("share").alias("share"), F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(off))


# patterns

_MONTH_SQL = f"{LOCAL_SQL}, m AS (SELECT *, strftime(event_time + INTERVAL 330 MINUTE, '%Y-%m-%d') AS month FROM loc WHERE value IS NOT NULL)"


def _months(spark, sf) -> DataFrame:
    """Days stand for months: the events are of one month."""
    return local_obs(spark, sf).withColumn("month", F.date_format(C.local_time(F.col("event_time"), OFFSET), "yyyy-MM-dd"))


@query("pattern_strengths", f"""WITH {_MONTH_SQL}, p(pattern_id, zone) AS (VALUES ('LVL-ZONE-A', 'ZONE-A'), ('LVL-ZONE-C', 'ZONE-C')),
g AS (SELECT pattern_id, month, median(value) FILTER (location_id = zone) AS a, median(value) FILTER (location_id <> zone) AS b, count(*) FILTER (location_id = zone) AS n1, count(*) FILTER (location_id <> zone) AS n2 FROM m, p GROUP BY ALL)
SELECT pattern_id, month AS "window", n1 AS n_pattern, n2 AS n_rest, CASE WHEN n1 >= 8 AND n2 >= 8 THEN round(a / b, 6) END AS strength FROM g""")
def _strengths(spark, sf):
    found = spark.createDataFrame([("LVL-ZONE-A", "ZONE-A"), ("LVL-ZONE-C", "ZONE-C")], "pattern_id string, location_id string")
    return patterns.zone_strengths(_months(spark, sf), found).select("pattern_id", "window", "n_pattern", "n_rest", r("strength", 6).alias("strength"))


@query("cell_pattern_strengths", f"""WITH {_MONTH_SQL}, w AS (SELECT *, 'W' || CAST(isodow(event_time) % 2 AS VARCHAR) AS half FROM m),
g AS (SELECT half AS "window", median(value) FILTER (weekday = 4) AS a, median(value) FILTER (weekday <> 4) AS b, count(*) FILTER (weekday = 4) AS n1, count(*) FILTER (weekday <> 4) AS n2 FROM w WHERE location_id = 'ZONE-B' AND hour IN (18, 19) GROUP BY 1)
SELECT 'ST-ZONE-B-4-1820' AS pattern_id, "window", n1 AS n_pattern, n2 AS n_rest, CASE WHEN n1 >= 8 AND n2 >= 8 THEN round(a / b, 6) END AS strength FROM g""")
def _cell_strengths(spark, sf):
    rows = _months(spark, sf).withColumn("month", F.concat(F.lit("W"), ((F.weekday("event_time") + 1) % 2).cast("string")))
    found = spark.createDataFrame([("ST-ZONE-B-4-1820", "ZONE-B", 4, [18, 19])], "pattern_id string, location_id string, weekday int, hours array<int>")
    return patterns.cell_strengths(rows, found).select("pattern_id", "window", "n_pattern", "n_rest", r("strength", 6).alias("strength"))


@query("wet_pattern_strengths", f"""WITH {_MONTH_SQL}, d AS (SELECT month, location_id, weekday, hour, value, CASE WHEN CAST(substr(observation_id, 5) AS BIGINT) % 3 = 0 THEN 2.0 ELSE 0.0 END AS wet FROM m),
b AS (SELECT month, location_id, weekday, hour, median(value) AS base FROM d WHERE wet = 0 GROUP BY ALL HAVING count(*) >= 2 AND median(value) <> 0), q AS (SELECT month, median(value / base) AS s, count(*) AS n1 FROM d JOIN b USING (month, location_id, weekday, hour) WHERE wet > 0 GROUP BY 1), n AS (SELECT month, count(*) AS n2 FROM d WHERE wet = 0 GROUP BY 1)
SELECT month AS "window", coalesce(n1, 0) AS n_pattern, coalesce(n2, 0) AS n_rest, CASE WHEN n1 >= 8 AND n2 >= 8 THEN round(s, 6) END AS strength FROM n FULL JOIN q USING (month)""")
def _wet_strengths(spark, sf):
    rows = _months(spark, sf).withColumn("wet", F.when(F.expr("cast(substr(observation_id, 5) as bigint)") % 3 == 0, 2.0).otherwise(0.0))
    return patterns.wet_strengths(rows, "wet", "CND-rain").select("window", "n_pattern", "n_rest", r("strength", 6).alias("strength"))


@query("profile_patterns", f"""WITH {LOCAL_SQL}, x AS (SELECT location_id, weekday, value * (CASE WHEN weekday = 4 THEN 2.0 ELSE 1.0 END) AS value FROM loc), m AS (SELECT location_id, weekday, median(value) AS m FROM x GROUP BY ALL HAVING count(*) >= 12)
SELECT location_id, arg_max(weekday, (m, weekday)) AS peak, arg_min(weekday, (m, weekday)) AS trough, round(max(m) / min(m), 6) AS ratio, count(*) - 1 AS degrees FROM m GROUP BY 1 HAVING count(*) >= 2 AND min(m) > 0 AND max(m) / min(m) >= 1.5""")
def _profile_patterns(spark, sf):
    rows = local_obs(spark, sf).withColumn("value", F.col("value") * F.when(F.col("weekday") == 4, 2.0).otherwise(1.0))
    return patterns.profile_patterns(rows, "weekday").select("location_id", "peak", "trough", r("ratio", 6).alias("ratio"), "degrees")


@query("discovered_patterns")
def _discovered(spark, sf):
    rows = local_obs(spark, sf).withColumns({"value": F.col("value") * F.when((F.col("weekday") == 4) & (F.col("location_id") == "ZONE-B") & F.col("hour").isin(18, 19), 6.0).otherwise(1.0), "wet": F.when(F.col("weekday") == 2, F.col("hour") / 4.0).otherwise(0.0)})
    months = rows.select("location_id", F.date_format(C.local_time(F.col("event_time"), OFFSET), "yyyy-MM-dd").alias("month"), "value")
    found = patterns.discover(rows, months)
    return found.select("pattern_id", "kind", "location_id", "weekday", F.array_join(F.transform("hours", lambda h: h.cast("string")), ",").alias("hours"), r("effect", 5).alias("effect"), "descriptive")


@query("anomaly_summary", f"SELECT leading_kind AS \"leading\", count(*) AS anomalies, round(count(*) / (SELECT count(*) FROM events), 6) AS rate FROM ({ORACLES['anomaly_explanations_joined']}) GROUP BY 1")
def _anomaly_summary(spark, sf):
    """Anomalies by the explanation that their evidence supports best, as a share of all readings."""
    a = QUERIES["anomaly_explanations_joined"](spark, sf).withColumnRenamed("leading_kind", "leading")
    return output.anomaly_views(a, observations(spark, sf).count()).select("leading", "anomalies", r("rate", 6).alias("rate"))


@query("rain_effects", f"""WITH {LOCAL_SQL}, d AS (SELECT location_id, weekday, hour, value, CASE WHEN CAST(substr(observation_id, 5) AS BIGINT) % 3 = 0 THEN 1.0 + CAST(substr(observation_id, 5) AS BIGINT) % 14 ELSE 0.0 END AS wet FROM loc WHERE value IS NOT NULL),
b AS (SELECT location_id, weekday, hour, median(value) AS base FROM d WHERE wet <= 0 GROUP BY ALL HAVING count(*) >= 4 AND median(value) <> 0), x AS (SELECT d.location_id, wet, value / base - 1 AS y FROM d JOIN b USING (location_id, weekday, hour) WHERE wet > 0),
u AS (SELECT 'all' AS range, * FROM x UNION ALL SELECT 'light', * FROM x WHERE wet <= 10)
SELECT location_id, range, count(*) AS n, round(regr_slope(y, wet), 6) AS slope, round(regr_intercept(y, wet), 6) AS intercept, round(regr_r2(y, wet), 6) AS r2, round(sqrt(greatest(0, regr_syy(y, wet) - regr_slope(y, wet) * regr_slope(y, wet) * regr_sxx(y, wet)) / (count(*) - 2) / regr_sxx(y, wet)), 6) AS stderr FROM u GROUP BY location_id, range HAVING count(*) >= 30""")
def _rain_effects(spark, sf):
    n = F.expr("cast(substr(observation_id, 5) as bigint)")
    rows = local_obs(spark, sf).filter("value is not null").withColumn("wet", F.when(n % 3 == 0, 1.0 + n % 14).otherwise(0.0))
    return patterns.rain_effects(rows, "wet").select("location_id", "range", "n", *[r(c, 6).alias(c) for c in ("slope", "intercept", "r2", "stderr")])


# read queries

#: Two-sided 5 % points of Student's t for 1, 2, ... degrees of freedom (fixed values).
_T95 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905,
    2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272, 2.039513, 2.036933,
)


def evolution_sql(recent: int) -> str:
    """CTEs from st (pattern_id, "window", strength) to ev (pattern_id, windows, h, r, status)."""
    return f"""ev_w AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY "window" DESC) AS k FROM st),
ev_m AS (SELECT pattern_id, rank() OVER (PARTITION BY pattern_id ORDER BY "window") AS x, rank() OVER (PARTITION BY pattern_id ORDER BY strength) + (count(*) OVER (PARTITION BY pattern_id, strength) - 1) / 2.0 AS y FROM st WHERE strength IS NOT NULL),
ev_t AS (SELECT pattern_id, count(*) AS n, CASE WHEN count(DISTINCT y) > 1 THEN corr(x, y) ELSE 0 END AS rho FROM ev_m GROUP BY 1),
ev_p AS (SELECT pattern_id, rho, n >= 4 AND (abs(rho) >= 1 - 1e-12 OR abs(rho) * sqrt((n - 2) / (1 - rho * rho)) >= CAST({list(_T95)} AS DOUBLE[])[CAST(n - 2 AS INTEGER)]) AS sure FROM ev_t),
ev_g AS (SELECT pattern_id, count(strength) AS windows, median(strength) FILTER (k > {recent}) AS h, median(strength) FILTER (k <= {recent}) AS r, count(*) FILTER (strength > 1) AS above, count(*) FILTER (strength < 1) AS below FROM ev_w GROUP BY 1),
ev AS (SELECT pattern_id, windows, h, r, CASE WHEN windows < 3 THEN 'insufficient_history' WHEN r IS NULL THEN 'disappeared' WHEN h IS NULL THEN 'new' WHEN least(above, below) >= 2 THEN 'conflicting'
  WHEN sure AND rho > 0 AND r > h THEN 'strengthening' WHEN sure AND rho < 0 AND r < h THEN 'weakening' ELSE 'stable' END AS status FROM ev_g LEFT JOIN ev_p USING (pattern_id))"""


@query("patterns_by_status", f"""WITH {_MONTH_SQL}, p(pattern_id, zone) AS (VALUES ('LVL-ZONE-A', 'ZONE-A'), ('LVL-ZONE-B', 'ZONE-B'), ('LVL-ZONE-C', 'ZONE-C'), ('LVL-ZONE-D', 'ZONE-D')),
g AS (SELECT pattern_id, month, median(value) FILTER (location_id = zone) / median(value) FILTER (location_id <> zone) AS s, count(*) FILTER (location_id = zone) AS n1, count(*) FILTER (location_id <> zone) AS n2 FROM m, p GROUP BY ALL),
st AS (SELECT pattern_id, month AS "window", CASE WHEN n1 >= 8 AND n2 >= 8 THEN s END AS strength FROM g), {evolution_sql(2)}
SELECT pattern_id, windows, round(h, 6) AS historical, round(r, 6) AS recent, status FROM ev""")
def _by_status(spark, sf):
    zones = spark.createDataFrame([(f"LVL-ZONE-{z}", f"ZONE-{z}") for z in "ABCD"], "pattern_id string, location_id string")
    e = patterns.evolution(patterns.zone_strengths(_months(spark, sf), zones))
    return output.selected(e, status=None).select("pattern_id", "windows", r("historical", 6).alias("historical"), r("recent", 6).alias("recent"), "status")


_SERIES_SQL = """y AS (SELECT l_suppkey % 4 AS zone, CAST(strftime(l_shipdate, '%Y') AS INTEGER) AS y, median(CAST(l_extendedprice AS DOUBLE)) / 30000 AS m FROM lineitem GROUP BY ALL),
q AS (SELECT *, dense_rank() OVER (ORDER BY y) AS i, y - min(y) OVER () AS d, max(y) OVER () - y AS back FROM y),
st AS (SELECT kind || '-Z' || zone AS pattern_id, y AS "window", CASE kind WHEN 'grows' THEN 1.1 + m / 100 + d * 0.3 WHEN 'shrinks' THEN 4.0 + m / 100 - d * 0.3 WHEN 'level' THEN 2.0 + m / 100 WHEN 'swings' THEN CASE WHEN d % 2 = 0 THEN 1.5 ELSE 0.6 END + m / 100
  WHEN 'gone' THEN CASE WHEN back >= 3 THEN 1.5 + m END WHEN 'fresh' THEN CASE WHEN back < 3 THEN 1.5 + m END WHEN 'short' THEN CASE WHEN back % 4 = 0 AND back < 8 THEN m END END AS strength
  FROM q, (SELECT unnest(['grows', 'shrinks', 'level', 'swings', 'gone', 'fresh', 'short']) AS kind))"""


@query("pattern_evolution", f"WITH {_SERIES_SQL}, {evolution_sql(3)} SELECT pattern_id, windows, round(h, 6) AS historical, round(r, 6) AS recent, status FROM ev")
def _pattern_evolution(spark, sf):
    """Yearly strengths of each zone under seven courses, one for each status; the last three years are the recent ones."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    y = li.groupBy((F.col("l_suppkey") % 4).alias("zone"), F.year("l_shipdate").alias("y")).agg((F.median(F.col("l_extendedprice").cast("double")) / 30000).alias("m"))
    ends = y.agg(F.min("y").alias("first"), F.max("y").alias("last"))  # one row
    q = y.crossJoin(F.broadcast(ends)).withColumns({"d": F.col("y") - F.col("first"), "back": F.col("last") - F.col("y")})
    m, d, back = F.col("m"), F.col("d"), F.col("back")
    courses = {
        "grows": 1.1 + m / 100 + d * 0.3, "shrinks": 4.0 + m / 100 - d * 0.3, "level": 2.0 + m / 100, "swings": F.when(d % 2 == 0, 1.5).otherwise(0.6) + m / 100,
        "gone": F.when(back >= 3, 1.5 + m), "fresh": F.when(back < 3, 1.5 + m), "short": F.when((back % 4 == 0) & (back < 8), m),
    }
    rows = q.select("zone", F.col("y").alias("window"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("strength")) for k, v in courses.items()])).alias("x"))
    rows = rows.select(F.concat("x.kind", F.lit("-Z"), F.col("zone").cast("string")).alias("pattern_id"), "window", "x.strength")
    return patterns.evolution(rows, recent=3).select("pattern_id", "windows", r("historical", 6).alias("historical"), r("recent", 6).alias("recent"), "status")


@query("anomalies_of_zone", f"WITH {ANOMALY_SQL} SELECT observation_id, metric, round(value, 6) AS value, round(m.med, 6) AS expected FROM a JOIN m USING (location_id, metric, hour) WHERE location_id = 'ZONE-B'")
def _zone_anomalies(spark, sf):
    a = output.selected(integrity.mad_outliers(local_obs(spark, sf), ("location_id", "metric", "hour")), location_id="ZONE-B")
    return a.select("observation_id", "metric", r("value", 6).alias("value"), r("group_median", 6).alias("expected"))


@query("drift_firing", f"WITH {_DRIFT_SQL} SELECT CAST(epoch(TIMESTAMP '{_ORIGIN}') + (w + 1) * 259200 AS BIGINT) AS detected_s, array_to_string(kinds, ',') AS kinds FROM ev WHERE len(kinds) > 0")
def _firing(spark, sf):
    return output.selected(evaluations(spark, sf), is_drift=True).select(micros("detected_at").alias("detected_s"), F.array_join("kinds", ",").alias("kinds"))


@query("experiment_page", f"WITH {_ARMS_SQL}, s AS (SELECT arm, k AS week, round(avg(abs(predicted - target)), 6) AS mae FROM arm GROUP BY ALL) SELECT arm, CAST(week AS INTEGER) AS week, mae, (SELECT count(*) FROM s) AS total FROM s ORDER BY arm DESC, week LIMIT 4 OFFSET 1")
def _experiments(spark, sf):
    s = _arms(spark, sf).filter("arm <> 'adaptive'").groupBy("arm", F.col("window").alias("week")).agg(r(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 6).alias("mae"))
    rows, total = feeds.page(s.withColumn("_k", F.when(F.col("arm") == "static", 0).otherwise(1)), ["_k", "week"], 1, 4)
    return rows.drop("_k").withColumn("total", F.lit(total))


def _exported(spark, sf) -> artifacts.ArtifactReader:
    """An export of all observations, with those above 480 held back; read back."""
    import uuid

    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/artifacts-{uuid.uuid4().hex}"
    obs = observations(spark, sf)
    rejected = obs.filter("value > 480").withColumn("quarantine_reason", F.when(F.col("value") > 489, "above_maximum").otherwise("suspicious"))
    kept = obs.filter("value is null or value <= 480")
    artifacts.export(kept, rejected, integrity.source_health(kept, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")), root, "2024-01-31")
    return artifacts.ArtifactReader(spark, root)


_EXPORT_SQL = f"""{OBS_SQL}, kept AS (SELECT * FROM obs WHERE value IS NULL OR value <= 480), g AS (SELECT location_id, metric, event_time, count(*) AS n, max(value) - min(value) AS spread, count(*) >= 2 AND max(value) - min(value) > greatest(0.5, 0.05 * max(abs(value))) AS dissent FROM kept GROUP BY ALL)"""


@query("artifact_health", f"""WITH {_EXPORT_SQL}, t(artifact, rows) AS (SELECT 'unified', count(*) FILTER (NOT coalesce(dissent, false)) FROM g UNION ALL SELECT 'conflicts', count(*) FILTER (dissent) FROM g UNION ALL SELECT 'quality', 1 UNION ALL SELECT 'quarantine', (SELECT count(*) FROM obs WHERE value > 480)
  UNION ALL SELECT unnest(['patterns', 'anomalies', 'predictions', 'models', 'experiments']), 0) SELECT artifact, rows > 0 AS available, CAST(rows AS BIGINT) AS rows FROM t""")
def _health(spark, sf):
    return _exported(spark, sf).availability().select("artifact", "available", "rows")


@query("exported_conflicts", f"WITH {_EXPORT_SQL} SELECT location_id, metric, strftime(event_time, '%Y-%m-%dT%H:%M:%S.000') AS event_time, n AS observations, round(spread, 6) AS spread FROM g WHERE dissent")
def _exported_conflicts(spark, sf):
    return _exported(spark, sf).read("conflicts").select("location_id", "metric", "event_time", F.size("observations").cast("long").alias("observations"), r("spread", 6).alias("spread"))


@query("exported_quality", f"""WITH {_EXPORT_SQL} SELECT (SELECT count(*) FROM obs) AS rows_in, (SELECT count(*) FROM kept) AS valid, (SELECT count(*) FROM obs WHERE value > 480) AS quarantined, (SELECT count(*) FROM kept WHERE value IS NULL) AS missing_values, true AS accounts_for_every_row""")
def _exported_quality(spark, sf):
    q = _exported(spark, sf).read("quality")
    return q.select("rows_in", "valid", "quarantined", "missing_values", "accounts_for_every_row")


# replay

@query("replayed_feed", """WITH n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row, value > 20 AS accepted FROM events), k AS (SELECT *, CAST(count(*) FILTER (accepted) OVER (ORDER BY row) AS BIGINT) AS upto FROM n),
e AS (SELECT * FROM k WHERE row <= (SELECT max(row) FROM k WHERE accepted AND upto <= 2000) OR (SELECT max(upto) FROM k) < 2000)
SELECT event_type, accepted, count(*) AS rows, min(row) AS first_row, max(row) AS last_row, round(sum(value), 4) AS total, 1704067200 + max(upto) // 2 AS last_s FROM e GROUP BY ALL""")
def _replayed(spark, sf):
    """The first 2,000 accepted events of a replay at two a second, by a stream that is stopped and started again on its way."""
    import tempfile
    import uuid

    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/replay-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf}/events.parquet")
    replay.number_feed(events, f"{root}/feed", F.col("value") > 20, block=20_000)
    with tempfile.NamedTemporaryFile("w+") as clock:  # the driver's own: readers of the clock are on the driver
        for now in (300, 100_000):
            clock.seek(0)
            clock.write(f"{1704067200 + now:010d}")
            clock.flush()
            rows = replay.replay(spark, f"{root}/feed", interval=1.0, speed=2.0, limit=2000, clock=clock.name, start=1704067200.0)
            streams.run_available(rows, f"{root}/out", f"{root}/checkpoint")
    found = spark.read.schema(rows.schema).parquet(f"{root}/out")
    return found.groupBy("event_type", "accepted").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), r(F.sum("value"), 4).alias("total"), F.floor(F.max(F.unix_seconds("received_time"))).alias("last_s"))


@query("arm_slice_summary", f"""WITH {_ARMS_SQL}, s AS (SELECT arm, location_id AS slice, k AS seed, avg(abs(predicted - target)) AS mae, sqrt(avg(pow(predicted - target, 2))) AS rmse FROM arm GROUP BY ALL), g AS (SELECT arm, slice, avg(mae) AS m, stddev_samp(mae) AS sd, avg(rmse) AS rm, count(*) AS seeds FROM s GROUP BY ALL)
SELECT arm, slice, round(m, 6) AS mean_mae, round(sd, 6) AS sd_mae, round(rm, 6) AS mean_rmse, seeds, CAST(row_number() OVER (PARTITION BY slice ORDER BY m, arm) AS INTEGER) AS rank FROM g""")
def _arm_slice_summary(spark, sf):
    e = F.col("predicted") - F.col("actual")
    s = _arms(spark, sf).filter("arm <> 'adaptive'").groupBy("arm", F.col("location_id").alias("slice"), "window").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return adaptation.summarise_arms(s, ("arm", "slice")).select("arm", "slice", r("mean_mae", 6).alias("mean_mae"), r("sd_mae", 6).alias("sd_mae"), r("mean_rmse", 6).alias("mean_rmse"), "seeds", "rank")
