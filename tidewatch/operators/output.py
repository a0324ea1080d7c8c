"""What is published: predictions with probability and interval, outcomes, panels and the read queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import evaluation


def predictions(scored: DataFrame, limits: DataFrame, intervals: DataFrame, sigma: float | Column, version: str, offset_hours: float = 0.0, calibrate=None) -> DataFrame:
    """Full prediction records of rows (location_id, target_time, predicted).

    limits: (location_id, threshold); intervals: ``evaluation.residual_intervals``; a row for each zone, both.  A
    zone without threshold has no probability and low severity; the lower bound is never below 0.  calibrate:
    Column -> Column from raw to calibrated probability; without it records say that they are not calibrated.
    """
    rows = scored.join(F.broadcast(limits), "location_id", "left").join(F.broadcast(intervals.select("location_id", "lower_offset", "upper_offset")), "location_id", "left")
    lower, upper = F.greatest(F.lit(0.0), F.col("predicted") + F.col("lower_offset")), F.col("predicted") + F.col("upper_offset")
    raw = evaluation.tail_probability(F.col("predicted"), F.col("threshold"), sigma)
    return rows.select(
        F.concat_ws(":", F.lit(version), "location_id", F.date_format("target_time", "yyyy-MM-dd'T'HH:mm:ss")).alias("prediction_id"),
        "location_id",
        "target_time",
        C.local_time(F.col("target_time"), offset_hours).alias("local_time"),
        "predicted",
        "threshold",
        (raw if calibrate is None else calibrate(raw)).alias("probability"),
        F.lit(calibrate is not None).alias("calibrated"),
        C.severity(C.ratio(F.col("predicted"), F.col("threshold"))).alias("severity"),
        F.when(F.col("predicted").isNotNull(), lower).alias("interval_lower"),
        upper.alias("interval_upper"),
        C.interval_confidence(F.col("predicted"), lower, upper).alias("confidence"),
        F.lit(version).alias("model_version"),
    )


def outcomes(predicted: DataFrame, actuals: DataFrame, rain: DataFrame | None = None) -> DataFrame:
    """Predictions that came true: joined to (location_id, target_time, actual), and to rain (event_time, mm) of the target hour."""
    rows = predicted.join(actuals.select("location_id", "target_time", "actual"), ["location_id", "target_time"])
    if rain is None:
        rows = rows.withColumn("rainfall_mm", F.lit(None).cast("double"))
    else:
        at = rain.select(F.col("event_time").alias("target_time"), F.col("mm").alias("rainfall_mm"))
        rows = rows.join(at, "target_time", "left")
    over = lambda c: F.when(F.col("threshold").isNotNull(), F.coalesce(F.col(c) > F.col("threshold"), F.lit(False)))
    return rows.withColumns({"local_hour": F.hour("local_time"), "weekday": F.weekday("local_time"), "congested_predicted": over("predicted"), "congested_actual": over("actual"), "error": F.coalesce(F.abs(F.col("predicted") - F.col("actual")), F.abs("actual"))})


def zone_risk(outcome: DataFrame, zones: DataFrame) -> DataFrame:
    """Mean probability, error and counts by zone beside its geometry; zones that only one side knows keep their row."""
    g = outcome.groupBy("location_id").agg(F.avg("probability").alias("risk"), F.avg("error").alias("mae"), F.count(F.lit(1)).alias("predictions"), F.count_if("congested_actual").alias("congested_hours"))
    joined = g.join(zones, "location_id", "full")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("predictions", "congested_hours")})


def _reads(observations: DataFrame, samples: DataFrame, reach: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(what is asked for, what is found): (location_id, sample_time, feature), and the observations that each of them may read.

    A feature asks for its metric at its own location, or at the sample's; requests and observations meet on the place
    that is read, the metric and the day, each request under the days that its own window touches.
    """
    day = lambda c: F.floor(c / 86400)
    specs = F.array(*[F.struct(F.lit(r[0]).alias("feature"), F.lit(r[1]).alias("metric"), F.lit(3600 * r[2]).alias("first"), F.lit(3600 * r[3]).alias("last"), F.lit(r[4] if len(r) > 4 else None).cast("string").alias("place")) for r in reach])
    asked = samples.select("location_id", "sample_time").distinct().withColumn("x", F.explode(specs)).select("location_id", "sample_time", C.seconds(F.col("sample_time")).alias("_at"), "x.feature", "x.metric", "x.first", "x.last", F.coalesce("x.place", "location_id").alias("place"))
    wanted = asked.withColumn("_day", F.explode(F.sequence(day(F.col("_at") - F.col("first")), day(F.col("_at") - F.col("last")))))
    known = observations.filter(F.col("value").isNotNull()).select("observation_id", "source_id", F.col("location_id").alias("place"), "metric", "event_time", C.seconds(F.col("event_time")).alias("_s")).withColumn("_day", day(F.col("_s")))
    found = wanted.join(known, ["place", "metric", "_day"]).filter((F.col("_at") - F.col("_s")).between(F.col("last"), F.col("first")))
    return asked.select("location_id", "sample_time", "feature"), found


def attributed(observations: DataFrame, samples: DataFrame, reach: list[tuple]) -> DataFrame:
    """Shares of each source in what a prediction may read: (location_id, sample_time, source_id, observations, share, newest, oldest).

    samples: (location_id, sample_time).  reach: (feature, metric, earliest, latest) in hours before the sample, and a
    fifth, the location, for a covariate of another place.  An observation counts once for a sample, however many
    features read it; unknown values count for nothing.
    """
    _, found = _reads(observations, samples, reach)
    used = found.select("location_id", "sample_time", "observation_id", "source_id", "event_time").dropDuplicates(["location_id", "sample_time", "observation_id"])
    g = used.groupBy("location_id", "sample_time", "source_id").agg(F.count(F.lit(1)).alias("observations"), F.max("event_time").alias("newest"), F.min("event_time").alias("oldest"))
    total = F.sum("observations").over(Window.partitionBy("location_id", "sample_time"))  # as many rows as sources
    return g.withColumn("share", F.try_divide("observations", total))


def missing_inputs(observations: DataFrame, samples: DataFrame, reach: list[tuple]) -> DataFrame:
    """(location_id, sample_time, features): features of a sample that found nothing to read, by name; samples that lack none are left out."""
    asked, found = _reads(observations, samples, reach)
    keys = ["location_id", "sample_time", "feature"]
    none = asked.join(found.select(*keys).distinct(), keys, "left_anti")
    return none.groupBy("location_id", "sample_time").agg(F.sort_array(F.collect_set("feature")).alias("features"))


def anomaly_views(anomalies: DataFrame, scanned: int | Column) -> DataFrame:
    """(leading, anomalies, share of the readings scanned) by best supported explanation."""
    total = F.lit(scanned) if isinstance(scanned, int) else scanned
    return anomalies.groupBy("leading").agg(F.count(F.lit(1)).alias("anomalies")).withColumn("rate", F.coalesce(F.try_divide("anomalies", total), F.lit(0.0)))


def overview(**tables: DataFrame | None) -> DataFrame:
    """One row of counters: rows of each table by name; null where there is no table (not zero)."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    out = spark.range(1).select(F.lit(1).alias("_one"))
    for name, t in tables.items():
        one = spark.range(1).select(F.lit(None).cast("long").alias(name)) if t is None else t.agg(F.count(F.lit(1)).alias(name))
        out = out.crossJoin(one)  # one row each
    return out.drop("_one")


def available(**tables: DataFrame | None) -> dict[str, bool]:
    """Which tables there are and hold a row."""
    return {name: t is not None and not t.isEmpty() for name, t in tables.items()}


def health(spark, **tables: DataFrame | None) -> DataFrame:
    """(artifact, available) of each table."""
    return spark.createDataFrame(sorted(available(**tables).items()), "artifact string, available boolean")


def selected(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have the given values; arguments that are None ask for nothing."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def on_date(rows: DataFrame, column: str, date: str | None) -> DataFrame:
    """Rows of one UTC date."""
    return rows if date is None else rows.filter(F.to_date(column) == F.lit(date).cast("date"))
