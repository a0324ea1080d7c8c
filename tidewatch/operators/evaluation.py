"""Thresholds, forecasts' error slices, calibration and congestion windows.

Frames of forecasts have columns location_id, event_time, actual, predicted and, where needed,
probability.  A missing prediction counts as an error of the whole actual value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.special import normal_sf


def thresholds(series: DataFrame, share: float = 0.9) -> DataFrame:
    """Exact percentile of each zone's values, linearly interpolated."""
    return series.groupBy("location_id").agg(F.percentile("value", F.lit(share)).alias("threshold"))


def graded(series: DataFrame, limits: DataFrame) -> DataFrame:
    """ratio, congested (strictly above) and severity; limits has one row for each zone."""
    rows = series.join(limits, "location_id", "left")
    r = C.ratio(F.col("value"), F.col("threshold"))
    return rows.withColumn("ratio", r).withColumn("congested", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False))).withColumn("severity", C.severity(F.col("ratio")))


def congestion_windows(rows: DataFrame) -> DataFrame:
    """Stretches of congested hours exactly one hour apart; the end is an hour after the last."""
    w = Window.partitionBy("location_id").orderBy("event_time")
    hot = rows.filter("congested").withColumn("_island", C.seconds(F.col("event_time")) - 3600 * F.row_number().over(w))
    g = hot.groupBy("location_id", "_island").agg(
        F.min("event_time").alias("start"), (F.max("event_time") + F.expr("make_dt_interval(0, 1, 0, 0)")).alias("end"), F.count(F.lit(1)).alias("hours"),
        F.max("value").alias("peak_value"), F.max_by("severity", C.severity_rank(F.col("severity"))).alias("peak_severity"),
    )
    return g.drop("_island")


def error_metrics() -> dict[str, Column]:
    error = F.coalesce(F.abs(F.col("predicted") - F.col("actual")), F.abs("actual"))
    return {
        "rows": F.count(F.lit(1)), "mae": F.avg(error), "rmse": F.sqrt(F.avg(error * error)),
        "coverage": F.avg(F.col("predicted").isNotNull().cast("double")), "mean_actual": F.avg("actual"),
    }


def slice_metrics(forecasts: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Metrics of overlapping slices (name -> predicate) in one pass: each row counts in every slice that holds it."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in slices.items()]))
    return forecasts.withColumn("slice", F.explode(names)).groupBy("slice").agg(*[c.alias(n) for n, c in error_metrics().items()])


def error_breakdowns(forecasts: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Metrics by each dimension and overall, by grouping sets over one scan."""
    rows = forecasts.withColumns(dims)
    sets = [[F.col(d)] for d in dims] + [[]]
    grouped = rows.groupingSets(sets, *[F.col(d) for d in dims]).agg(F.grouping_id().alias("_g"), *[c.alias(n) for n, c in error_metrics().items()])
    width = len(dims)
    dimension = F.lit("overall")
    member = F.lit("all")
    for i, d in enumerate(dims):
        here = F.col("_g").bitwiseAND(1 << (width - 1 - i)) == 0
        dimension, member = F.when(here, d).otherwise(dimension), F.when(here, F.col(d).cast("string")).otherwise(member)
    return grouped.select(dimension.alias("dimension"), member.alias("member"), *error_metrics())


def weakest(slices: DataFrame, name: str, least: int = 30, top: int = 5) -> DataFrame:
    """The top slices by MAE relative to the mean actual."""
    relative = F.try_divide(F.col("mae"), F.abs("mean_actual"))
    return slices.filter(F.col("rows") >= least).withColumn("relative_mae", relative).orderBy(F.desc("relative_mae"), name).limit(top)


def reliability(rows: DataFrame, probability: str = "probability", outcome: str = "outcome") -> DataFrame:
    """Ten equal bins, the last closed; empty bins do not appear."""
    slot = F.least(F.floor(F.col(probability) * 10), F.lit(9)).cast("int")
    return rows.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg(probability).alias("mean_predicted"), F.avg(F.col(outcome).cast("double")).alias("observed"))


def brier(rows: DataFrame, probability: str = "probability", outcome: str = "outcome") -> DataFrame:
    y = F.col(outcome).cast("double")
    base = rows.agg(F.avg((F.col(probability) - y) * (F.col(probability) - y)).alias("brier"), F.avg(y).alias("base_rate"), F.count(F.lit(1)).alias("rows"))
    return base.withColumn("reference_brier", F.col("base_rate") * (1 - F.col("base_rate")))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    weight = F.col("count") / F.sum("count").over(Window.partitionBy())
    return bins.withColumn("_e", weight * F.abs(F.col("mean_predicted") - F.col("observed"))).agg(F.sum("_e").alias("calibration_error"))


def classification(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    p, a = F.col(predicted), F.col(actual)
    g = rows.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return g.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def residual_intervals(forecasts: DataFrame, least: int = 10, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Residual quantiles of each zone; zones with few rows take the global ones."""
    known = forecasts.filter("predicted is not null").withColumn("_e", F.col("actual") - F.col("predicted"))
    q = F.percentile("_e", F.array(F.lit(low), F.lit(high)))
    all_ = known.agg(q.alias("_g"))
    zones = known.groupBy("location_id").agg(q.alias("_q"), F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(all_))
    pick = F.when(F.col("rows") >= least, F.col("_q")).otherwise(F.col("_g"))
    return zones.select("location_id", "rows", pick[0].alias("lower_offset"), pick[1].alias("upper_offset"))


def residual_sigma(forecasts: DataFrame) -> DataFrame:
    """One row (sigma, rows): population deviation of the residuals, 1e-6 at least."""
    return forecasts.filter("predicted is not null and actual is not null").agg(F.greatest(F.lit(1e-6), F.stddev_pop(F.col("actual") - F.col("predicted"))).alias("sigma"), F.count(F.lit(1)).alias("rows"))


def tail_probability(predicted: Column, threshold: Column, sigma: float | Column) -> Column:
    """Probability that the actual value is above the threshold, for normal residuals; null without threshold or prediction."""
    return normal_sf((threshold - predicted) / (F.lit(sigma) if isinstance(sigma, (int, float)) else sigma))


def calibration_report(rows: DataFrame, raw: str, calibrated_: str, outcome: str, fitted_rate: float | None = None, dataset: str = "", fitted_on: str | None = None) -> DataFrame:
    """One row: Brier scores before and after calibration and of the fitting base rate, calibration error, and which way it errs."""
    y = F.col(outcome).cast("double")
    square = lambda c: F.avg((c - y) * (c - y))
    rate = F.avg(y)
    reference = F.lit(fitted_rate) if fitted_rate is not None else None
    known = rows.filter(F.col(raw).isNotNull() & F.col(outcome).isNotNull())
    scores = known.agg(
        F.count(F.lit(1)).alias("rows"), rate.alias("base_rate"), square(F.col(raw)).alias("raw_brier"), square(F.col(calibrated_)).alias("calibrated_brier"),
        (square(reference) if reference is not None else rate * (1 - rate)).alias("reference_brier"),
    )
    bins = reliability(known, calibrated_, outcome)
    gap = F.col("observed") - F.col("mean_predicted")
    errors = bins.agg(F.try_divide(F.sum(F.col("count") * F.abs(gap)), F.sum("count")).alias("calibration_error"), F.sum(F.col("count") * gap).alias("_lean"))
    direction = F.when(F.col("calibration_error").isNull() | (F.col("calibration_error") < 0.02), "well matched").when(F.col("_lean") > 0, "under-confident").otherwise("over-confident")
    shift = F.lit(fitted_rate) - F.col("base_rate") if fitted_rate is not None else F.lit(0.0)
    out = scores.crossJoin(errors)  # one row each
    return out.withColumns({"dataset": F.lit(dataset), "improved": F.col("calibrated_brier") <= F.col("raw_brier"), "beats_base_rate": F.col("calibrated_brier") < F.col("reference_brier"), "direction": direction, "base_rate_shift": shift, "in_sample": F.lit(bool(fitted_on) and dataset == fitted_on)}).drop("_lean")


def isotonic(rows: DataFrame, raw: str = "raw", outcome: str = "outcome") -> tuple:
    """(model, floor): isotonic calibration and its clip, 3 / n at most a half."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    data = rows.select(array_to_vector(F.array(F.col(raw).cast("double"))).alias("features"), F.col(outcome).cast("double").alias("label"))
    n = data.count()
    return IsotonicRegression().fit(data), min(0.5, 3 / max(n, 1))


def calibrated(rows: DataFrame, model, floor: float, raw: str = "raw") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(rows.withColumn("features", array_to_vector(F.array(F.col(raw).cast("double")))))
    return scored.withColumn("probability", F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.col("prediction")))).drop("features", "prediction")
