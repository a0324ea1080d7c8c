"""Monitoring of many series at once: every feature, the prediction and the error of every window against one reference.

Rows are unrolled once into (series, value, window, whether it is a reference row) and counted.  Everything else is
made of these counts, for all series and windows together: the reference's quantiles, the population stability index
over them, the Kolmogorov-Smirnov distance, and the mean error.  There is no loop over features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import monitoring
from . import statistics as S

#: Series beside the features: a row's own count, its prediction and its absolute error.
_ROW, PREDICTION, _ERROR = "_row", "prediction", "_error"
#: Buckets that the values of a series are ordered in, for the distance.
KS_BUCKETS = 64


@dataclass(frozen=True)
class Gates:
    """Gates in force; None for one that the reference was too short to give."""

    feature_psi: float = 0.25
    prediction_psi: float | None = None
    performance_ratio: float | None = None
    minor_psi: float = 0.1
    ks_effect: float = 0.1
    least_rows: int = 50
    least_sample: int = 30
    bins: int = 10


def value_counts(rows: DataFrame, features: list[str], in_reference: Column, window: Column) -> DataFrame:
    """(series, value, window, n, ref): rows of each value in each window, and those that are reference rows.

    rows: the features, predicted and actual.  window is null for rows of no window.  Unknown values are left out.
    """
    series = {_ROW: F.lit(0.0), PREDICTION: F.col("predicted").cast("double"), _ERROR: F.abs(F.col("predicted") - F.col("actual")).cast("double")} | {f: F.col(f).cast("double") for f in features}
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), v.alias("value")) for n, v in series.items()]))
    unrolled = rows.select(window.alias("window"), F.coalesce(in_reference, F.lit(False)).cast("long").alias("ref"), cells.alias("x")).select("x.*", "window", "ref")
    known = unrolled.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("window").isNotNull() | (F.col("ref") > 0)))
    return known.groupBy("series", "value", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("ref").alias("ref"))


def stability(counts: DataFrame, bins: int = 10, least: int = 30, floor: float = 1e-6) -> DataFrame:
    """(series, window, psi, reference_rows, recent_rows): psi is null for thin samples or a reference of too few values."""
    reference = counts.groupBy("series", "value").agg(F.sum("ref").alias("ref")).filter("ref > 0")
    edges = S.counted_quantiles(reference, ["series"], "value", "ref", [k / bins for k in range(1, bins)]).withColumnRenamed("rows", "reference_rows")  # a row for each series
    slot = F.size(F.filter("quantiles", lambda e: e <= F.col("value")))
    placed = counts.join(F.broadcast(edges), "series").groupBy("series", "window", slot.alias("bin")).agg(F.sum("n").alias("n"), F.sum("ref").alias("ref"))
    # From here on there are at most series x windows x bins rows.
    grid = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("by", b), F.lit(0).cast("long")))
    base = placed.groupBy("series", "bin").agg(F.sum("ref").alias("n")).groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by")).select("series", grid.alias("a"))
    recent = placed.filter("window is not null").groupBy("series", "window").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by")).select("series", "window", grid.alias("b"))
    full = recent.join(F.broadcast(base), "series").join(F.broadcast(edges), "series")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    full = full.withColumns({"recent_rows": total("b"), "_n": total("a")})
    share = lambda x, n: F.greatest(F.coalesce(F.try_divide(x, n), F.lit(0.0)), F.lit(floor))
    term = lambda x: (share(x["b"], F.col("recent_rows")) - share(x["a"], F.col("_n"))) * F.log(share(x["b"], F.col("recent_rows")) / share(x["a"], F.col("_n")))
    index = F.aggregate(F.transform(F.arrays_zip("a", "b"), term), F.lit(0.0), lambda x, y: x + y)
    known = (F.col("reference_rows") >= least) & (F.col("recent_rows") >= least) & ~S.degenerate(F.col("quantiles"), bins)
    return full.select("series", "window", F.when(known, index).alias("psi"), "reference_rows", "recent_rows")


def distances(counts: DataFrame, least: int = 30) -> DataFrame:
    """(series, window, ks): the largest distance of each window's distribution from the reference's; null for thin samples.

    Between two values of a window its own distribution stands still while the reference's rises, so it is enough to
    look at each of the window's values, and just below it.  Values are ordered inside buckets of their series only.
    """
    grid = [k / KS_BUCKETS for k in range(1, KS_BUCKETS)]
    edges = counts.groupBy("series").agg(F.percentile_approx("value", grid, 1000).alias("_edges"))  # a row for each series
    placed = counts.join(F.broadcast(edges), "series").withColumn("_b", F.size(F.filter("_edges", lambda e: e <= F.col("value")))).drop("_edges")
    below = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    lower = lambda by, c: F.coalesce(F.sum(c).over(below.partitionBy(*by)), F.lit(0))  # noqa: E731  at most KS_BUCKETS rows
    ref = placed.groupBy("series", "_b").agg(F.sum("ref").alias("r")).withColumns({"_rlow": lower(["series"], "r"), "_rall": F.sum("r").over(Window.partitionBy("series"))}).drop("r")
    own = placed.filter("window is not null").groupBy("series", "window", "_b").agg(F.sum("n").alias("w")).withColumns({"_wlow": lower(["series", "window"], "w"), "_wall": F.sum("w").over(Window.partitionBy("series", "window"))}).drop("w")
    value = Window.partitionBy("series", "_b").orderBy("value")  # values that are equal count together
    placed = placed.withColumns({"_rup": F.sum("ref").over(value), "_tie": F.sum("ref").over(Window.partitionBy("series", "_b", "value")), "_wup": F.sum("n").over(Window.partitionBy("series", "window", "_b").orderBy("value"))})
    met = placed.filter("window is not null").join(F.broadcast(ref), ["series", "_b"]).join(own, ["series", "window", "_b"])
    at = lambda up, low, all_, less=F.lit(0): F.try_divide(F.col(up) + F.col(low) - less, F.col(all_))
    apart = F.greatest(F.abs(at("_wup", "_wlow", "_wall") - at("_rup", "_rlow", "_rall")), F.abs(at("_wup", "_wlow", "_wall", F.col("n")) - at("_rup", "_rlow", "_rall", F.col("_tie"))))
    g = met.groupBy("series", "window").agg(F.max(apart).alias("ks"), F.max("_rall").alias("_r"), F.max("_wall").alias("_w"))
    return g.select("series", "window", F.when((F.col("_r") >= least) & (F.col("_w") >= least), F.col("ks")).alias("ks"))


def errors(counts: DataFrame) -> DataFrame:
    """(window, rows, mae, reference_error): mean absolute errors; a row for each window."""
    e = counts.filter(F.col("series") == _ERROR)
    base = e.agg(F.try_divide(F.sum(F.col("value") * F.col("ref")), F.sum("ref")).alias("reference_error"))  # one row
    mae = e.filter("window is not null").groupBy("window").agg(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("mae"))
    rows = counts.filter((F.col("series") == _ROW) & F.col("window").isNotNull()).groupBy("window").agg(F.sum("n").alias("rows"))
    return rows.join(mae, "window", "left").crossJoin(F.broadcast(base))


def signals(rows: DataFrame, features: list[str], in_reference: Column, window: Column, gates: Gates = Gates()) -> DataFrame:
    """(window, kind, subject, status, statistic, threshold, ks, ks_agrees, reference_rows, recent_rows): every signal of every window.

    features are those that can be monitored (``monitoring.monitorable``).  A window of fewer than least_rows rows gives
    one signal, that it says nothing.  A gate that the reference could not give leaves its signal inconclusive.
    """
    counts = value_counts(rows, features, in_reference, window)
    e = errors(counts)
    thick = e.filter(F.col("rows") >= gates.least_rows).select("window", F.col("rows").alias("_rows"), "mae", "reference_error")
    moved = stability(counts.filter(~F.col("series").isin(_ROW, _ERROR)), gates.bins, gates.least_sample).join(distances(counts.filter(~F.col("series").isin(_ROW, _ERROR)), gates.least_sample), ["series", "window"], "left")
    moved = moved.join(F.broadcast(thick.select("window")), "window")
    number = lambda v: F.lit(v).cast("double")
    feature = F.when(F.col("psi").isNull(), "insufficient_data").when(F.col("psi") >= gates.feature_psi, "drifted").when(F.col("psi") >= gates.minor_psi, "minor").otherwise("stable")
    is_feature = F.col("series") != PREDICTION
    told = moved.select(
        "window", F.when(is_feature, "feature").otherwise("prediction").alias("kind"), F.col("series").alias("subject"),
        F.when(is_feature, feature).otherwise(monitoring.prediction_status(F.col("psi"), number(gates.prediction_psi))).alias("status"),
        F.when(is_feature | F.lit(gates.prediction_psi is not None), F.col("psi")).alias("statistic"), F.when(is_feature, number(gates.feature_psi)).otherwise(number(gates.prediction_psi)).alias("threshold"),
        F.when(is_feature, F.col("ks")).alias("ks"), F.when(is_feature, F.coalesce((F.col("ks") >= gates.ks_effect) == (F.col("psi") >= gates.feature_psi), F.lit(False))).alias("ks_agrees"), "reference_rows", "recent_rows",
    )
    gate = number(gates.performance_ratio)
    ratio = F.try_divide("mae", "reference_error")
    all_ref = F.broadcast(counts.filter(F.col("series") == _ROW).agg(F.sum("ref").alias("reference_rows")))  # one row
    worse = F.when(gate.isNull(), "insufficient_reference").when(ratio.isNull(), "insufficient_data").otherwise(monitoring.performance_status(ratio, gate, F.col("_rows"), gates.least_sample))
    none = F.lit(None)
    told = told.unionByName(thick.crossJoin(all_ref).select("window", F.lit("performance").alias("kind"), F.lit("mae").alias("subject"), worse.alias("status"), F.when(gate.isNotNull(), ratio).alias("statistic"), gate.alias("threshold"), none.cast("double").alias("ks"), none.cast("boolean").alias("ks_agrees"), "reference_rows", F.col("_rows").alias("recent_rows")))
    thin = e.filter(F.col("rows") < gates.least_rows).crossJoin(all_ref)
    return told.unionByName(thin.select("window", F.lit("performance").alias("kind"), F.lit("window").alias("subject"), F.lit("insufficient_data").alias("status"), none.cast("double").alias("statistic"), none.cast("double").alias("threshold"), none.cast("double").alias("ks"), none.cast("boolean").alias("ks_agrees"), "reference_rows", F.col("rows").alias("recent_rows")))
