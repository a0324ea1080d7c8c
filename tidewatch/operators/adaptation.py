"""Challengers and replays: what was known at a decision, who trains on it, and how arms compare."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import evaluation

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


class TooFewRows(ValueError):
    """A challenger has too little to learn from."""


def instant(at: str | datetime) -> Column:
    return F.lit(str(at)).cast("timestamp_ntz")


def between(rows: DataFrame, column: str, start: str | datetime, end: str | datetime) -> DataFrame:
    """Rows with start <= column < end."""
    return rows.filter((F.col(column) >= instant(start)) & (F.col(column) < instant(end)))


def available_at(table: DataFrame, decision: str | datetime) -> DataFrame:
    """Rows that existed before the decision: sampled before it, and their targets measured before it."""
    return table.filter((F.col("sample_time") < instant(decision)) & (F.col("target_time") < instant(decision)))


def training_window(table: DataFrame, decision: str | datetime, days: int | None = None) -> DataFrame:
    """What was available, from days before the decision on (first instant included), or all of it."""
    rows = available_at(table, decision)
    return rows if days is None else rows.filter(F.col("sample_time") >= instant(decision) - F.expr(f"make_dt_interval({int(days)}, 0, 0, 0)"))


def evaluation_window(table: DataFrame, decision: str | datetime, gap_hours: int, span_hours: int) -> DataFrame:
    """Rows sampled from gap_hours after the decision on, for span_hours."""
    begin = instant(decision) + F.expr(f"make_dt_interval(0, {int(gap_hours)}, 0, 0)")
    return table.filter((F.col("sample_time") >= begin) & (F.col("sample_time") < begin + F.expr(f"make_dt_interval(0, {int(span_hours)}, 0, 0)")))


def scenario_bounds(table: DataFrame, train_days: int, reference_days: int) -> DataFrame:
    """One row (train_end, reference_end, replay_end), counted from the first sample."""
    first = table.agg(F.min("sample_time").alias("_a"), F.max("sample_time").alias("replay_end"))
    days = lambda n: F.expr(f"make_dt_interval({int(n)}, 0, 0, 0)")
    return first.select((F.col("_a") + days(train_days)).alias("train_end"), (F.col("_a") + days(train_days + reference_days)).alias("reference_end"), "replay_end")


def parse_slice(name: str, time: str = "target_time", offset_hours: float = 0.0) -> Column | None:
    """Predicate of a protected slice: "ZONE-A", or "ZONE-B Fri 18-20" in local time (end excluded); None if it says neither."""
    found = re.fullmatch(r"(\S+)(?:\s+(Fri)\s+(\d+)-(\d+))?", name.strip())
    if not found:
        return None
    zone = F.col("location_id") == found[1]
    if found[2] is None:
        return zone
    local = C.local_time(F.col(time), offset_hours)
    return zone & (F.weekday(local) == WEEKDAYS.index(found[2])) & (F.hour(local) >= int(found[3])) & (F.hour(local) < int(found[4]))


def parse_slices(names: list[str], time: str = "target_time", offset_hours: float = 0.0) -> tuple[dict[str, Column], list[str]]:
    """(predicates by name, names that were not understood)."""
    found = {n: parse_slice(n, time, offset_hours) for n in names}
    return {n: p for n, p in found.items() if p is not None}, [n for n, p in found.items() if p is None]


def train_challenger(table: DataFrame, decision: str | datetime, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], days: int | None = None, least: int = 500) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """(predict, training rows) of a model fitted on what was available at the decision."""
    rows = training_window(table, decision, days)
    n = rows.count()
    if n < least:
        raise TooFewRows(f"{n} rows before {decision}, {least} needed")
    return fit(rows), n


def zone_means(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A forecaster that says each zone's mean target; zones are few, and new ones get no prediction."""
    means = rows.groupBy("location_id").agg(F.avg("target").alias("predicted"))
    return lambda table: table.join(F.broadcast(means), "location_id", "left")


@dataclass
class Arm:
    """One policy in a replay: what it serves, and what it has cost."""

    name: str
    serving: Callable[[DataFrame], DataFrame]
    versions: list[str] = field(default_factory=list)
    retrains: int = 0
    fits: int = 0
    rows: int = 0


def replay(
    table: DataFrame,
    start: datetime,
    end: datetime,
    champion: Callable[[DataFrame], DataFrame],
    fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    step_days: int = 7,
    scheduled_days: int | None = None,
    drifted: Callable[[datetime, Callable[[DataFrame], DataFrame]], bool] | None = None,
    accept: Callable[[datetime, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]], bool] | None = None,
    least: int = 500,
) -> tuple[DataFrame, list[Arm], list[str]]:
    """(scored rows (arm, window, columns of table, predicted), arms, notes): arms side by side over the same rows.

    In each step the window ahead is scored with whatever an arm serves before anyone acts on that instant.  The
    static arm keeps the champion; the scheduled arm refits on its calendar and always deploys; the adaptive arm
    asks drifted(instant, serving), trains a challenger on what was available, and deploys it if
    accept(instant, serving, challenger).  The driver loops over instants; every window is a plan over its rows.
    """
    static, scheduled, adaptive = Arm("static", champion, ["static"]), Arm("scheduled", champion, ["static"]), Arm("adaptive", champion, ["static"])
    arms = [static, adaptive] + ([scheduled] if scheduled_days else [])
    due = start + timedelta(days=scheduled_days or 0)
    parts: list[DataFrame] = []
    notes: list[str] = []
    moment, k = start, 0
    while moment <= end:
        window = between(table, "sample_time", moment, moment + timedelta(days=step_days))
        parts += [arm.serving(window).withColumns({"arm": F.lit(arm.name), "window": F.lit(k)}) for arm in arms]
        if scheduled_days and moment >= due:
            try:
                scheduled.serving, n = train_challenger(table, moment, fit, least=least)
            except TooFewRows as e:
                notes.append(str(e))
            else:
                scheduled.retrains, scheduled.fits, scheduled.rows = scheduled.retrains + 1, scheduled.fits + 1, scheduled.rows + n
                scheduled.versions.append(f"scheduled-{scheduled.retrains}")
            due += timedelta(days=scheduled_days)
        if drifted is not None and drifted(moment, adaptive.serving):
            try:
                challenger, n = train_challenger(table, moment, fit, least=least)
            except TooFewRows as e:
                notes.append(str(e))
            else:
                adaptive.fits, adaptive.rows = adaptive.fits + 1, adaptive.rows + n
                if accept is None or accept(moment, adaptive.serving, challenger):
                    adaptive.serving = challenger
                    adaptive.retrains += 1
                    adaptive.versions.append(f"adaptive-{adaptive.retrains}")
        moment, k = moment + timedelta(days=step_days), k + 1
    if len(adaptive.versions) == 1:
        notes.append("the adaptive arm never changed its model and equals the static arm")
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return scored, arms, notes


def score_arms(scored: DataFrame, limits: DataFrame, by: tuple[str, ...] = ("arm",), sigma: float | Column = 1.0) -> DataFrame:
    """Metrics of each arm from rows (arm, location_id, actual, predicted) and zone thresholds (location_id, threshold).

    Errors count a missing prediction as the whole actual value; probabilities are of the residual tail with
    deviation sigma, and rows without one are left out of the Brier scores.
    """
    rows = scored.join(F.broadcast(limits), "location_id", "left")  # a row for each zone
    said, was = F.coalesce(F.col("predicted") > F.col("threshold"), F.lit(False)), F.coalesce(F.col("actual") > F.col("threshold"), F.lit(False))
    rows = rows.withColumns({"_p": evaluation.tail_probability(F.col("predicted"), F.col("threshold"), sigma), "_said": said, "_was": was})
    miss = F.col("_p") - F.col("_was").cast("double")
    counts = {"tp": F.count_if(F.col("_said") & F.col("_was")), "fp": F.count_if(F.col("_said") & ~F.col("_was")), "fn": F.count_if(~F.col("_said") & F.col("_was"))}
    g = rows.groupBy(*by).agg(*[c.alias(n) for n, c in evaluation.error_metrics().items()], F.avg(miss * miss).alias("brier"), F.avg(F.col("_was").cast("double")).alias("base_rate"), *[c.alias(n) for n, c in counts.items()])
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return g.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "reference_brier": F.col("base_rate") * (1 - F.col("base_rate"))})


def compare_slices(slices: DataFrame, arm: str = "adaptive", base: str = "static") -> DataFrame:
    """(slice, base_mae, arm_mae, change) of two arms' sliced metrics (arm, slice, mae); slices that only one has stay."""
    one = lambda name, to: slices.filter(F.col("arm") == name).select("slice", F.col("mae").alias(to))
    both = one(base, "base_mae").join(one(arm, "arm_mae"), "slice", "full")
    return both.withColumn("change", F.try_divide(F.col("arm_mae") - F.col("base_mae"), F.col("base_mae")))


def summarise_arms(scores: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """Mean and sample deviation over seeds of each arm (or arm and slice), ranked by mean error."""
    g = scores.groupBy(*by).agg(F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("sd_mae"), F.avg("rmse").alias("mean_rmse"), F.count(F.lit(1)).alias("seeds"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*[c for c in by if c != "arm"]).orderBy("mean_mae", "arm")))  # arms are few


def regressions(summary: DataFrame) -> DataFrame:
    """(arm, slice, mean_mae, best_rival): slices on which an arm is worse than the best of the others; unknown means aside."""
    known = summary.filter(F.col("mean_mae").isNotNull() & ~F.isnan("mean_mae")).select("arm", "slice", "mean_mae")
    rival = known.select(F.col("arm").alias("_rival"), "slice", F.col("mean_mae").alias("_m"))
    met = known.join(rival, "slice").filter("arm <> _rival")  # arms are few
    return met.groupBy("arm", "slice", "mean_mae").agg(F.min("_m").alias("best_rival")).filter("mean_mae > best_rival")


def run_seeds(seeds: list[int], run: Callable[[int], DataFrame]) -> DataFrame:
    """Scores (arm, ...) of one run for each seed, with the seed."""
    out = None
    for seed in seeds:
        one = run(seed).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out


def version_name(base: str, index: int, decision: datetime, window: str) -> str:
    return f"{base}.{index}-{decision:%Y%m%d}-{window}"
