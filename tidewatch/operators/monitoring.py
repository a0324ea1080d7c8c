"""Anomaly explanations, drift windows and episodes, promotion of competing models."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def repeated_neighbours(obs: DataFrame, by: tuple[str, ...], reach: int = 3) -> DataFrame:
    """How many of the reach rows on either side have the row's own value."""
    order = Window.partitionBy(*by).orderBy("event_time", "observation_id")
    same = [F.coalesce((f("value", k).over(order) == F.col("value")).cast("int"), F.lit(0)) for f in (F.lag, F.lead) for k in range(1, reach + 1)]
    return obs.withColumn("neighbours", sum(same[1:], same[0]))


def explained(anomalies: DataFrame, rain: Column, status: Column, neighbours: Column, patterned: Column, shifted: Column | None = None) -> DataFrame:
    """Candidate explanations, best supported first; none at all is unexplained with support 0."""
    shifted = F.lit(False) if shifted is None else shifted
    some = lambda kind, support, when: F.when(when, F.struct((-support).alias("neg"), F.lit(kind).alias("kind"), support.alias("support")))
    options = F.array_compact(
        F.array(
            some("rainfall", F.least(F.lit(0.6), 0.2 + rain / 50), rain > 0.5),
            some("recurring_pattern", F.lit(0.8), patterned),
            some("level_shift", F.lit(0.5), shifted),
            some("sensor_suspect", F.when(status == "failed", 0.7).otherwise(0.4), status.isin("failed", "warning")),
            some("sensor_suspect", F.lit(0.75), neighbours >= 2),
        )
    )
    nothing = F.array(F.struct(F.lit(0.0).alias("neg"), F.lit("unexplained").alias("kind"), F.lit(0.0).alias("support")))
    ranked = F.when(F.size(options) > 0, F.array_sort(options)).otherwise(nothing)
    return anomalies.withColumn("explanations", F.transform(ranked, lambda o: F.struct(o["kind"].alias("kind"), o["support"].alias("support")))).withColumns(
        {"leading": ranked[0]["kind"], "support": ranked[0]["support"]}
    )


def explained_by(anomalies: DataFrame, rows: DataFrame, rain: DataFrame, health: DataFrame, patterns: DataFrame, shifts: DataFrame) -> DataFrame:
    """Anomalies of rows with their explanations, from the evidence itself.

    rain: event_time, mm.  health: source_id, status.  patterns: as for covering_patterns.  shifts: location_id of
    zones whose level shifted.  Neighbours are taken among all rows of the zone and metric.
    """
    near = repeated_neighbours(rows, ("location_id", "metric")).select("observation_id", "neighbours")
    covered = covering_patterns(anomalies, patterns).filter("pattern_id is not null").select("observation_id", F.lit(True).alias("patterned")).distinct()
    moved = shifts.select("location_id", F.lit(True).alias("shifted")).distinct()
    found = anomalies.join(rain.select("event_time", "mm"), "event_time", "left").join(health.select("source_id", "status"), "source_id", "left")
    found = found.join(near, "observation_id", "left").join(covered, "observation_id", "left").join(moved, "location_id", "left")
    return explained(found, F.col("mm"), F.col("status"), F.col("neighbours"), F.col("patterned"), F.col("shifted"))


def covering_patterns(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows beside the patterns that cover them, or beside null; null scope fields of a pattern match anything.

    Each distinct scope of rows is keyed by all eight shapes (which fields are given), so that it meets the
    patterns of every shape in one equi-join.
    """
    scope = ("location_id", "weekday", "hour")
    shapes = F.array(*[F.struct(F.lit(m).alias("shape"), *[F.when(F.lit(bool(m >> i & 1)), F.col(c)).alias(c) for i, c in enumerate(scope)]) for m in range(8)])
    cells = rows.select(*scope).distinct().select(F.struct(*scope).alias("cell"), F.explode(shapes).alias("k"))
    shape = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(scope)), F.lit(0))
    p = patterns.select("pattern_id", *scope, shape.alias("shape")).alias("p")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    by_shape = F.col("k.shape") == F.col("p.shape")
    for c in scope:
        by_shape &= same(f"k.{c}", f"p.{c}")
    covered = cells.join(p, by_shape).select("cell", "p.pattern_id").alias("c")
    in_cell = same("r.location_id", "c.cell.location_id") & same("r.weekday", "c.cell.weekday") & same("r.hour", "c.cell.hour")
    return rows.alias("r").join(covered, in_cell, "left").select("r.*", "c.pattern_id")


def weekly_errors(forecasts: DataFrame, start: str, days: int = 7) -> DataFrame:
    """MAE and mean prediction of tumbling windows anchored at start."""
    anchor = C.seconds(F.lit(start).cast("timestamp"))
    index = F.floor((C.seconds(F.col("event_time")) - anchor) / (86400 * days)).cast("int")
    error = F.abs(F.col("predicted") - F.col("actual"))
    return forecasts.filter("predicted is not null").withColumn("window", index).filter("window >= 0").groupBy("window").agg(F.count(F.lit(1)).alias("rows"), F.avg(error).alias("mae"), F.avg("predicted").alias("mean_predicted"))


def performance_status(ratio: Column, gate: Column, rows: Column, least: int = 30) -> Column:
    return F.when(rows < least, "insufficient_data").when(ratio >= gate, "drifted").when(ratio >= (1 + gate) / 2, "minor").otherwise("stable")


def fired(signals: DataFrame) -> DataFrame:
    """One row for each evaluation (stream, detected_at) of its signals (kind, subject, status, statistic, threshold).

    kinds: those that drifted, first by name; the strongest signal is that of the largest statistic over threshold,
    unknown ones aside.
    """
    drifted = F.col("status") == "drifted"
    size = F.try_divide("statistic", "threshold")
    known = drifted & size.isNotNull() & ~F.isnan(size)
    strongest = F.max(F.when(known, F.struct(size.alias("magnitude"), F.col("subject").alias("subject"))))
    g = signals.groupBy("stream", "detected_at").agg(F.sort_array(F.collect_set(F.when(drifted, F.col("kind")))).alias("kinds"), strongest.alias("_s"), F.count(F.lit(1)).alias("signals"))
    return g.select("stream", "detected_at", "kinds", (F.size("kinds") > 0).alias("is_drift"), F.col("_s.magnitude").alias("magnitude"), F.col("_s.subject").alias("subject"), "signals")


def qualifies(kinds: Column, required: Iterable[str]) -> Column:
    """An evaluation counts if one of the required kinds drifted; without required kinds, if any did."""
    names = sorted(required)
    return F.arrays_overlap(kinds, F.array(*map(F.lit, names))) if names else F.size(kinds) > 0


@dataclass
class EpisodeFold:
    """Folds ordered evaluations into episodes; batch and stream share it.

    An evaluation that does not qualify closes the open episode.  A new episode raises a candidate at once; one
    that goes on raises the next only when cooldown_days have passed since the last candidate.
    """

    cooldown_days: int = 28
    required: tuple[str, ...] = ("prediction",)
    open: dict | None = None
    last_candidate: pd.Timestamp | None = None
    done: list[dict] = field(default_factory=list)

    def observe(self, at: pd.Timestamp, kinds: Iterable[str], magnitude: float | None) -> tuple[str | None, bool]:
        """(episode, whether a candidate is raised)."""
        kinds = list(kinds)
        if not (set(kinds) & set(self.required) if self.required else kinds):
            self.close(at)
            return None, False
        size = 0.0 if magnitude is None or pd.isna(magnitude) else float(magnitude)
        if self.open is None:
            self.open = {"episode_id": f"EP-{at:%Y%m%dT%H%M%S}", "onset": at, "last_seen": at, "closed_at": None, "events": 1, "peak": size, "kinds": kinds, "candidates": 0}
            raised = True
        else:
            e = self.open
            e |= {"last_seen": at, "events": e["events"] + 1, "peak": max(e["peak"], size), "kinds": list(dict.fromkeys([*e["kinds"], *kinds]))}
            raised = self.last_candidate is None or at - self.last_candidate >= pd.Timedelta(days=self.cooldown_days)
        if raised:
            self.open["candidates"] += 1
            self.last_candidate = at
        return self.open["episode_id"], raised

    def close(self, at: pd.Timestamp | None = None) -> None:
        if self.open:
            self.done.append(self.open | {"closed_at": at})
            self.open = None


EPISODES = "stream string, episode_id string, onset timestamp, last_seen timestamp, closed_at timestamp, events long, peak double, kinds array<string>, candidates long"


def episodes(evaluations: DataFrame, required: tuple[str, ...] = ("prediction",), cooldown_days: int = 28) -> DataFrame:
    """Episodes of each stream of evaluations (stream, detected_at, kinds, magnitude): one row for each instant, a short series.

    An episode that is open at the end has no closed_at.
    """

    def fold(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = EpisodeFold(cooldown_days, required)
        for r in pdf.sort_values("detected_at").itertuples():
            f.observe(r.detected_at, r.kinds, r.magnitude)
        f.close()
        return pd.DataFrame([{"stream": keys[0], **e} for e in f.done], columns=[c.split()[0] for c in EPISODES.split(", ")])

    return evaluations.groupBy("stream").applyInPandas(fold, EPISODES)


def raised(evaluations: DataFrame, required: tuple[str, ...] = ("prediction",), cooldown_days: int = 28) -> DataFrame:
    """Evaluations that raise a candidate, with their episode."""
    schema = "stream string, detected_at timestamp, episode_id string"

    def fold(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = EpisodeFold(cooldown_days, required)
        told = [(keys[0], r.detected_at, *f.observe(r.detected_at, r.kinds, r.magnitude)) for r in pdf.sort_values("detected_at").itertuples()]
        return pd.DataFrame([t[:3] for t in told if t[3]], columns=["stream", "detected_at", "episode_id"])

    return evaluations.join(evaluations.groupBy("stream").applyInPandas(fold, schema), ["stream", "detected_at"])


def candidates(raised_: DataFrame, champion: str) -> DataFrame:
    """Open candidate updates of raised evaluations: what drifted, how far, and which model serves."""
    return raised_.filter("is_drift").select(
        F.concat(F.lit("CAND-"), F.date_format("detected_at", "yyyyMMdd'T'HHmmss")).alias("candidate_id"),
        "stream", "detected_at", "episode_id", "kinds", "magnitude", F.coalesce("subject", F.lit("unknown")).alias("subject"), F.lit(champion).alias("champion_version"), F.lit("open").alias("status"),
    )


def best_challengers(evaluations: DataFrame) -> DataFrame:
    """(candidate_id, best, winner): least error of all, and of those that passed every rule (ties by version)."""
    key = F.struct("challenger_mae", "version")
    return evaluations.groupBy("candidate_id").agg(F.min_by("version", key).alias("best"), F.min(F.when(F.col("passed"), key))["version"].alias("winner"))


def false_alarms(evaluations: DataFrame, before: str, required: tuple[str, ...] | None = None) -> DataFrame:
    """(stream, false_alarms): firings before a known change; with required, only those that would raise a candidate."""
    counts = F.col("is_drift") if required is None else qualifies(F.col("kinds"), required)
    return evaluations.groupBy("stream").agg(F.count_if((F.col("detected_at") < F.lit(before).cast("timestamp")) & counts).alias("false_alarms"))


def detection_delay(evaluations: DataFrame, change: str, required: tuple[str, ...] | None = None) -> DataFrame:
    """(stream, delay_hours): from a known change to the first firing at or after it; null if none."""
    counts = F.col("is_drift") if required is None else qualifies(F.col("kinds"), required)
    point = F.lit(change).cast("timestamp")
    first = F.min(F.when((F.col("detected_at") >= point) & counts, F.col("detected_at")))
    return evaluations.groupBy("stream").agg(first.alias("_f")).select("stream", ((C.seconds(F.col("_f")) - C.seconds(point)) / 3600).alias("delay_hours"))


def calibrated_gates(windows: DataFrame, multiplier: float = 3.0, least_rows: int = 50, least_windows: int = 4, psi_floor: float = 0.0, ratio_floor: float = 1.0) -> DataFrame:
    """One row of gates from reference windows (rows, psi, mae): mean plus multiplier deviations, floors held.

    The reference error is that of all reference rows, those of thin windows included.  Windows with fewer than
    least_rows rows say nothing else; a gate with fewer than least_windows values is null.  The error gate is a
    ratio to the reference error; ``windows`` counts those that give both values, the fewer of the two.
    """
    base = windows.agg(F.try_divide(F.sum(F.col("mae") * F.col("rows")), F.sum(F.when(F.col("mae").isNotNull(), F.col("rows")))).alias("reference_error"))  # one row
    thick = F.col("rows") >= least_rows
    ratio = F.when(thick & (F.col("reference_error") > 0), F.try_divide("mae", "reference_error"))
    index = F.when(thick & ~F.isnan("psi"), F.col("psi"))
    gate = lambda c: F.when(F.count(c) >= least_windows, F.avg(c) + multiplier * F.stddev_samp(c))
    g = windows.crossJoin(F.broadcast(base)).agg(F.least(F.count(index), F.count(ratio)).alias("windows"), F.max("reference_error").alias("reference_error"), gate(index).alias("_p"), gate(ratio).alias("_r"))
    held = lambda c, floor: F.when(F.col(c).isNotNull(), F.greatest(c, F.lit(floor)))
    return g.select("windows", "reference_error", held("_p", psi_floor).alias("prediction_psi"), held("_r", ratio_floor).alias("performance_ratio"))


def reference_after_training(reference: DataFrame, training_end: str, time: str = "sample_time") -> DataFrame:
    """reference, refused if it starts before the end of training: the champion has seen such rows, and its error there is too small."""
    first = reference.agg(F.min(time).alias("t"), (F.min(time) < F.lit(training_end).cast("timestamp")).alias("early")).first()
    if first["early"]:
        raise ValueError(f"the reference starts {first['t']}, before the training end {training_end}")
    return reference


def prediction_status(psi: Column, gate: Column) -> Column:
    """Against the gate that reference weeks gave, not the usual PSI bands."""
    return F.when(gate.isNull() | F.isnan(gate), "insufficient_reference").when(psi.isNull() | F.isnan(psi), "insufficient_data").when(psi >= gate, "drifted").when(psi >= gate * 0.5, "minor").otherwise("stable")


def monitorable(specs: Iterable[object], watched: Iterable[str], window_hours: int, unfit: tuple[str, ...] = ("rainfall",)) -> tuple[list[str], dict[str, str]]:
    """(features to watch, those left out with the reason): unknown, of an unfit metric, or reaching as far back as the window."""
    known = {s.name: s for s in specs}
    kept, out = [], {}
    for name in watched:
        if name not in known:
            out[name] = "no such feature"
        elif known[name].metric in unfit:
            out[name] = f"{known[name].metric} is mostly zero"
        elif known[name].reach_hours >= window_hours:
            out[name] = f"reaches {known[name].reach_hours} of {window_hours} hours"
        else:
            kept.append(name)
    return kept, out


@dataclass(frozen=True)
class PromotionRules:
    least_rows: int = 200
    least_gain: float = 0.03
    worst_regression: float = 0.05
    least_slice_rows: int = 8


def promotion(scored: DataFrame, protected: dict[str, Column], rules: PromotionRules = PromotionRules(), leakage_clean: bool = True, respects_horizon: bool | None = None) -> DataFrame:
    """One row for each rule (rule, passed, detail) from rows (actual, champion, challenger); absent slices abstain (null).

    respects_horizon: whether the challenger's training targets end before the decision; None leaves that rule out.
    """
    error = lambda c: F.coalesce(F.abs(F.col(c) - F.col("actual")), F.abs("actual"))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(error("champion")).alias("a"), F.avg(error("challenger")).alias("b")]
    for i, p in enumerate(protected.values()):
        aggs += [F.count_if(p).alias(f"n{i}"), F.avg(F.when(p, error("champion"))).alias(f"a{i}"), F.avg(F.when(p, error("challenger"))).alias(f"b{i}")]
    g = scored.agg(*aggs)
    gain = F.try_divide(F.col("a") - F.col("b"), F.col("a"))
    out = [("rows", F.col("n") >= rules.least_rows, F.col("n").cast("double")), ("gain", gain >= rules.least_gain, gain), ("leakage", F.lit(leakage_clean), F.lit(None).cast("double"))]
    if respects_horizon is not None:
        out.append(("horizon", F.lit(respects_horizon), F.lit(None).cast("double")))
    for i, name in enumerate(protected):
        worse = F.try_divide(F.col(f"b{i}") - F.col(f"a{i}"), F.col(f"a{i}"))
        out.append((f"slice:{name}", F.when(F.col(f"n{i}") >= rules.least_slice_rows, worse <= rules.worst_regression), worse))
    structs = [F.struct(F.lit(n).alias("rule"), p.alias("passed"), d.alias("detail")) for n, p, d in out]
    return g.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def decide(outcomes: Iterable[tuple[str, bool | None]]) -> str:
    """promoted if all rules passed or abstained, inconclusive without enough rows, else rejected."""
    found = dict(outcomes)
    if found.get("rows") is False:
        return "inconclusive"
    return "rejected" if any(v is False for v in found.values()) else "promoted"


class ModelRegistry:
    """Versions of models with one champion at most; a small table rewritten as a whole under a new path by its one writer."""

    def __init__(self) -> None:
        self.rows: dict[str, dict] = {}

    def register(self, version: str, **facts: object) -> None:
        if version in self.rows:
            raise ValueError(f"{version} is registered")
        self.rows[version] = {"version": version, "status": "challenger", "supersedes": None, **facts}

    def promote(self, version: str) -> None:
        before = self.champion()
        if before:
            self.rows[before]["status"] = "archived"
        self.rows[version] |= {"status": "champion", "supersedes": before}
        if sum(r["status"] == "champion" for r in self.rows.values()) != 1:
            raise RuntimeError("one champion is expected")

    def reject(self, version: str) -> None:
        self.rows[version]["status"] = "rejected"

    def champion(self) -> str | None:
        return next((v for v, r in self.rows.items() if r["status"] == "champion"), None)

    def lineage(self, version: str) -> list[str]:
        out: list[str] = []
        at: str | None = version
        while at and at not in out:
            out.append(at)
            at = self.rows[at]["supersedes"]
        return out


def verdict(scores: DataFrame) -> DataFrame:
    """Arms by mean error over seeds, with sample deviation, and whether each ties with the best (within one deviation)."""
    g = scores.groupBy("arm").agg(F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("sd"), F.count(F.lit(1)).alias("seeds"))
    best = F.min(F.struct("mean", "arm", "sd")).over(Window.partitionBy())
    return g.withColumn("best", best["arm"]).withColumn("ties", F.abs(F.col("mean") - best["mean"]) <= F.greatest(F.coalesce("sd", F.lit(0.0)), F.coalesce(best["sd"], F.lit(0.0))))
