"""Adaptive replay: a model that is watched, challenged and replaced as a stream goes by, with a log it resumes from.

A replay steps through time.  In each step the window ahead is scored by what each arm serves before anyone acts on
that instant; then the scheduled arm may refit on its calendar, and the adaptive arm, if its recent error has
drifted, investigates: challengers on several training windows are fitted side by side, each is held against the
serving model by the promotion rules, and the best that passes takes over.

Every step is a folder of an append-only log: its scored rows, and then its state, the fitted state of each arm
included.  A replay that broke off goes on after the last step that has a state; a step without one is done again.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptation, monitoring


class Forecaster(Protocol):
    """fit gives a state that JSON can hold (a large model's is the path it is saved under); predict adds ``predicted``."""

    def fit(self, rows: DataFrame) -> dict: ...

    def predict(self, rows: DataFrame, state: dict) -> DataFrame: ...


class ZoneMeans:
    """Says each zone's mean target; zones are few, and new ones get no prediction."""

    def fit(self, rows: DataFrame) -> dict:
        return {r["location_id"]: r["m"] for r in rows.groupBy("location_id").agg(F.avg("target").alias("m")).collect()}

    def predict(self, rows: DataFrame, state: dict) -> DataFrame:
        known = F.create_map(*[F.lit(x) for pair in sorted(state.items()) for x in pair]) if state else F.lit(None).cast("map<string, double>")
        return rows.withColumn("predicted", F.element_at(known, F.col("location_id")).cast("double"))


@dataclass(frozen=True)
class TrainingWindow:
    """The last days before a decision; None for all that is known."""

    name: str
    days: int | None = None


@dataclass(frozen=True)
class Policy:
    """How the adaptive arm acts.

    The serving model drifts where its error on the step before is at least ``drift_ratio`` times the error that it
    had on its reference (the first window after it was fitted).  Challengers are compared on ``evaluation_hours``
    from ``gap_hours`` after the decision.
    """

    windows: tuple[TrainingWindow, ...] = (TrainingWindow("expanding"),)
    rules: monitoring.PromotionRules = monitoring.PromotionRules()
    protected: tuple[str, ...] = ()
    drift_ratio: float = 1.1
    gap_hours: int = 0
    evaluation_hours: int = 168
    cooldown_days: int = 0
    least_rows: int = 500
    offset_hours: float = 0.0


@dataclass
class ArmState:
    """What an arm serves, since when, and what it has cost."""

    name: str
    version: str
    model: dict
    retrains: int = 0
    fits: int = 0
    rows: int = 0
    reference_error: float | None = None


@dataclass
class Step:
    """The state after a step: arms, the candidates that were judged in it, and notes."""

    k: int
    moment: str
    arms: dict[str, ArmState]
    candidates: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    due: str | None = None
    last_investigated: str | None = None


class StepLog:
    """The log of one replay under a shared folder: step=<k>/rows and, once the step is done, step=<k>/state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _done(self) -> list[int]:
        """Numbers of the steps that have a state: one folder each."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        steps = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("step=")]
        return sorted(int(p.getName()[5:]) for p in steps if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "state/_SUCCESS")))

    def last(self) -> Step | None:
        done = self._done()
        if not done:
            return None
        raw = json.loads(self.spark.read.text(f"{self.path}/step={done[-1]}/state").first()[0])
        return Step(**raw | {"arms": {n: ArmState(**a) for n, a in raw["arms"].items()}})

    def save_rows(self, k: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/step={k}/rows")
        return self.spark.read.parquet(f"{self.path}/step={k}/rows")

    def save_state(self, step: Step) -> None:
        self.spark.createDataFrame([(json.dumps(asdict(step), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/step={step.k}/state")

    def rows(self) -> DataFrame:
        """Scored rows of all finished steps."""
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/step={k}/rows" for k in self._done()]).drop("step")

    def candidates(self) -> DataFrame:
        """(candidate_id, version, window, challenger_mae, serving_mae, rows, passed, decision) of all finished steps: a few rows each."""
        out = []
        for k in self._done():
            out += json.loads(self.spark.read.text(f"{self.path}/step={k}/state").first()[0])["candidates"]
        schema = "candidate_id string, version string, window string, challenger_mae double, serving_mae double, rows long, passed boolean, decision string"
        return self.spark.createDataFrame([tuple(c[f.split()[0]] for f in schema.split(", ")) for c in out], schema)


def _error(rows: DataFrame) -> float | None:
    """Mean absolute error; a missing prediction counts as the whole actual value."""
    return rows.agg(F.avg(F.coalesce(F.abs(F.col("predicted") - F.col("target")), F.abs("target"))).alias("e")).first()["e"]


def _investigate(table: DataFrame, moment: datetime, serving: ArmState, forecaster: Forecaster, policy: Policy, clean: bool, notes: list[str]) -> tuple[list[dict], list[tuple[float, str, dict, int]]]:
    """(judged candidates, those that passed every rule with their model): one challenger for each training window, fitted side by side."""
    ahead = adaptation.between(table, "sample_time", moment + timedelta(hours=policy.gap_hours), moment + timedelta(hours=policy.gap_hours + policy.evaluation_hours))
    protected, unknown = adaptation.parse_slices(list(policy.protected), "target_time", policy.offset_hours)
    notes += [f"no such slice: {n}" for n in unknown]

    def one(window: TrainingWindow) -> tuple[dict, dict, int] | str:
        rows = adaptation.training_window(table, moment, window.days)
        n = rows.count()
        if n < policy.least_rows:
            return f"{n} rows before {moment} in {window.name}, {policy.least_rows} needed"
        model = forecaster.fit(rows)
        both = forecaster.predict(forecaster.predict(ahead, serving.model).withColumnRenamed("predicted", "champion"), model).withColumnRenamed("predicted", "challenger")
        both = both.withColumn("actual", F.col("target"))
        rules = [(r["rule"], r["passed"]) for r in monitoring.promotion(both, protected, policy.rules, clean, True).collect()]
        errors = both.agg(*[F.avg(F.coalesce(F.abs(F.col(c) - F.col("target")), F.abs("target"))).alias(c) for c in ("champion", "challenger")]).first()
        decision = monitoring.decide(rules)
        version = f"{moment:%Y%m%d}-{window.name}"
        return {"candidate_id": f"CAND-{moment:%Y%m%dT%H%M%S}", "version": version, "window": window.name, "challenger_mae": errors["challenger"], "serving_mae": errors["champion"], "rows": n, "passed": decision == "promoted", "decision": decision}, model, n

    with ThreadPoolExecutor(max(1, len(policy.windows))) as pool:
        told = list(pool.map(one, policy.windows))
    notes += [t for t in told if isinstance(t, str)]
    judged = [t for t in told if not isinstance(t, str)]
    passed = [(c["challenger_mae"], c["version"], m, n) for c, m, n in judged if c["passed"]]
    return [c for c, _, _ in judged], sorted(passed, key=lambda p: p[:2])


def run(log: StepLog, table: DataFrame, start: datetime, end: datetime, champion: dict, forecaster: Forecaster, policy: Policy = Policy(), step_days: int = 7, scheduled_days: int | None = None, leakage_clean: bool = True, stop_after: int | None = None) -> Step:
    """Replay table (location_id, sample_time, target_time, target) from start to end; the last step's state.

    Resumes behind the last finished step of the log; the scored rows (arm, window, version, predicted) are log.rows().
    stop_after ends the run behind that step, to go on later.  The driver loops over steps; windows are plans.
    """
    state = log.last()
    step = timedelta(days=step_days)
    while True:
        k = 0 if state is None else state.k + 1
        moment = start + k * step
        if moment > end or (stop_after is not None and k > stop_after):
            return state
        if state is None:
            arms = {n: ArmState(n, "static", champion) for n in ("static", "adaptive", *(["scheduled"] if scheduled_days else []))}
            due = (start + timedelta(days=scheduled_days)).isoformat() if scheduled_days else None
            state = Step(k, "", arms, due=due)
        now = Step(k, moment.isoformat(), state.arms, due=state.due, last_investigated=state.last_investigated)
        window = adaptation.between(table, "sample_time", moment, moment + step)
        scored = None
        for arm in now.arms.values():
            one = forecaster.predict(window, arm.model).withColumns({"arm": F.lit(arm.name), "window": F.lit(k), "version": F.lit(arm.version)})
            scored = one if scored is None else scored.unionByName(one)
        log.save_rows(k, scored)
        if scheduled_days and moment >= datetime.fromisoformat(now.due):
            rows = adaptation.training_window(table, moment)
            n, arm = rows.count(), now.arms["scheduled"]
            if n < policy.least_rows:
                now.notes.append(f"{n} rows before {moment}, {policy.least_rows} needed")
            else:
                arm.model, arm.retrains, arm.fits, arm.rows = forecaster.fit(rows), arm.retrains + 1, arm.fits + 1, arm.rows + n
                arm.version = f"scheduled-{arm.retrains}"
            now.due = (datetime.fromisoformat(now.due) + timedelta(days=scheduled_days)).isoformat()
        serving = now.arms["adaptive"]
        recent = _error(forecaster.predict(adaptation.between(table, "sample_time", moment - step, moment), serving.model))
        if serving.reference_error is None:
            serving.reference_error = recent
        elif recent is not None and recent >= policy.drift_ratio * serving.reference_error and _rested(now.last_investigated, moment, policy.cooldown_days):
            now.last_investigated = moment.isoformat()
            now.candidates, passed = _investigate(table, moment, serving, forecaster, policy, leakage_clean, now.notes)
            serving.fits += len(now.candidates)
            serving.rows += sum(c["rows"] for c in now.candidates)
            if passed:
                _, serving.version, serving.model, _ = passed[0]
                serving.retrains += 1
                serving.reference_error = None
        log.save_state(now)
        state = now


def _rested(last: str | None, moment: datetime, days: int) -> bool:
    return last is None or moment - datetime.fromisoformat(last) >= timedelta(days=days)

