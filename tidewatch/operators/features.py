"""Backward-looking features, temporal splits and the leakage probe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


@dataclass(frozen=True)
class FeatureSpec:
    """A feature by what it reads: offset_hours before the sample, over window_hours; nothing after it."""

    name: str
    kind: str
    offset_hours: int = 0
    window_hours: int = 0
    metric: str | None = None
    location: str | None = None

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a feature needs a name")
        if self.offset_hours < 0 or self.window_hours < 0:
            raise ValueError(f"{self.name} would read the future")

    @property
    def reach_hours(self) -> int:
        return self.offset_hours + self.window_hours

    def earliest(self, sample_time: Column) -> Column:
        return sample_time - hours(self.reach_hours)

    def latest(self, sample_time: Column) -> Column:
        return sample_time - hours(self.offset_hours)


#: Calendar features by name, of a local wall time.
CALENDAR = ("hour", "hour_sin", "hour_cos", "weekday", "is_weekend", "month", "month_sin", "month_cos")


def feature_specs(config: dict, horizon_hours: int | None = None) -> list[FeatureSpec]:
    """Specs of a feature configuration: calendar, lags, seasonal_lags (before the target), rolling_means, covariates, include_zone."""
    target, horizon = config["target_metric"], horizon_hours or config.get("horizon_hours", 1)
    unknown = [c for c in config.get("calendar") or [] if c not in CALENDAR]
    if unknown:
        raise ValueError(f"unknown calendar features {unknown}")
    specs = [FeatureSpec(c, "calendar") for c in config.get("calendar") or []]
    for key, kind in (("lags", "lag"), ("seasonal_lags", "seasonal_lag"), ("rolling_means", "roll_mean")):
        for n in config.get(key) or []:
            if not isinstance(n, int):
                raise ValueError(f"{key}: {n!r} is not a number of hours")
            offset = {"lag": n, "seasonal_lag": n - horizon, "roll_mean": 0}[kind]
            specs.append(FeatureSpec(f"{kind}_{n}h", "rolling" if kind == "roll_mean" else "lag", offset, n if kind == "roll_mean" else 0, target))
    for c in config.get("covariates") or []:
        if "metric" not in c or "location" not in c:
            raise ValueError("a covariate needs metric and location")
        offset, window = int(c.get("offset_hours", 0)), int(c.get("window_hours", 0))
        specs.append(FeatureSpec(f"{c['metric']}_{f'roll_{window}h' if window else f'{offset}h'}", "covariate", offset, window, c["metric"], c["location"]))
    if config.get("include_zone"):
        specs.append(FeatureSpec("zone", "spatial"))
    twice = {s.name for s in specs if sum(t.name == s.name for t in specs) > 1}
    if twice:
        raise ValueError(f"features named twice: {sorted(twice)}")
    return specs


def series_index(obs: DataFrame) -> DataFrame:
    """(location_id, metric, event_time, value) of observations; two with one key are an error, as a lookup would be a guess."""
    keys = ["location_id", "metric", "event_time"]
    twice = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two observations at {twice[0][:3]}")
    return obs.select(*keys, "value")


def build_features(series: DataFrame, specs: list[FeatureSpec], target_metric: str, horizon_hours: int = 1, offset_hours: float = 0.0, least: int = 2) -> DataFrame:
    """Feature table of a series (location_id, metric, event_time, value): a row for each known target, a column for each spec.

    Lookups are at exact instants before sample_time = target_time - horizon; windows end there.  All lags and
    means of one metric and place are windows over one sorted spine that has a row at every sample time.
    """
    own = series.filter(F.col("metric") == target_metric)
    targets = own.filter("value is not null").select("location_id", F.col("event_time").alias("target_time"), F.col("value").alias("target")).withColumn("sample_time", F.col("target_time") - hours(horizon_hours))
    zones = targets.select("location_id").distinct()
    out = targets.withColumns({k: v for k, v in C.calendar(C.local_time(F.col("target_time"), offset_hours)).items() if any(s.name == k and s.kind == "calendar" for s in specs)})
    for metric, place in sorted({(s.metric, s.location) for s in specs if s.metric is not None}, key=str):
        mine = [s for s in specs if (s.metric, s.location) == (metric, place)]
        rows = series.filter((F.col("metric") == metric) & (F.lit(True) if place is None else F.col("location_id") == place)).select("location_id", "event_time", "value")
        at = targets.select("location_id" if place is None else F.lit(place).alias("location_id"), F.col("sample_time").alias("event_time")).distinct()
        full = rows.unionByName(at.join(rows, ["location_id", "event_time"], "left_anti").withColumn("value", F.lit(None).cast("double")))
        made = {}
        for s in mine:
            w = past(s.reach_hours - 1, s.offset_hours) if s.window_hours else past(s.offset_hours, s.offset_hours)
            made[s.name] = F.when(F.count("value").over(w) >= least, F.avg("value").over(w)) if s.window_hours else F.max("value").over(w)
        table = looking_back(full, made, max(s.reach_hours for s in mine)).select("location_id", F.col("event_time").alias("sample_time"), *made)
        out = out.join(table, ["location_id", "sample_time"], "left") if place is None else out.join(table.drop("location_id"), "sample_time", "left")
    if any(s.kind == "spatial" for s in specs):
        codes = zones.withColumn("zone", F.dense_rank().over(Window.orderBy("location_id")) - 1)  # zones are few
        out = out.join(F.broadcast(codes), "location_id")
    return out.select("location_id", "target_time", "sample_time", "target", *[s.name for s in specs])


def missing_counts(table: DataFrame, names: list[str]) -> DataFrame:
    """(feature, missing, rows): how often each feature is unknown."""
    g = table.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    return g.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("missing")) for n in names])).alias("x"), "rows").select("x.*", "rows")


def hourly(obs: DataFrame) -> DataFrame:
    """Mean value of each zone and hour: one row for each key, so that point lookups are well defined."""
    return obs.groupBy("location_id", "event_time").agg(F.avg("value").alias("value"))


def hours(n: int) -> Column:
    return F.expr(f"make_dt_interval(0, {int(n)}, 0, 0)")


#: Days of a series that one task holds, beside what its windows reach back.
BUCKET_DAYS = 56


def looking_back(rows: DataFrame, made: dict[str, Column], reach_hours: int) -> DataFrame:
    """rows with the columns made over ``past`` windows, which reach back reach_hours at most.

    A zone is cut into stretches of time, and each stretch also gets the rows that its windows reach back to: so
    a series is spread over tasks however long it is, and however few zones there are.
    """
    seconds = 86400 * BUCKET_DAYS
    at = F.unix_seconds(F.col("event_time").cast("timestamp"))
    home = F.floor(F.col("_s") / seconds)
    spread = rows.withColumn("_s", at).withColumn("_b", F.explode(F.sequence(home, F.floor((F.col("_s") + 3600 * reach_hours) / seconds))))
    return spread.withColumns(made).filter(F.col("_b") == home).drop("_s", "_b")


def past(earliest_hours: int, latest_hours: int):
    """The window of rows from earliest to latest hours before a row, both included; for ``looking_back``."""
    return Window.partitionBy("location_id", "_b").orderBy("_s").rangeBetween(-3600 * earliest_hours, -3600 * latest_hours)


def lag_features(series: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Value exactly n hours before each row; a hole gives null, never an earlier value.

    One range window for each lag, over one shared sort; no self-join.
    """
    return looking_back(series, _lags(lags), max(lags, default=0))


def _lags(lags: tuple[int, ...]) -> dict[str, Column]:
    return {f"lag_{n}h": F.max("value").over(past(n, n)) for n in lags}


def _means(spans: tuple[int, ...], least: int) -> dict[str, Column]:
    return {f"mean_{n}h": F.when(F.count("value").over(past(n - 1, 0)) >= least, F.avg("value").over(past(n - 1, 0))) for n in spans}


def rolling_features(series: DataFrame, spans: tuple[int, ...], least: int = 2) -> DataFrame:
    """Mean of the last n hours, the row's own included; null with fewer than least known values."""
    return looking_back(series, _means(spans, least), max(spans, default=1) - 1)


def calendar_features(series: DataFrame, offset_hours: float) -> DataFrame:
    return series.withColumns(C.calendar(C.local_time(F.col("event_time"), offset_hours)))


def covariate(series: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """other's value at the same instant (null where there is none); other has few rows: one for each hour."""
    return series.join(other.select("event_time", F.col("value").alias(name)), "event_time", "left")


def zone_codes(series: DataFrame) -> DataFrame:
    zones = series.select("location_id").distinct().withColumn("zone_code", F.dense_rank().over(Window.orderBy("location_id")) - 1)
    return series.join(zones, "location_id")


def feature_table(series: DataFrame, lags: tuple[int, ...] = (1, 24, 168), spans: tuple[int, ...] = (3, 24, 168), offset_hours: float = 5.5) -> DataFrame:
    """Features known an hour ahead of each target: values up to sample_time = target_time - 1 h only.

    Rows without a target value are the only ones left out.
    """
    before = tuple(n - 1 for n in lags if n > 1)
    known = looking_back(spine(series, 1), _lags(before) | _means(spans, 2), max((*before, *(n - 1 for n in spans)), default=0))
    renamed = known.withColumnRenamed("value", "lag_1h")
    for n in lags:
        if n > 1:
            renamed = renamed.withColumnRenamed(f"lag_{n - 1}h", f"at_{n}h")
    samples = renamed.withColumn("target_time", F.col("event_time") + hours(1)).withColumnRenamed("event_time", "sample_time")
    targets = series.filter("value is not null").select("location_id", F.col("event_time").alias("target_time"), F.col("value").alias("target"))
    return calendar_features(targets.join(samples, ["location_id", "target_time"]).withColumn("event_time", F.col("target_time")), offset_hours).drop("event_time")


def spine(series: DataFrame, horizon: int) -> DataFrame:
    """The series plus empty rows at every target's sample time, so that windows exist there."""
    wanted = series.select("location_id", (F.col("event_time") - hours(horizon)).alias("event_time"))
    missing = wanted.join(series.select("location_id", "event_time"), ["location_id", "event_time"], "left_anti").distinct()
    return series.select("location_id", "event_time", "value").unionByName(missing.withColumn("value", F.lit(None).cast("double")))


def temporal_split(rows: DataFrame, train: float = 0.6, validation: float = 0.2, gap_hours: int = 24) -> DataFrame:
    """rows with segment train, validation, test or null (inside a gap): boundaries on distinct times."""
    times = rows.select("event_time").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = times.withColumns({"k": F.row_number().over(Window.orderBy("event_time")) - 1, "n": n})
    edge = lambda share: F.max(F.when(F.col("k") == F.greatest(F.lit(0), F.floor(F.col("n") * share).cast("int") - 1), F.col("event_time")))
    bounds = ranked.agg(edge(train).alias("_a"), edge(train + validation).alias("_b"))
    gap, t = hours(gap_hours), F.col("event_time")
    segment = (
        F.when(t <= F.col("_a"), "train")
        .when((t > F.col("_a") + gap) & (t <= F.col("_b")), "validation")
        .when(t > F.col("_b") + gap, "test")
    )
    return rows.crossJoin(F.broadcast(bounds)).withColumn("segment", segment).drop("_a", "_b")  # bounds: one row


def probe_instants(series: DataFrame, warmup_hours: int, probes: int = 24) -> DataFrame:
    """(location_id, event_time) at evenly spaced distinct instants that have warmup_hours of history."""
    first = series.agg(F.min("event_time").alias("_first"))  # one row
    warm = series.select("event_time").distinct().crossJoin(F.broadcast(first)).filter(F.col("event_time") >= F.col("_first") + hours(warmup_hours))
    ranked = warm.select("event_time", (F.row_number().over(Window.orderBy("event_time")) - 1).alias("_k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / probes))
    chosen = ranked.filter((F.col("_k") % step == 0) & (F.col("_k") < step * probes)).select("event_time")  # at most probes rows
    return series.join(F.broadcast(chosen), "event_time").select("location_id", "event_time").distinct()


def leakage_probe(rows: DataFrame, features: callable, at: DataFrame, names: list[str], reach_hours: int = 24, ahead_hours: int | None = None) -> DataFrame:
    """Features at probe instants (location_id, event_time) that move when what is unknown there is perturbed.

    Unknown is every row after the instant (kind future_event); and, where rows have a received_time and receipts lie
    on both sides of the instant, every row received after it (kind late_arrival).  An empty result means that no
    feature looks ahead.

    One plan for all probes: every row is copied to the probes that may read it, from reach_hours before to
    ahead_hours after it (as far, unless given), once as it is and once for each kind of perturbation, and features is
    applied to all copies together, under location ids that name their probe.  So features must take location_id for
    an opaque key, and make location_id, event_time and the named columns from rows.  A feature that reads nothing
    within ahead_hours but only later rows is not found.
    """
    ahead = reach_hours if ahead_hours is None else ahead_hours
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    span = 3600 * max(reach_hours + ahead, 1)
    instants = at.select(F.col("event_time").alias("_t")).distinct().withColumn("_at", seconds("_t"))
    late = "received_time" in rows.columns
    if late:
        ends = rows.agg(F.min("received_time").alias("_lo"), F.max("received_time").alias("_hi"))  # one row
        instants = instants.crossJoin(F.broadcast(ends)).withColumn("_straddled", F.coalesce((F.col("_lo") <= F.col("_t")) & (F.col("_t") < F.col("_hi")), F.lit(False))).drop("_lo", "_hi")
    else:
        instants = instants.withColumn("_straddled", F.lit(False))
    # Probes and rows meet in stretches of time as long as a probe's own.
    slots = F.sequence(F.floor((F.col("_at") - 3600 * reach_hours) / span), F.floor((F.col("_at") + 3600 * ahead) / span))
    near = rows.withColumns({"_s": seconds("event_time")}).withColumn("_slot", F.floor(F.col("_s") / span)).join(instants.withColumn("_slot", F.explode(slots)), "_slot")
    near = near.filter(F.col("_s").between(F.col("_at") - 3600 * reach_hours, F.col("_at") + 3600 * ahead))
    kinds = {"as_is": F.lit(True), "future_event": F.lit(True)} | ({"late_arrival": F.col("_straddled")} if late else {})
    copies = near.withColumn("_kind", F.explode(F.array_compact(F.array(*[F.when(on, F.lit(k)) for k, on in kinds.items()]))))
    unknown = F.when(F.col("_kind") == "future_event", F.col("event_time") > F.col("_t"))
    unknown = unknown.when(F.col("_kind") == "late_arrival", F.col("received_time") > F.col("_t")) if late else unknown
    moved = copies.withColumns({
        "value": F.when(F.coalesce(unknown, F.lit(False)), F.col("value") * 10 + 1000).otherwise(F.col("value")),
        "location_id": F.concat(F.col("_kind"), F.lit("|"), F.col("_at").cast("string"), F.lit("|"), "location_id"),
    })
    made = features(moved.select(*rows.columns)).select(F.split("location_id", r"\|", 3).alias("_of"), "event_time", *names)
    made = made.filter(seconds("event_time") == F.get("_of", F.lit(1)).cast("long"))
    one = lambda k: F.max(F.when(F.get("_of", F.lit(0)) == k, F.struct(*names)))
    by = made.groupBy(F.get("_of", F.lit(2)).alias("location_id"), "event_time").agg(*[one(k).alias(k) for k in kinds])
    number = {n for n, kind in made.dtypes if kind in ("double", "float")}  # sums may differ in their last digits

    def differs(n: str, kind: str) -> Column:
        x, y = F.col(f"as_is.{n}"), F.col(f"{kind}.{n}")
        same = F.coalesce(F.abs(x - y) <= 1e-9 * F.greatest(F.abs(x), F.abs(y)), F.lit(False)) if n in number else F.lit(False)
        return F.col(kind).isNotNull() & ~x.eqNullSafe(y) & ~same

    told = [F.when(differs(n, k), F.struct(F.lit(n).alias("feature"), F.lit(k).alias("kind"))) for k in kinds if k != "as_is" for n in names]
    found = by.select("location_id", "event_time", F.explode(F.array_compact(F.array(*told))).alias("x")).select("location_id", "event_time", "x.*")
    return found.join(at.select("location_id", "event_time").distinct(), ["location_id", "event_time"], "left_semi")
