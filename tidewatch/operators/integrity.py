"""Integrity: parsing, normalisation, reconciliation, frozen runs, outliers, source health.

Nothing is dropped: every input row is valid or quarantined, and every valid row is unified,
duplicate-linked or conflicted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .statistics import counted_median

#: What two observations must share to be claims about one measurement; a null duration (an instant) is a value.
KEY = ("location_id", "event_time", "metric", "unit", "duration_minutes", "aggregation_level")
#: Which of a group represents it: the first received, then by id (its event time is part of the key).
_ORDER = ("received_time", "observation_id")


def parse_feed(rows: DataFrame, minutes: int, offset_hours: float, accepted_units: list[str] | None = None) -> DataFrame:
    """Typed columns and the first failed check (error: null if none) of an all-string feed.

    Checks in order: record_id, stamp, its offset, ids, unit, number.  Stamps are interval ends; event_time
    is the snapped start.
    """
    stamp = F.try_to_timestamp("interval_end_local")
    number = F.expr("try_cast(nullif(trim(value), '') as double)")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    error = (
        F.when(blank("record_id"), "schema_error")
        .when(stamp.isNull(), "invalid_timestamp")
        .when(~F.col("interval_end_local").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\s*$"), "invalid_timestamp")
        .when(blank("location_id") | blank("metric") | blank("unit"), "schema_error")
    )
    if accepted_units is not None:
        error = error.when(~F.col("unit").isin(accepted_units), "unknown_unit")
    error = error.when(number.isNull() & ~blank("value"), "invalid_value").when(F.isnan(number), "invalid_value")
    start = C.snap(stamp, minutes, offset_hours) - F.expr(f"make_dt_interval(0, 0, {int(minutes)}, 0)")
    return rows.withColumns({"error": error, "source_time": stamp, "event_time": start, "number": number})


def first_failure(checks: list[tuple[Column, str]]) -> Column:
    """Reason of the first check that holds, or null."""
    out = F.lit(None).cast("string")
    for bad, reason in reversed(checks):
        out = F.when(bad, reason).otherwise(out)
    return out


def split_quarantine(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined); a null reason is valid."""
    judged = rows.withColumn("quarantine_reason", reason)
    return judged.filter("quarantine_reason is null"), judged.filter("quarantine_reason is not null")


def key_groups(obs: DataFrame, relative: float = 0.05, absolute: float = 0.5) -> DataFrame:
    """One row for each observation key: size, sources, kind, spread, representative and whether values conflict.

    No pairs are formed: with a relative tolerance in [0, 1], a group has a dissenting pair exactly if nulls
    are mixed with values or its extremes disagree.
    """
    low, high, top = F.min("value"), F.max("value"), F.max(F.abs("value"))
    mixed = (F.count("value") > 0) & (F.count("value") < F.count(F.lit(1)))
    apart = high - low > F.greatest(F.lit(absolute), F.lit(relative) * top)
    groups = obs.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("members"),
        F.count_distinct("source_id").alias("sources"),
        F.when(F.count("value") >= 2, high - low).alias("spread"),
        F.coalesce(mixed | apart, F.lit(False)).alias("dissent"),
        F.min_by("observation_id", F.struct(*_ORDER)).alias("representative_id"),
    )
    placement = F.when(F.col("members") == 1, "unified").when(F.col("dissent"), "conflicted").otherwise("duplicate")
    kind = F.when(F.col("sources") == 1, "same_source_repeat").otherwise("cross_source_agreement")
    return groups.withColumn("placement", placement).withColumn("kind", F.when(placement == "duplicate", kind))


def place(obs: DataFrame, relative: float = 0.05, absolute: float = 0.5) -> DataFrame:
    """Every observation with its placement: unified, duplicate_linked or conflicted."""
    groups = key_groups(obs, relative, absolute).select(*KEY, F.col("placement").alias("group_placement"), "representative_id", "members")
    placement = F.when(F.col("group_placement") == "conflicted", "conflicted").when(F.col("observation_id") == F.col("representative_id"), "unified").otherwise("duplicate_linked")
    joined = obs.alias("o").join(groups.alias("g"), same_key("o", "g")).select("o.*", "g.group_placement", "g.representative_id", "g.members")
    return joined.withColumn("placement", placement)


def same_key(a: str, b: str) -> Column:
    """Null-safe equality of the observation keys of two aliased tables."""
    out = F.lit(True)
    for c in KEY:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def frozen_runs(obs: DataFrame, by: tuple[str, ...], value: Column, least: int = 6, ignored: tuple[float, ...] = (0.0,)) -> DataFrame:
    """Runs of one value over consecutive rows of a series; nulls and ignored values break runs."""
    order = Window.partitionBy(*by).orderBy("event_time", "observation_id")
    rows = obs.withColumn("_v", F.when(~value.isin(*ignored), value))
    rows = rows.withColumn("_new", F.when(F.col("_v").eqNullSafe(F.lag("_v").over(order)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.filter("_v is not null").groupBy(*by, "_run").agg(
        F.first("_v").alias("run_value"), F.min("event_time").alias("start"), F.max("event_time").alias("end"), F.count(F.lit(1)).alias("length")
    )
    return runs.filter(F.col("length") >= least).drop("_run")


def mad_outliers(obs: DataFrame, cell: tuple[str, ...], threshold: float = 6.0, least: int = 12) -> DataFrame:
    """Rows more than threshold scaled median deviations from their cell's median; small or constant cells flag none.

    Both medians come from the values' counts, by rank (``counted_median``); the rows meet the cells once.
    """
    cells = mad_cells(obs, cell, least)
    # Three numbers a cell; cells are few beside rows, but counted before they are broadcast.
    side = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    flagged = obs.filter("value is not null").join(side, list(cell)).withColumn("deviation", F.try_divide(F.abs(F.col("value") - F.col("group_median")), F.col("group_mad")))
    return flagged.filter(F.col("deviation") > threshold)


#: Cells that are broadcast, at most.
BROADCAST_CELLS = 200_000


def mad_cells(obs: DataFrame, cell: tuple[str, ...], least: int = 12) -> DataFrame:
    """(cell, group_median, group_size, group_mad) of the cells with at least least values that are not constant."""
    counts = obs.filter("value is not null").groupBy(*cell, "value").agg(F.count(F.lit(1)).alias("_n"))
    middle = counted_median(counts, list(cell), "value", "_n", "group_median").withColumnRenamed("rows", "group_size").filter(F.col("group_size") >= least)
    apart = counts.join(middle, list(cell)).select(*cell, "group_median", "group_size", F.abs(F.col("value") - F.col("group_median")).alias("_apart"), "_n")
    spread = counted_median(apart, [*cell, "group_median", "group_size"], "_apart", "_n", "_mad")
    return spread.select(*cell, "group_median", "group_size", (F.col("_mad") * 1.4826).alias("group_mad")).filter("group_mad > 0")


def source_health(obs: DataFrame, as_of: Column, warning_hours: float = 6, failed_hours: float = 24, warning_missing: float = 0.1) -> DataFrame:
    """Counts, longest gap between distinct times, trailing gap and status of each source."""
    times = obs.select("source_id", "event_time").distinct()
    gap = (C.seconds(F.col("event_time")) - C.seconds(F.lag("event_time").over(Window.partitionBy("source_id").orderBy("event_time")))) / 3600
    gaps = times.withColumn("gap", gap).groupBy("source_id").agg(F.max("gap").alias("max_gap_hours"))
    counts = obs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("value").isNull()).alias("missing"), F.max("event_time").alias("last_time"), F.count_distinct("location_id").alias("locations")
    )
    trailing = (C.seconds(as_of) - C.seconds(F.col("last_time"))) / 3600
    status = (
        F.when(trailing > failed_hours, "failed")
        .when((trailing > warning_hours) | (F.col("max_gap_hours") > failed_hours) | (F.col("missing") / F.col("observations") > warning_missing), "warning")
        .otherwise("ok")
    )
    return counts.join(gaps, "source_id").withColumn("trailing_gap_hours", trailing).withColumn("status", status)


def check_invariants(obs: DataFrame) -> DataFrame:
    """A boolean column for each row invariant; null inputs break none."""
    tests = {
        "received_after_event": F.col("received_time") >= F.col("event_time"),
        "ids_present": (F.length("observation_id") > 0) & (F.length("source_id") > 0) & (F.length("location_id") > 0),
        "value_is_number": F.col("value").isNull() | ~F.isnan("value"),
    }
    return obs.select("observation_id", *[F.coalesce(t, F.lit(True)).alias(n) for n, t in tests.items()])


def by_identifier(obs: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(identifier, observation_id): identifiers that name an observation, or else a feed record (OBS-<record>)."""
    ids = obs.select("observation_id")
    named = identifiers.join(ids, F.col("identifier") == F.col("observation_id"))
    rest = identifiers.join(named.select("identifier"), "identifier", "left_anti")
    return named.unionByName(rest.join(ids, F.concat(F.lit("OBS-"), "identifier") == F.col("observation_id")))


def provenance(obs: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Placement, representative and peers of the observations named in identifiers (observation_id)."""
    placed = place(obs)
    wanted = placed.join(identifiers, "observation_id", "left_semi")
    peers = placed.select(*KEY, F.col("observation_id").alias("peer"))
    found = wanted.alias("w").join(peers.alias("p"), same_key("w", "p")).filter("p.peer <> w.observation_id")
    peers_of = found.select("w.observation_id", "p.peer").groupBy("observation_id").agg(F.array_join(F.sort_array(F.collect_list("peer")), ",").alias("peers"))
    return wanted.select("observation_id", "placement", "representative_id", "members").join(peers_of, "observation_id", "left")


def frozen_members(obs: DataFrame, by: tuple[str, ...], value: Column, least: int = 6, ignored: tuple[float, ...] = (0.0,)) -> tuple[DataFrame, DataFrame]:
    """(rows outside frozen runs, rows inside, with run_length): the run's length rides on its rows, so nothing is joined."""
    order = Window.partitionBy(*by).orderBy("event_time", "observation_id")
    rows = obs.withColumn("_v", F.when(~value.isin(*ignored), value))
    rows = rows.withColumn("_new", F.when(F.col("_v").eqNullSafe(F.lag("_v").over(order)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("run_length", F.when(F.col("_v").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(*by, "_run"))).otherwise(0))
    inside = F.col("run_length") >= least
    return rows.filter(~inside).drop("_v", "_new", "_run", "run_length"), rows.filter(inside).drop("_v", "_new", "_run")


def assessed_sources(obs: DataFrame, frozen: DataFrame, as_of: Column, expected_hours: float | None = None, warning_hours: float = 6, failed_hours: float = 24, warning_missing: float = 0.1) -> DataFrame:
    """Health of each source with its frozen runs (source_id, length) and the reasons for its status.

    Frozen runs or a silence beyond failed_hours fail a source; a longer gap inside the series, or a silence or gap
    beyond warning_hours, or too many missing values warn.  Gaps up to expected_hours are none.
    """
    base = source_health(obs, as_of, warning_hours, failed_hours, warning_missing).drop("status")
    runs = frozen.groupBy("source_id").agg(F.count(F.lit(1)).alias("frozen_runs"), F.sum("length").alias("frozen_observations"))
    rows = base.join(runs, "source_id", "left").na.fill(0, ["frozen_runs", "frozen_observations"])
    gap = F.col("max_gap_hours") if expected_hours is None else F.when(F.col("max_gap_hours") > expected_hours, F.col("max_gap_hours"))
    silent = F.col("trailing_gap_hours")
    rate = F.try_divide("missing", "observations")
    reasons = {
        "frozen": F.col("frozen_runs") > 0,
        "silent": silent > failed_hours,
        "long_gap": (silent <= failed_hours) & (gap > failed_hours),
        "late": (silent <= failed_hours) & ~F.coalesce(gap > failed_hours, F.lit(False)) & (silent > warning_hours),
        "gap": (silent <= warning_hours) & (gap <= failed_hours) & (gap > warning_hours),
        "missing": rate > warning_missing,
    }
    told = F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in reasons.items()]))
    status = F.when(F.arrays_overlap("reasons", F.array(F.lit("frozen"), F.lit("silent"))), "failed").when(F.size("reasons") > 0, "warning").otherwise("ok")
    return rows.withColumns({"max_gap_hours": gap, "reasons": told}).withColumn("status", status)


#: Statuses whose rows may break the rules on time.
_EXEMPT = ("quarantined", "suspect", "rejected")


def row_invariants(rows: DataFrame, now: Column, minutes_ahead: int = 5) -> DataFrame:
    """A boolean for each rule on whole observation rows; rules on columns that rows do not have are left out.

    Columns: observation_id, event_time, received_time, status, period_start, period_end, is_imputed, imputation_method,
    original_value, original_unit, source_type, document_name, is_inferred, quarantine_reason, links.
    """
    exempt = F.coalesce(F.col("status").isin(*_EXEMPT), F.lit(False)) if "status" in rows.columns else F.lit(False)
    col = F.col
    rules = {
        "received_after_event": (("event_time", "received_time"), lambda: exempt | (col("received_time") >= col("event_time"))),
        "not_in_the_future": (("event_time",), lambda: exempt | (C.seconds(col("event_time")) <= C.seconds(now) + 60 * minutes_ahead)),
        "period_ordered": (("period_start", "period_end"), lambda: col("period_end") >= col("period_start")),
        "imputation_declared": (("is_imputed", "imputation_method"), lambda: F.coalesce(col("is_imputed"), F.lit(False)) == col("imputation_method").isNotNull()),
        "original_paired": (("original_value", "original_unit"), lambda: col("original_value").isNull() | col("original_unit").isNotNull()),
        "document_has_source": (("source_type", "document_name"), lambda: (col("source_type") == "document") == col("document_name").isNotNull()),
        "inferred_not_born_valid": (("is_inferred", "status"), lambda: ~(F.coalesce(col("is_inferred"), F.lit(False)) & (col("status") == "valid"))),
        "quarantine_has_reason": (("status", "quarantine_reason"), lambda: (col("status") != "quarantined") | (F.length("quarantine_reason") > 0)),
        "no_self_link": (("links", "observation_id"), lambda: ~F.array_contains("links", col("observation_id"))),
    }
    made = [F.coalesce(rule(), F.lit(True)).alias(name) for name, (needs, rule) in rules.items() if set(needs) <= set(rows.columns)]
    return rows.select("observation_id", *made)


def views(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows (status, source_type, recency) as the views that are read most: suspicious, clean, historical, real_time, document."""
    return {
        "suspicious": rows.filter("status = 'suspect'"),
        "clean": rows.filter("status = 'valid'"),
        "historical": rows.filter("source_type = 'historical'"),
        "real_time": rows.filter("source_type = 'real_time'"),
        "document": rows.filter("source_type = 'document'"),
    }
