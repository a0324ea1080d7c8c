"""From parsed feed rows to canonical observations: names, units, ranges, and what is kept of a rejected row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

VERSION = "tidewatch-1"


def canonical_rows(parsed: DataFrame, source_type: str, minutes: int, received: Column) -> DataFrame:
    """Parsed feed rows (``integrity.parse_feed``, without errors) as pending observations, the source's row kept beside."""
    raw = F.create_map(*[x for c in ("record_id", "source_id", "interval_end_local", "location_id", "metric", "value", "unit") for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))])
    duration = F.lit(minutes if minutes > 0 else None).cast("int")
    return parsed.select(
        F.concat(F.lit("OBS-"), F.col("record_id")).alias("observation_id"),
        "source_id",
        F.lit(source_type).alias("source_type"),
        "location_id",
        "metric",
        F.col("number").alias("value"),
        "unit",
        duration.alias("duration_minutes"),
        C.aggregation_level(duration).alias("aggregation_level"),
        "event_time",
        "source_time",
        received.alias("received_time"),
        F.lit("pending").alias("status"),
        F.struct(F.col("source_id").alias("origin"), F.lit(VERSION).alias("version"), F.concat(F.lit("interval_end_local="), "interval_end_local").alias("notes")).alias("provenance"),
        F.map_concat(raw, F.create_map(F.lit("source_metric"), F.col("metric"))).alias("attributes"),
    )


def quarantine_rows(rejected: DataFrame, reason: Column, detail: Column, detector: str, record: str = "record_id") -> DataFrame:
    """What is kept of rejected rows: an id, the reason, and the row as it came (JSON)."""
    return rejected.select(
        F.concat_ws("-", F.lit("QTN"), reason, F.coalesce(F.col(record), F.lit("row"))).alias("quarantine_id"),
        reason.alias("reason"),
        detail.alias("detail"),
        "source_id",
        F.to_json(F.struct(*rejected.columns)).alias("raw_payload"),
        F.lit(detector).alias("detector"),
    )


def resolve_metrics(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """rows with the configured metric, unit and bounds beside them (null where the name is not configured).

    metrics: (metric, aliases array, canonical_unit, accepted_units array, minimum, maximum, non_negative); a
    small configuration table.  Names and aliases are compared folded; a canonical name wins over an alias.
    """
    names = metrics.select("*", F.posexplode(F.concat(F.array("metric"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_rank", "_name"))
    first = Window.partitionBy("_key").orderBy((F.col("_rank") > 0).cast("int"), "metric")
    table = names.withColumn("_key", C.metric_name(F.col("_name"))).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    table = table.select("_key", F.col("metric").alias("canonical_metric"), "canonical_unit", "accepted_units", "minimum", "maximum", "non_negative")
    return rows.withColumn("_key", C.metric_name(F.col("metric"))).join(table, "_key", "left").drop("_key")


def normalised(rows: DataFrame, current_hours: int = 2, recent_hours: int = 48) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of rows beside their metrics (``resolve_metrics``).

    A metric that is not configured passes with its own unit, unchecked.  Otherwise the first failure counts:
    a unit that cannot be converted or is not accepted (unknown_unit), then the range of the converted value
    (invalid_value).  Valid rows keep the value and unit they came with where those changed.
    """
    known = F.col("canonical_metric").isNotNull()
    unit = C.canonical_unit(F.col("unit"))
    value = C.convert(F.col("value"), F.col("unit"), F.col("canonical_unit"))
    accepted = F.size("accepted_units") > 0
    named = F.exists("accepted_units", lambda u: F.lower(F.trim(u)) == F.lower(F.trim("unit")))
    bad_unit = ~C.compatible(F.col("unit"), F.col("canonical_unit")) | F.coalesce(accepted & ~named, F.lit(False))
    broken = C.range_check(value, F.col("minimum"), F.col("maximum"), F.coalesce("non_negative", F.lit(False)))
    reason = F.when(known & bad_unit, "unknown_unit").when(known & broken.isNotNull(), "invalid_value")
    detail = F.when(known & bad_unit, F.concat_ws(" ", "unit", F.lit("for"), "canonical_unit")).otherwise(broken)
    judged = rows.withColumns({"reason": reason, "detail": detail})
    changed = known & ~unit.eqNullSafe(F.col("canonical_unit"))
    lag = C.seconds(F.col("received_time")) - C.seconds(F.col("event_time"))
    valid = judged.filter("reason is null").withColumns(
        {
            "original_value": F.when(changed, F.col("value")),
            "original_unit": F.when(changed, F.col("unit")),
            "value": F.when(known, value).otherwise(F.col("value")),
            "unit": F.when(known, F.col("canonical_unit")).otherwise(F.col("unit")),
            "metric": F.coalesce("canonical_metric", "metric"),
            "status": F.lit("valid"),
            "recency": C.recency(F.col("event_time"), F.col("received_time"), current_hours, recent_hours),
            "arrival_lag_seconds": lag,
            "metric_known": known,
        }
    )
    return valid.drop("reason", "detail", "canonical_metric", "canonical_unit", "accepted_units", "minimum", "maximum", "non_negative"), judged.filter("reason is not null")


def origin(source: Column, document: Column, page: Column, section: Column, kind: Column, confidence: Column) -> Column:
    """Where a value came from: its feed, or document, page, section and how it was read there."""
    where = F.concat(document, F.coalesce(F.concat(F.lit(" page "), page.cast("string")), F.lit("")), F.when(F.length(section) > 0, F.concat(F.lit(" section "), section)).otherwise(""))
    how = F.concat(F.lit(" ("), kind, F.lit(", confidence "), F.bround(confidence * 100).cast("int").cast("string"), F.lit("%)"))
    return F.when(document.isNotNull(), F.concat(where, how)).otherwise(source)


def union_first(first: DataFrame, second: DataFrame, key: str = "observation_id") -> DataFrame:
    """Rows of both by key, each once; those of first win, and within one table the least row."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    rest = [c for c in first.columns if c != key]
    least = both.groupBy(key).agg(F.min(F.struct("_from", *rest)).alias("_x"))
    return least.select(key, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(*first.columns)


def disjoint(*tables: DataFrame, key: str = "observation_id") -> DataFrame:
    """One row (disjoint, shared): whether no key is in two of the tables."""
    parts = [t.select(key).distinct() for t in tables]
    both = parts[0]
    for t in parts[1:]:
        both = both.unionByName(t)
    return both.groupBy(key).count().agg(F.coalesce(F.max("count") <= 1, F.lit(True)).alias("disjoint"), F.count_if(F.col("count") > 1).alias("shared"))


def counts_by(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows by the values of a closed vocabulary, zeros included."""
    names = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), column, "left").select(column, F.coalesce("_n", F.lit(0)).alias("rows"))
