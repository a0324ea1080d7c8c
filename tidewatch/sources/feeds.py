"""Sources and sinks: text feeds, dimension tables, append-only logs."""

from __future__ import annotations

import difflib
import fnmatch
import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import folded

FEED = T.StructType([T.StructField(c, T.StringType()) for c in ("record_id", "source_id", "interval_end_local", "location_id", "metric", "value", "unit")])
#: Columns that would tell a feed's readers the planted truth.
_LABELS = ("*label*", "*truth*", "is_anomaly", "planted_*")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV feed as strings, nothing inferred; malformed rows keep nulls."""
    return spark.read.schema(FEED).option("header", True).option("mode", "PERMISSIVE").csv(path)


def stream_feed(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same feed as a stream, with received_time set when a row is taken in."""
    rows = spark.readStream.schema(FEED).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path)
    return rows.withColumn("received_time", F.current_timestamp())


def stream_limited(spark: SparkSession, path: str, limit: int, delay_seconds: float = 0.0) -> DataFrame:
    """Rows that a replay gives out before it stops: good rows only count, by file and place, each delay_seconds after the last.

    A replay of files that are there is a batch plan: (feed columns, offset_seconds).
    """
    rows = read_feed(spark, path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    first = rows.filter("length(trim(record_id)) > 0").orderBy("_at").limit(limit)
    return first.withColumn("offset_seconds", (F.row_number().over(Window.orderBy("_at")) - 1) * F.lit(float(delay_seconds))).drop("_at")  # limit rows


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone coordinates; zones with bad ones keep null coordinates."""
    rows = spark.read.option("header", True).csv(path)
    lat, lon = F.expr("try_cast(latitude as double)"), F.expr("try_cast(longitude as double)")
    good = lat.between(-90, 90) & lon.between(-180, 180)
    return rows.withColumns({"latitude": F.when(good, lat), "longitude": F.when(good, lon)})


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Names of places from YAML (zones: id, name, aliases): (token, location_id, kind), id before name before alias."""
    with open(path) as f:
        zones = yaml.safe_load(f)["zones"]
    rows = []
    for z in zones:
        rows.append((z["location_id"], z["location_id"], "canonical_id", 0))
        rows.append((z.get("name") or z["location_id"], z["location_id"], "name", 1))
        rows += [(a, z["location_id"], "alias", 2) for a in z.get("aliases") or []]
    table = spark.createDataFrame(rows, "name string, location_id string, kind string, rank int").withColumn("token", folded(F.col("name")))
    first = F.min_by(F.struct("location_id", "kind"), F.struct("rank", "location_id"))
    return table.groupBy("token").agg(first.alias("x")).select("token", "x.*")


def resolve_locations(rows: DataFrame, registry: DataFrame, column: str = "location_id") -> DataFrame:
    """rows with resolved_id and match_kind (unresolved where the registry has no such name)."""
    known = registry.select(F.col("token"), F.col("location_id").alias("resolved_id"), F.col("kind").alias("match_kind"))
    found = rows.withColumn("token", folded(F.col(column))).join(known, "token", "left").drop("token")
    return found.withColumn("match_kind", F.coalesce("match_kind", F.lit("unresolved")))


def suggest_locations(names: DataFrame, choices: DataFrame, least: float = 0.6, top: int = 3) -> DataFrame:
    """Up to top similar choices for each unresolved name: suggestions only, never applied.

    choices: (suggestion), the registry's names, a dimension table.  Pairs share a character and have lengths that
    can reach the score, which is 2 M / T for M matching of T characters in all; the ratio itself is that of
    difflib, on Arrow batches.
    """
    known = choices.select("suggestion", F.lower("suggestion").alias("_c")).distinct()
    asked = names.select("name", F.lower(F.coalesce("name", F.lit(""))).alias("_n")).distinct()
    letters = lambda c: F.explode(F.array_distinct(F.split(c, "")))
    reach = 2 * F.least(F.length("_n"), F.length("_c")) >= least * (F.length("_n") + F.length("_c"))
    pairs = asked.withColumn("_l", letters(F.col("_n"))).join(known.withColumn("_l", letters(F.col("_c"))), "_l").filter(reach).select("name", "suggestion", "_n", "_c").distinct()
    scored = pairs.withColumn("score", similarity(F.col("_n"), F.col("_c"))).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "suggestion"))
    return scored.withColumn("_k", rank).filter(F.col("_k") <= top).select("name", "suggestion", "score")


def _ratios(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(x, y, strict=True)], dtype="float64")


def similarity(x: Column, y: Column) -> Column:
    return F.pandas_udf(_ratios, "double")(x, y)


def append_log(rows: DataFrame, path: str, run_id: str) -> None:
    """Append JSON under a run of its own; a run that is written again replaces itself only."""
    rows.write.mode("overwrite").json(f"{path}/run={run_id}")


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, run_id: str | None = None) -> DataFrame:
    """All runs of a log, or one."""
    rows = spark.read.schema(schema).json(path if run_id is None else f"{path}/run={run_id}")
    return rows


def latest_run(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last run by name."""
    rows = spark.read.schema(schema + ", run string").json(path)
    last = rows.agg(F.max("run").alias("last"))
    return rows.join(F.broadcast(last), rows["run"] == last["last"]).drop("last")  # one row


def write_feed(rows: DataFrame, path: str) -> None:
    """A CSV feed for others: refuses label columns, and to overwrite."""
    bad = [c for c in rows.columns if any(fnmatch.fnmatch(c.lower(), p) for p in _LABELS)]
    if bad:
        raise ValueError(f"label columns may not leave: {bad}")
    rows.write.mode("errorifexists").option("header", True).csv(path)


def load_yaml(path: str) -> dict:
    """A configuration file, read by the driver."""
    with open(path) as f:
        return yaml.safe_load(f) or {}


def validated(config: dict, required: dict[str, type | tuple[type, ...]], optional: dict[str, type | tuple[type, ...]] | None = None) -> dict:
    """A configuration whose keys are known and of their kinds; anything else is an error that names the key."""
    known = required | (optional or {})
    unknown, absent = sorted(set(config) - set(known)), sorted(set(required) - set(config))
    wrong = sorted(k for k, v in config.items() if k in known and (not isinstance(v, known[k]) or isinstance(v, bool) and known[k] is not bool))
    if unknown or absent or wrong:
        raise ValueError(f"unknown {unknown}, absent {absent}, of another kind {wrong}")
    return config


def load_settings(folder: str, env: str | None = None, base: str = "base.yaml") -> dict:
    """base.yaml of a folder, with the environment's own file laid over it (mappings merge, other values replace)."""

    def over(x: dict, y: dict) -> dict:
        return x | {k: over(x[k], v) if isinstance(v, dict) and isinstance(x.get(k), dict) else v for k, v in y.items()}

    return over(load_yaml(f"{folder}/{base}"), load_yaml(f"{folder}/{env}.yaml") if env else {})


_METRIC = {"aliases": list, "accepted_units": list, "plausible_min": (int, float), "plausible_max": (int, float), "non_negative": bool, "default_aggregation": str, "description": str}


def metric_table(spark: SparkSession, problem: dict) -> DataFrame:
    """The metrics of a problem configuration (a list, each with its name), as ``normalise.resolve_metrics`` takes them."""
    rows = []
    for m in problem.get("metrics") or []:
        validated(m, {"name": str, "canonical_unit": str}, _METRIC)
        number = lambda k, m=m: float(m[k]) if m.get(k) is not None else None
        rows.append((m["name"], m.get("aliases") or [], m["canonical_unit"], m.get("accepted_units") or [], number("plausible_min"), number("plausible_max"), m.get("non_negative", False)))
    return spark.createDataFrame(rows, "metric string, aliases array<string>, canonical_unit string, accepted_units array<string>, minimum double, maximum double, non_negative boolean")


def severity_bands(problem: dict) -> list[tuple[str, float]]:
    """(name, least ratio) of each severity band; ratios rise from 0."""
    bands = [(b["name"], float(b["min_ratio"])) for b in problem["congestion"]["severity_bands"]]
    ratios = [x for _, x in bands]
    if not bands or ratios[0] != 0 or any(x >= y for x, y in zip(ratios, ratios[1:], strict=False)):
        raise ValueError(f"severity bands must rise from 0: {bands}")
    return bands


def promotion_settings(config: dict) -> tuple[dict, list[str]]:
    """(arguments of ``monitoring.PromotionRules``, names of the protected slices) of an adaptation configuration."""
    p = config["promotion"]
    names = {"min_evaluation_rows": "least_rows", "min_relative_mae_improvement": "least_gain", "max_slice_regression": "worst_regression", "min_slice_rows": "least_slice_rows"}
    validated(p, {}, {k: (int, float) for k in names} | {"protected_slices": list, "require_leakage_clean": bool, "require_longer_horizon": bool})
    return {to: p[k] for k, to in names.items() if k in p}, list(p.get("protected_slices") or [])


def factor_table(spark: SparkSession, features: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """(feature, factor) of every feature; one without a factor, or with several, is an error."""
    return spark.createDataFrame([(f, factor_of(f, groups)) for f in features], "feature string, factor string")


def factor_of(feature: str, groups: dict[str, list[str]]) -> str:
    """The one factor whose patterns match a feature; none or several is an error."""
    hits = [g for g, patterns in groups.items() if any(fnmatch.fnmatchcase(feature, p) for p in patterns)]
    if len(hits) != 1:
        raise ValueError(f"{feature}: {hits or 'no factor'}")
    return hits[0]


def page(rows: DataFrame, order: list[str], offset: int = 0, limit: int = 50, most: int = 500) -> tuple[DataFrame, int]:
    """A page of rows in a given order, and how many there are."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(limit, most)), rows.count()
