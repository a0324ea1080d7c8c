"""Row-level column functions of the sensor engine.  Missing stays null; nothing is imputed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units by dimension with their factor to the dimension's base, and accepted spellings.
UNITS = {
    "vehicles/hour": ("flow", 1.0), "vehicles/minute": ("flow", 60.0), "vehicles/5min": ("flow", 12.0), "vehicles/15min": ("flow", 4.0), "vehicles/30min": ("flow", 2.0), "vehicles/day": ("flow", 1.0 / 24.0),
    "km/hour": ("speed", 1.0), "m/s": ("speed", 3.6), "mph": ("speed", 1.609344),
    "ratio": ("ratio", 1.0), "percent": ("ratio", 0.01),
    "metre": ("length", 1.0), "kilometre": ("length", 1000.0), "foot": ("length", 0.3048),
    "mm": ("depth", 1.0), "cm": ("depth", 10.0), "inch": ("depth", 25.4),
}
UNIT_SPELLINGS = {
    "vehicles/h": "vehicles/hour", "veh/hour": "vehicles/hour", "veh/h": "vehicles/hour", "vph": "vehicles/hour", "vehicles per hour": "vehicles/hour", "vehicles/min": "vehicles/minute",
    "km/h": "km/hour", "kmph": "km/hour", "kph": "km/hour", "m/sec": "m/s", "metres/second": "m/s", "miles/hour": "mph",
    "%": "percent", "fraction": "ratio", "m": "metre", "meter": "metre", "meters": "metre", "metres": "metre", "km": "kilometre", "kilometer": "kilometre", "ft": "foot", "feet": "foot",
    "millimetre": "mm", "millimeter": "mm", "centimetre": "cm", "centimeter": "cm", "in": "inch", "inches": "inch",
}
# Severity bands by the least ratio of volume to threshold.
SEVERITY = (("low", 0.0), ("moderate", 1.0), ("high", 1.3), ("severe", 1.8))
# Interval minutes of each aggregation level.
LEVELS = {1: "minute", 15: "quarter_hour", 60: "hourly", 1440: "daily"}


def _lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def seconds(ts: Column) -> Column:
    """Whole seconds of a timestamp, whatever the session's time zone does to its type."""
    return F.unix_seconds(ts.cast("timestamp"))


def finite(value: Column) -> Column:
    """NaN becomes null: Spark would otherwise rank it above every number."""
    return F.when(~F.isnan(value), value)


def canonical_unit(unit: Column) -> Column:
    """The accepted spelling; an unknown unit comes back trimmed and in lower case."""
    name = F.lower(F.trim(unit))
    return F.coalesce(_lookup(name, UNIT_SPELLINGS), name)


def known_unit(unit: Column) -> Column:
    return dimension(unit).isNotNull()


def compatible(x: Column, y: Column) -> Column:
    """True if both units are known and measure the same dimension."""
    return F.coalesce(dimension(x) == dimension(y), F.lit(False))


def dimension(unit: Column) -> Column:
    return _lookup(canonical_unit(unit), {u: d for u, (d, _) in UNITS.items()})


def convert(value: Column, source: Column, target: Column) -> Column:
    """value in the target unit; null if either unit is unknown or they measure different things."""
    factors = {u: f for u, (_, f) in UNITS.items()}
    same = dimension(source) == dimension(target)
    return F.when(same, value * _lookup(canonical_unit(source), factors) / _lookup(canonical_unit(target), factors))


def range_check(value: Column, least: Column, most: Column, non_negative: Column) -> Column:
    """First broken rule of a value, or null: not_a_number, negative, below_minimum, above_maximum.  Null values pass."""
    return (
        F.when(F.isnan(value), "not_a_number")
        .when(non_negative & (value < 0), "negative")
        .when(value < least, "below_minimum")
        .when(value > most, "above_maximum")
    )


def values_agree(x: Column, y: Column, relative: float, absolute: float) -> Column:
    """Both missing agree, one missing does not; else within the absolute or relative tolerance."""
    bound = F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(x), F.abs(y)))
    return F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), False).otherwise(F.abs(x - y) <= bound)


def snap(ts: Column, minutes: int, offset_hours: float = 0.0) -> Column:
    """Nearest interval start in local wall time, halves to even; an interval of 0 changes nothing."""
    if minutes <= 0:
        return ts.cast("timestamp_ntz")
    step, shift = 60 * minutes, int(offset_hours * 3600)
    micros = F.unix_micros(ts.cast("timestamp")) / F.lit(1e6) + shift
    return F.timestamp_seconds(F.rint(micros / step) * step - shift).cast("timestamp_ntz")


def metric_name(name: Column) -> Column:
    """Key of a metric's name: trimmed, lower case, separators as spaces; runs of spaces stay."""
    return F.translate(F.lower(F.trim(name)), "-_", "  ")


def aggregation_level(minutes: Column) -> Column:
    return _lookup(minutes.cast("int"), LEVELS, F.lit("instant"))


def recency(event: Column, received: Column, current_hours: float = 2, recent_hours: float = 48, recent_by_second: bool = False) -> Column:
    """Band of the arrival lag, both bounds inclusive to the microsecond; ``recent_by_second`` drops the fraction of received at the second bound."""
    start, end = F.unix_micros(event.cast("timestamp")), F.unix_micros(received.cast("timestamp"))
    late = 1_000_000 * seconds(received) if recent_by_second else end
    current, recent = (end - start <= round(3_600_000_000 * current_hours)), (late - start <= round(3_600_000_000 * recent_hours))
    return F.when(event.isNull() | received.isNull(), None).when(current, "current").when(recent, "recent").otherwise("historical")


def local_time(ts: Column, offset_hours: float) -> Column:
    """Wall time at a fixed offset (no daylight saving)."""
    return F.timestamp_seconds(seconds(ts) + int(offset_hours * 3600)).cast("timestamp_ntz")


def calendar(ts: Column) -> dict[str, Column]:
    """Calendar features of a wall time; Monday is 0."""
    import math

    turn = 2 * math.pi
    hour, month = F.hour(ts), F.month(ts)
    return {
        "hour": hour, "weekday": F.weekday(ts), "is_weekend": F.weekday(ts) >= 5, "month": month,
        "hour_sin": F.sin(hour * (turn / 24)), "hour_cos": F.cos(hour * (turn / 24)),
        "month_sin": F.sin((month - 1) * (turn / 12)), "month_cos": F.cos((month - 1) * (turn / 12)),
    }


def ratio(value: Column, threshold: Column) -> Column:
    return F.try_divide(value, threshold)


def severity(ratio_: Column) -> Column:
    """Last band whose least ratio is reached; an unknown ratio is low."""
    out = F.lit(SEVERITY[0][0])
    for name, least in SEVERITY:
        out = F.when(ratio_ >= least, name).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    return _lookup(name, {n: i for i, (n, _) in enumerate(SEVERITY)})


def interval_confidence(predicted: Column, lower: Column, upper: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(upper - lower, predicted)))


def rain_band(mm: Column) -> Column:
    return F.when(mm.isNull(), "unknown").when(mm < 0.1, "dry").when(mm <= 10, "light").otherwise("heavy")


def time_of_day(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 17, "afternoon").otherwise("evening")


def confidence_from_p(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - p)))


def folded(name: Column) -> Column:
    """Name key: trimmed, lower case, separators as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(name, "-_", "  ")), r"\s+", " "))
