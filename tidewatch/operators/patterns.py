"""Pattern discovery: cells, hotspots, profiles, level shifts, interactions, evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.special import t_upper_quantile
from . import statistics as S



def cell_tests(rows: DataFrame, least: int = 12) -> DataFrame:
    """Each (zone, weekday, hour) against the zone's same hour on other weekdays, with lift over the peers' median.

    Treatment and control of all seven weekdays are one set, so a row is sent to each cell's test once.
    """
    cells = rows.select("location_id", "hour").distinct().join(rows.select("location_id", "hour", "weekday").distinct().withColumnRenamed("weekday", "cell_weekday"), ["location_id", "hour"])
    spread = rows.join(cells, ["location_id", "hour"]).withColumn("treated", F.col("weekday") == F.col("cell_weekday"))
    tests = S.mann_whitney(spread, ["location_id", "hour", "cell_weekday"], "treated", least=least)
    tests = tests.withColumnRenamed("cell_weekday", "weekday_tested")
    peer = F.median("effect").over(Window.partitionBy("hour", "weekday_tested"))
    return tests.withColumn("peer_lift", peer).withColumn("localized_lift", F.try_divide("effect", "peer_lift"))


def discovered(tests: DataFrame, level: float = 0.05, lift: float = 1.25) -> DataFrame:
    """Tests that pass the false-discovery gate and the least localized lift."""
    judged = S.benjamini_hochberg(tests.withColumn("p_value", S.two_sided(F.col("z"))), "p_value", level)
    return judged.filter("rejected").filter(F.col("localized_lift") >= lift)


def merge_hours(found: DataFrame) -> DataFrame:
    """Runs of adjacent hours of a zone and weekday (no wrap at midnight), with the interval (lower, upper), if there, of the strongest."""
    island = F.col("hour") - F.row_number().over(Window.partitionBy("location_id", "weekday_tested").orderBy("hour"))
    ends = [F.max_by(c, F.struct("localized_lift", "hour")).alias(c) for c in ("lower", "upper") if c in found.columns]
    return found.withColumn("_i", island).groupBy("location_id", "weekday_tested", "_i").agg(F.sort_array(F.collect_set("hour")).alias("hours"), F.max("localized_lift").alias("lift"), *ends).drop("_i")


def cell_intervals(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found cells with a bootstrap interval (lower, upper) of their ratio to the zone's same hour on other weekdays: a second stage, for survivors only."""
    near = rows.join(found.select("location_id", "hour", "weekday_tested"), ["location_id", "hour"]).withColumn("treated", F.col("weekday") == F.col("weekday_tested"))
    keys = ["location_id", "hour", "weekday_tested"]
    return found.join(S.bootstrap_median_ratio(near, keys, "treated"), keys, "left")


def discovered_interactions(rows: DataFrame, patterns: DataFrame, wet: str = "wet", least: int = 8) -> DataFrame:
    """Each discovered cell pattern (pattern_id, location_id, weekday, hours) against rain: hours fixed, weekday and rain as the two conditions.

    Returns the tests of ``interaction_verdict``, those without evidence included: what was tested is not what was found.
    """
    cells = patterns.filter("weekday is not null and hours is not null").select("pattern_id", "location_id", F.col("weekday").alias("_weekday"), F.explode("hours").alias("hour"))
    near = rows.join(cells, ["location_id", "hour"])
    return interaction_verdict(interaction(near, ["pattern_id"], F.col("weekday") == F.col("_weekday"), F.coalesce(F.col(wet) > 0, F.lit(False)), least))


def hotspots(rows: DataFrame, least_ratio: float = 1.3) -> DataFrame:
    """Zones whose median is least_ratio times the median of all other zones together.

    Values are counted by zone first.  The others' median of a zone is that of all values, less its own: the two
    middle ranks of what is left are looked up in the running totals of all zones and of the zone itself.
    """
    counts = rows.filter(F.col("value").isNotNull()).groupBy("location_id", "value").agg(F.count(F.lit(1)).alias("_n"))
    own = counts.groupBy("location_id").agg(F.percentile("value", F.lit(0.5), F.col("_n")).alias("zone_median"), F.sum("_n").alias("_own"))
    all_ = counts.groupBy("value").agg(F.sum("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("location_id", "_n"))).alias("_by"))  # as many entries as zones
    ranked, _ = S.running_totals(all_.withColumn("_all", F.lit(1)), ["_all"], "value", ["_n"])
    total = rows.filter(F.col("value").isNotNull()).agg(F.count(F.lit(1)).alias("_total"))
    zones = own.crossJoin(F.broadcast(total)).withColumn("_rest", F.col("_total") - F.col("_own"))
    # A zone's own running total at every value that it has; between them it stays.
    mine, _ = S.running_totals(counts, ["location_id"], "value", ["_n"])
    mine = mine.select("location_id", "value", F.col("upto__n").alias("_mine"))
    low, high = F.floor((F.col("_rest") + 1) / 2), F.floor((F.col("_rest") + 2) / 2)
    every = ranked.select("value", F.col("upto__n").alias("_upto"), "_by")
    # The rank of a value among the others is its rank among all, less the zone's values up to it; the search is
    # over values near the middle only: the others' median lies between the ranks low and high + own of all.
    near = every.join(F.broadcast(zones), (F.col("_upto") >= low) & (F.col("_upto") - F.aggregate(F.map_values("_by"), F.lit(0).cast("long"), lambda x, y: x + y) < high + F.col("_own")))
    upto = Window.partitionBy("location_id").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = near.groupBy("location_id").agg(F.min("value").alias("_first"))
    base = mine.join(F.broadcast(before), "location_id").filter(F.col("value") < F.col("_first")).groupBy("location_id").agg(F.max("_mine").alias("_base"))
    held = near.join(base, "location_id", "left").withColumn("_held", F.coalesce("_base", F.lit(0)) + F.sum(F.coalesce(F.element_at("_by", F.col("location_id")), F.lit(0))).over(upto))
    held = held.withColumn("_k", F.col("_upto") - F.col("_held"))
    pick = lambda rank: F.min(F.when(F.col("_k") >= rank, F.col("value")))
    other = held.groupBy("location_id").agg(((pick(low) + pick(high)) / 2).alias("other_median"))
    g = zones.select("location_id", "zone_median").join(other, "location_id", "left")
    ratio = F.try_divide("zone_median", "other_median")
    return g.withColumn("ratio", ratio).withColumn("hotspot", F.coalesce(ratio >= least_ratio, F.lit(False)))


def profiles(rows: DataFrame, bucket: str, least: int = 12) -> DataFrame:
    """Peak and trough of each zone's medians by bucket."""
    med = rows.filter("value is not null").groupBy("location_id", bucket).agg(F.median("value").alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    g = med.groupBy("location_id").agg(F.count(F.lit(1)).alias("buckets"), F.max_by(bucket, F.struct("m", bucket)).alias("peak"), F.max("m").alias("peak_median"), F.min_by(bucket, F.struct("m", bucket)).alias("trough"), F.min("m").alias("trough_median"))
    return g.filter((F.col("buckets") >= 2) & (F.col("trough_median") > 0)).withColumn("ratio", F.col("peak_median") / F.col("trough_median"))


def profile_patterns(rows: DataFrame, bucket: str, least: int = 12, range_: float = 1.5) -> DataFrame:
    """Profiles with a peak of at least range_ times the trough, with the rank test that the buckets differ at all."""
    found = profiles(rows, bucket, least).filter(F.col("ratio") >= range_)
    sizes = rows.filter("value is not null").groupBy("location_id", bucket).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    tested = S.kruskal_test(S.kruskal_wallis(rows.join(sizes.select("location_id", bucket), ["location_id", bucket]), ["location_id"], bucket, "value"))
    return found.join(tested.select("location_id", "h", "degrees", "p_value"), "location_id").withColumn("confidence", C.confidence_from_p(F.col("p_value")))


def shift_medians(rows: DataFrame, months: list[str] | None = None, side: int = 2) -> DataFrame:
    """(location_id, change_point, before_median, after_median, n_before, n_after) of every change point.

    Change points are the months of rows (or those given), less side at the start and side - 1 at the end.  Values
    are counted by zone and month, and the counts summed into a histogram over buckets of the value: one array of
    months for each zone and bucket.  Prefix sums over months give the counts before and after every change point at
    once, sums over buckets the one bucket that a median's rank falls into, and only the rows of that bucket are put
    in order.  Nothing is multiplied by the number of change points but buckets.
    """
    counts = rows.filter(F.col("value").isNotNull()).groupBy("location_id", "month", "value").agg(F.count(F.lit(1)).alias("_n"))
    placed = counts.withColumn("_bucket", S._bucket(F.col("value"), S.bucket_edges(counts, "value")))
    if months is None:
        known = rows.agg(F.sort_array(F.collect_set("month")).alias("_m"))  # one row of all months
    else:
        known = rows.sparkSession.range(1).select(F.array(*map(F.lit, months)).alias("_m"))
    hist = placed.groupBy("location_id", "_bucket", "month").agg(F.sum("_n").alias("_n")).groupBy("location_id", "_bucket").agg(F.map_from_entries(F.collect_list(F.struct("month", "_n"))).alias("_by"))
    hist = hist.crossJoin(F.broadcast(known))
    upto = F.transform("_m", lambda m: F.coalesce(F.element_at("_by", m), F.lit(0)))
    sums = F.aggregate(upto, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    points = F.sequence(F.lit(side + 1), F.size("_m") - side + 1)
    cells = hist.filter(F.size("_m") >= 2 * side).withColumn("_sums", sums).withColumn("_k", F.explode(points))
    cells = cells.select("location_id", "_bucket", F.element_at("_m", F.col("_k")).alias("change_point"), F.element_at("_sums", F.col("_k")).alias("_b"), (F.element_at("_sums", -1) - F.element_at("_sums", F.col("_k"))).alias("_a"))
    both = F.explode(F.array(F.struct(F.lit(False).alias("late"), F.col("_b").alias("n")), F.struct(F.lit(True).alias("late"), F.col("_a").alias("n"))))
    cells = cells.select("location_id", "change_point", "_bucket", both.alias("x")).select("location_id", "change_point", "_bucket", "x.*")
    one = Window.partitionBy("location_id", "change_point", "late")  # a row for each bucket, at most MOST_BUCKETS
    cells = cells.withColumns({"_total": F.sum("n").over(one), "_below": F.sum("n").over(one.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")})
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2))))
    wanted = cells.filter("_total > 0").withColumn("_rank", ranks).filter((F.col("_rank") > F.col("_below")) & (F.col("_rank") <= F.col("_below") + F.col("n"))).withColumn("_rank", F.col("_rank") - F.col("_below"))
    mine = F.col("late") == (F.col("month") >= F.col("change_point"))
    met = placed.join(wanted.select("location_id", "_bucket", "change_point", "late", "_rank", "_total"), ["location_id", "_bucket"]).filter(mine)
    inside = Window.partitionBy("location_id", "change_point", "late", "_bucket", "_rank").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the rows of one bucket
    met = met.withColumn("_upto", F.sum("_n").over(inside)).filter(F.col("_upto") >= F.col("_rank"))
    found = met.groupBy("location_id", "change_point", "late", "_bucket", "_rank").agg(F.min("value").alias("v"), F.max("_total").alias("t"))
    half = lambda late, c: F.when(F.col("late") == late, F.col(c))
    return found.groupBy("location_id", "change_point").agg(
        F.avg(half(False, "v")).alias("before_median"), F.avg(half(True, "v")).alias("after_median"), F.coalesce(F.max(half(False, "t")), F.lit(0)).alias("n_before"), F.coalesce(F.max(half(True, "t")), F.lit(0)).alias("n_after")
    )


def level_shifts(rows: DataFrame, months: list[str] | None = None, side: int = 2) -> DataFrame:
    """For each zone the month whose before/after ratio of medians, over the zones' lower quartile, is furthest from 1.

    A change point counts if two zones at least have a ratio there.
    """
    g = shift_medians(rows, months, side).withColumn("raw_ratio", F.try_divide("after_median", "before_median")).filter("raw_ratio is not null")
    zones = Window.partitionBy("change_point")  # as many rows as zones
    g = g.withColumns({"peer_ratio": F.percentile("raw_ratio", F.lit(0.25)).over(zones), "_zones": F.count(F.lit(1)).over(zones)}).filter("_zones >= 2 and peer_ratio <> 0")
    g = g.withColumn("adjusted_ratio", F.col("raw_ratio") / F.col("peer_ratio"))
    best = Window.partitionBy("location_id").orderBy(F.desc(F.abs(F.col("adjusted_ratio") - 1)), "change_point")
    return g.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k", "_zones", "after_median", "before_median")


def discovered_shifts(rows: DataFrame, least: float = 0.08, least_rows: int = 12) -> DataFrame:
    """Level shifts of at least least beyond the zones' own, whose bootstrap interval of the raw ratio leaves out 1.

    lower and upper are that interval over the peer ratio, beside the adjusted ratio that they belong to; p_value is
    the rank test's of the two sides.
    """
    large = level_shifts(rows).filter((F.abs(F.col("adjusted_ratio") - 1) >= least) & (F.least("n_before", "n_after") >= least_rows))
    sides = rows.join(large.select("location_id", "change_point"), "location_id").withColumn("treated", F.col("month") >= F.col("change_point"))
    tested = S.mann_whitney(sides, ["location_id"], "treated", least=least_rows).select("location_id", S.two_sided(F.col("z")).alias("p_value"))
    sure = large.join(S.bootstrap_median_ratio(sides, ["location_id"], "treated", draws=500), "location_id").filter("lower > 1 or upper < 1")
    adjusted = {c: F.try_divide(c, "peer_ratio") for c in ("lower", "upper")}
    return sure.withColumns(adjusted).join(tested, "location_id")


def interaction(rows: DataFrame, by: list[str], first: Column, second: Column, least: int = 8) -> DataFrame:
    """Two conditions on the log scale: the saturated model's interaction from four cells' counts, means and variances."""
    known = rows.filter(F.col("value") > 0).withColumns({"_a": first.cast("int"), "_b": second.cast("int"), "_y": F.log("value")})
    aggs = []
    for a in (0, 1):
        for b in (0, 1):
            y = F.when((F.col("_a") == a) & (F.col("_b") == b), F.col("_y"))
            aggs += [F.count(y).alias(f"n{a}{b}"), F.avg(y).alias(f"_m{a}{b}"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias(f"_v{a}{b}")]
    g = known.groupBy(*by).agg(*aggs)
    effect = F.col("_m11") - F.col("_m10") - F.col("_m01") + F.col("_m00")
    cells = ("00", "01", "10", "11")
    n = sum((F.col(f"n{c}") for c in cells), F.lit(0))
    rss = sum(((F.col(f"n{c}") - 1) * F.col(f"_v{c}") for c in cells), F.lit(0.0))
    error = F.sqrt(F.try_divide(rss, n - 4) * sum((F.try_divide(F.lit(1.0), F.col(f"n{c}")) for c in cells), F.lit(0.0)))
    enough = F.least(*[F.col(f"n{c}") for c in cells]) >= least
    return g.withColumns({"effect": effect, "stderr": F.when(enough, error), "testable": enough}).drop(*[f"_{k}{c}" for k in "mv" for c in cells])


def interaction_verdict(tests: DataFrame, level: float = 0.95) -> DataFrame:
    """``interaction`` results with a t interval: supported (above 0), contradicted (below), no_evidence, or untestable."""
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    width = t_upper_quantile(F.lit((1 + level) / 2), (n - 4).cast("double")) * F.col("stderr")
    out = tests.withColumns({"lower": F.col("effect") - width, "upper": F.col("effect") + width})
    verdict = F.when(~F.col("testable") | F.col("lower").isNull(), "untestable").when(F.col("lower") > 0, "supported").when(F.col("upper") < 0, "contradicted").otherwise("no_evidence")
    return out.withColumn("verdict", verdict)


def conditional_response(rows: DataFrame, wet: str, least_dry: int = 4) -> DataFrame:
    """Relative change of wet readings over their (zone, weekday, hour) dry median."""
    cell = ["location_id", "weekday", "hour"]
    dry = rows.filter(F.col(wet) <= 0).groupBy(*cell).agg(F.median("value").alias("base"), F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= least_dry) & (F.col("base") != 0)).drop("_n")
    return rows.filter(F.col(wet) > 0).join(dry, cell).withColumn("response", F.col("value") / F.col("base") - 1)


def rain_effects(rows: DataFrame, wet: str, light: float = 10.0, least: int = 30, smallest: float = 0.005) -> DataFrame:
    """Slope of the response to rain in each zone, over light rain and over all; kept if its interval leaves out 0 and it is large enough."""
    response = conditional_response(rows, wet)
    parts = [S.slope(part, ["location_id"], wet, "response", least).withColumn("range", F.lit(name)) for name, part in (("light", response.filter(F.col(wet) <= light)), ("all", response))]
    tested = S.slope_test(parts[0].unionByName(parts[1]))
    return tested.withColumn("kept", ((F.col("lower") > 0) | (F.col("upper") < 0)) & (F.abs("slope") >= smallest))


def cell_strengths(rows: DataFrame, found: DataFrame, least: int = 8) -> DataFrame:
    """(pattern_id, window, strength): a cell's median over that of the same hours on other weekdays, in each month.

    found: (pattern_id, location_id, weekday, hours).  rows: location_id, month, weekday, hour, value.
    """
    cells = found.select("pattern_id", "location_id", F.col("weekday").alias("_weekday"), F.explode("hours").alias("hour"))
    near = rows.filter("value is not null").join(cells, ["location_id", "hour"])
    return _strengths(near, F.col("weekday") == F.col("_weekday"), least)


def zone_strengths(rows: DataFrame, found: DataFrame, least: int = 8) -> DataFrame:
    """The same for level shifts (pattern_id, location_id): a zone's median over that of all other zones.

    Values are counted by zone and month before they meet the patterns.
    """
    counts = rows.filter("value is not null").groupBy("location_id", "month", "value").agg(F.count(F.lit(1)).alias("_n"))
    zones = found.select("pattern_id", F.col("location_id").alias("_zone"))
    near = counts.crossJoin(F.broadcast(zones))  # patterns of zones: as many as zones at most
    return _strengths(near, F.col("location_id") == F.col("_zone"), least, F.col("_n"))


def _strengths(near: DataFrame, treated: Column, least: int, weight: Column | None = None) -> DataFrame:
    weight = F.lit(1) if weight is None else weight
    median = lambda t: F.percentile(F.when(t, F.col("value")), F.lit(0.5), weight)
    n = lambda t: F.sum(F.when(t, weight).otherwise(0))
    g = near.groupBy("pattern_id", F.col("month").alias("window")).agg(median(treated).alias("_a"), median(~treated).alias("_b"), n(treated).alias("n_pattern"), n(~treated).alias("n_rest"))
    strength = F.when((F.col("n_pattern") >= least) & (F.col("n_rest") >= least), F.try_divide("_a", "_b"))
    return g.withColumn("strength", strength).drop("_a", "_b")


def wet_strengths(rows: DataFrame, wet: str, pattern_id: str, least: int = 8) -> DataFrame:
    """The same for the rain pattern: in each month the median of wet values over the dry median of their own cell."""
    cell = ["month", "location_id", "weekday", "hour"]
    known = rows.filter("value is not null")
    dry = known.filter(F.col(wet) == 0).groupBy(*cell).agg(F.median("value").alias("_base"), F.count(F.lit(1)).alias("_n")).filter("_n >= 2 and _base <> 0").drop("_n")
    ratios = known.filter(F.col(wet) > 0).join(dry, cell).groupBy("month").agg(F.median(F.col("value") / F.col("_base")).alias("_m"), F.count(F.lit(1)).alias("n_pattern"))
    rest = known.filter(F.col(wet) == 0).groupBy("month").agg(F.count(F.lit(1)).alias("n_rest"))
    g = rest.join(ratios, "month", "full").select(F.lit(pattern_id).alias("pattern_id"), F.col("month").alias("window"), "_m", F.coalesce("n_pattern", F.lit(0)).alias("n_pattern"), F.coalesce("n_rest", F.lit(0)).alias("n_rest"))
    return g.withColumn("strength", F.when((F.col("n_pattern") >= least) & (F.col("n_rest") >= least), F.col("_m"))).drop("_m")


def tracked(strengths: DataFrame, recent: int = 2, band: float = 0.15) -> DataFrame:
    """``evolution``, whose trend of the strengths over the windows is one of its columns."""
    return evolution(strengths, recent, band)


#: Kinds that describe the data and are not counted as discoveries, and the order in which kinds are listed.
DESCRIPTIVE = ("hourly_profile", "weekly_profile", "seasonal_profile", "hotspot")
KINDS = ("spatiotemporal", "level_shift", "conditional", *DESCRIPTIVE)


def discover(rows: DataFrame, months: DataFrame, fdr: float = 0.05, lift: float = 1.25) -> DataFrame:
    """All patterns of rows as one table (pattern_id, kind, location_id, weekday, hours, effect, lower, upper, confidence, descriptive), in a fixed order.

    lower and upper: the interval of a cell's ratio, of a level shift or of a slope; null for the other kinds.

    rows: location_id, event_time, weekday, hour, value, wet.  months: location_id, month, value.
    """
    none = lambda kind: F.lit(None).cast(kind)
    cells = discovered(cell_tests(rows.filter("value is not null")), fdr, lift)
    certain = cells.groupBy("location_id", "weekday_tested").agg(F.max("adjusted_p").alias("_p"))
    runs = merge_hours(cell_intervals(rows.filter("value is not null"), cells)).join(certain, ["location_id", "weekday_tested"])
    hour = lambda h: F.format_string("%02d", h.cast("int"))
    ident = F.concat(F.lit("ST-"), "location_id", F.lit("-"), F.col("weekday_tested").cast("string"), F.lit("-"), hour(F.element_at("hours", 1)), hour(F.element_at("hours", -1) + 1))
    parts = [runs.select(ident.alias("pattern_id"), F.lit("spatiotemporal").alias("kind"), "location_id", F.col("weekday_tested").cast("int").alias("weekday"), F.col("hours").cast("array<int>").alias("hours"), F.col("lift").alias("effect"), "lower", "upper", C.confidence_from_p(F.col("_p")).alias("confidence"))]
    row = lambda t, prefix, kind, effect, confidence, suffix=F.lit(""): t.select(F.concat(F.lit(prefix), "location_id", suffix).alias("pattern_id"), F.lit(kind).alias("kind"), "location_id", none("int").alias("weekday"), none("array<int>").alias("hours"), effect.alias("effect"), *[F.col(c) if c in t.columns else none("double").alias(c) for c in ("lower", "upper")], confidence.alias("confidence"))
    shifts = discovered_shifts(months)
    parts.append(row(shifts, "LVL-", "level_shift", F.col("adjusted_ratio"), C.confidence_from_p(F.col("p_value")), F.concat(F.lit("-"), "change_point")))
    parts.append(row(rain_effects(rows, "wet").filter("kept and range = 'all'"), "CND-", "conditional", F.col("slope"), C.confidence_from_p(F.col("p_value"))))
    parts.append(row(profile_patterns(rows, "hour"), "PRF-hour-", "hourly_profile", F.col("ratio"), F.col("confidence")))
    parts.append(row(profile_patterns(rows, "weekday"), "PRF-weekday-", "weekly_profile", F.col("ratio"), F.col("confidence")))
    parts.append(row(profile_patterns(rows.withColumn("month_of_year", F.month("event_time")), "month_of_year"), "PRF-month-", "seasonal_profile", F.col("ratio"), F.col("confidence")))
    parts.append(row(hotspots(rows).filter("hotspot"), "HOT-", "hotspot", F.col("ratio"), none("double")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return out.withColumn("descriptive", F.col("kind").isin(*DESCRIPTIVE)).orderBy(place, F.desc_nulls_last("confidence"), "pattern_id")


def evolution(strengths: DataFrame, recent: int = 2, band: float = 0.15, least: int = 3) -> DataFrame:
    """Status of each pattern from its windows (pattern_id, window, strength: null if it could not be measured).

    The last recent windows, by place, are set against all earlier ones, by medians.  In order: fewer than least
    measured windows are insufficient_history; earlier ones only, disappeared; recent ones only, new; two windows or
    more on either side of 1, conflicting; a significant trend in the direction of the change, strengthening or
    weakening; else stable, with ``within_band`` for a change of at most band.
    """
    last = Window.partitionBy("pattern_id").orderBy(F.desc("window"))  # the windows of one pattern
    rows = strengths.withColumn("_late", F.row_number().over(last) <= recent)
    middle = lambda late: F.median(F.when(F.col("_late") == late, F.col("strength")))
    side = lambda c: F.count_if(c)
    g = rows.groupBy("pattern_id").agg(F.count("strength").alias("windows"), middle(False).alias("historical"), middle(True).alias("recent"), side(F.col("strength") > 1).alias("_above"), side(F.col("strength") < 1).alias("_below"))
    t = S.trend(strengths, ["pattern_id"], "window", "strength").select("pattern_id", "rho", "p_value", "direction")
    g = g.join(t, "pattern_id", "left").withColumn("change", F.coalesce(F.try_divide(F.col("recent") - F.col("historical"), F.abs("historical")), F.lit(0.0)))
    status = (
        F.when(F.col("windows") < least, "insufficient_history")
        .when(F.col("recent").isNull(), "disappeared")
        .when(F.col("historical").isNull(), "new")
        .when(F.least("_above", "_below") >= 2, "conflicting")
        .when((F.col("direction") == "up") & (F.col("change") > 0), "strengthening")
        .when((F.col("direction") == "down") & (F.col("change") < 0), "weakening")
        .otherwise("stable")
    )
    return g.withColumns({"status": status, "within_band": F.abs("change") <= band}).drop("_above", "_below")
