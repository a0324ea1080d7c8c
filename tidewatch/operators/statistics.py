"""Rank tests, multiple testing, slopes and distribution drift, as grouped plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi_square_sf, normal_sf, t_sf_two_sided, t_upper_quantile


def average_rank(by: list[str], value: str) -> tuple[Column, Column]:
    """(average rank of a row, size of its tie) within by."""
    tie = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (tie - 1) / F.lit(2.0), tie


def mann_whitney(rows: DataFrame, by: list[str], treated: str, value: str = "value", least: int = 12) -> DataFrame:
    """U of the treated rows, z with tie and continuity correction, and the ratio of medians; sides below least are untested."""
    rank, tie = average_rank(by, value)
    ranked = rows.filter(F.col(value).isNotNull()).withColumn("_r", rank).withColumn("_t", tie.cast("double"))
    side = lambda t, c: F.when(F.col(treated) == t, c)
    g = ranked.groupBy(*by).agg(
        F.count_if(F.col(treated)).alias("n1"),
        F.count_if(~F.col(treated)).alias("n2"),
        F.sum(side(True, F.col("_r"))).alias("_r1"),
        F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"),  # sum over rows of t^2 - 1 is the sum over ties of t^3 - t
        F.median(side(True, F.col(value))).alias("treated_median"),
        F.median(side(False, F.col(value))).alias("control_median"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread)
    return g.filter((F.col("n1") >= least) & (F.col("n2") >= least)).withColumns({"u": u, "z": z, "effect": F.try_divide(F.col("treated_median"), F.col("control_median"))}).drop("_r1", "_ties")


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_sf(F.greatest(z, F.lit(0.0))))


def benjamini_hochberg(tests: DataFrame, p: str, level: float = 0.05) -> DataFrame:
    """Adjusted p and rejection of each test; null p are left out of the family.

    Tests with one p share the largest of their ranks, so it is enough to rank distinct values: they are counted
    first and ordered in buckets, and no task holds all tests.  The least of p m / k over larger p is taken inside
    a bucket and over the buckets above it.
    """
    known = tests.filter(F.col(p).isNotNull() & ~F.isnan(p))
    counts = known.groupBy(F.lit(1).alias("_all"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    ranked, _ = running_totals(counts, ["_all"], "_p", ["_c"])
    ranked = ranked.withColumn("_a", F.col("_p") * F.col("all__c") / F.col("upto__c"))
    above = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_BUCKETS rows
    least = ranked.groupBy("_bucket").agg(F.min("_a").alias("_b")).select("_bucket", F.min("_b").over(above).alias("_above"))
    inside = Window.partitionBy("_bucket").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = F.least(F.lit(1.0), F.min("_a").over(inside), "_above")
    table = ranked.join(F.broadcast(least), "_bucket").select("_p", adjusted.alias("adjusted_p"))
    out = known.join(table, known[p] == table["_p"]).drop("_p")
    return out.withColumn("rejected", F.col("adjusted_p") <= level)


def slope(rows: DataFrame, by: list[str], x: str, y: str, least: int = 30) -> DataFrame:
    """Least-squares slope, intercept, R2 and standard error; untested below least points or with constant x."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    left = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"))
    return g.filter((F.col("n") >= least) & (F.col("_sxx") > 0)).withColumn("stderr", F.sqrt(F.try_divide(F.try_divide(left, F.col("n") - 2), F.col("_sxx")))).drop("_sxx", "_syy")


def slope_test(slopes: DataFrame, level: float = 0.95) -> DataFrame:
    """``slope`` results with a t interval and p value; one row for each group, a small table."""
    degrees = (F.col("n") - 2).cast("double")
    width = t_upper_quantile(F.lit((1 + level) / 2), degrees) * F.col("stderr")
    # An exact line has no error: the quotient, which Spark evaluates for every row, is null there.
    p = F.when(F.col("stderr") > 0, t_sf_two_sided(F.coalesce(F.try_divide("slope", "stderr"), F.lit(0.0)), degrees)).otherwise(F.when(F.col("slope") != 0, 0.0).otherwise(1.0))
    return slopes.withColumns({"lower": F.col("slope") - width, "upper": F.col("slope") + width, "p_value": p})


def trend(rows: DataFrame, by: list[str], x: str, y: str, least: int = 4, level: float = 0.05) -> DataFrame:
    """Spearman trend of each group: rho, p and direction (up, down, flat); fewer than least known points are untested.

    One row for each point of a short series; a constant series is tested and flat.
    """
    known = rows.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    g = spearman(known, by, x, y)
    flat = known.groupBy(*by).agg((F.count_distinct(y) <= 1).alias("_flat"))
    rho, degrees = F.col("rho"), (F.col("n") - 2).cast("double")
    t = F.coalesce(rho * F.sqrt(F.greatest(degrees, F.lit(0.0)) / F.greatest(F.lit(1e-300), 1 - rho * rho)), F.lit(0.0))
    p = F.when(F.abs(rho) >= 1 - 1e-12, 0.0).otherwise(t_sf_two_sided(t, F.greatest(degrees, F.lit(1.0))))
    tested = F.col("n") >= least
    out = g.alias("g").join(flat.alias("f"), _same(by, "g", "f")).select("g.*", "f._flat").withColumn("tested", tested)
    out = out.withColumns({"rho": F.when(tested, F.when(F.col("_flat"), 0.0).otherwise(rho)), "p_value": F.when(tested, F.when(F.col("_flat"), 1.0).otherwise(p))})
    sure = F.coalesce(F.col("p_value") <= level, F.lit(False))
    return out.withColumn("direction", F.when(sure & (F.col("rho") > 0), "up").when(sure & (F.col("rho") < 0), "down").otherwise("flat")).drop("_flat")


def kruskal_test(tests: DataFrame) -> DataFrame:
    """``kruskal_wallis`` results with their p value."""
    return tests.withColumn("p_value", F.when(F.col("h").isNotNull(), chi_square_sf(F.coalesce("h", F.lit(0.0)), F.greatest(F.col("degrees"), F.lit(1)).cast("double"))))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation of each group; null where x or y is constant."""
    rx, _ = average_rank(by, x)
    ry, _ = average_rank(by, y)
    g = rows.withColumns({"_x": rx, "_y": ry}).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("_x", "_y").alias("_c"), F.var_pop("_x").alias("_vx"), F.var_pop("_y").alias("_vy"))
    return g.withColumn("rho", F.try_divide(F.col("_c"), F.sqrt(F.col("_vx")) * F.sqrt(F.col("_vy")))).drop("_c", "_vx", "_vy")


def kruskal_wallis(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """H with tie correction and its degrees of freedom; h is null where all values tie."""
    rank, tie = average_rank(by, value)
    ranked = rows.filter(F.col(value).isNotNull()).withColumns({"_r": rank, "_t": tie.cast("double")})
    g = ranked.groupBy(*by, group).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_c"))
    t = g.groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_q"), F.sum("_n").cast("double").alias("n"), F.sum("_c").alias("_c"), (F.count(F.lit(1)) - 1).alias("degrees"))
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1), 1 - F.try_divide(F.col("_c"), n * n * n - n))
    return t.withColumn("h", h).drop("_q", "_c")


def degenerate(edges: Column, bins: int) -> Column:
    """Inner quantiles of which more than one is repeated (or none are known): too few values to bin; one tie may be chance."""
    return F.coalesce(F.size(F.array_distinct(edges)) < bins - 2, F.lit(True))


def psi(reference: DataFrame, recent: DataFrame, value: str, bins: int = 10, least: int = 30, floor: float = 1e-6) -> DataFrame:
    """Population stability index over the reference's quantile bins: one row (psi: null if too thin or degenerate)."""
    shares = [k / bins for k in range(1, bins)]
    # One row of bins - 1 edges.
    edges = reference.agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("edges"))
    both = reference.select(F.col(value).alias("v"), F.lit(1).alias("ref")).unionByName(recent.select(F.col(value).alias("v"), F.lit(0).alias("ref"))).filter("v is not null")
    slot = F.size(F.filter("edges", lambda e: e <= F.col("v")))
    counts = both.crossJoin(F.broadcast(edges)).groupBy(slot.alias("bin")).agg(F.sum("ref").alias("a"), F.sum(1 - F.col("ref")).alias("b"))
    grid = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").na.fill(0)
    total = full.withColumns({"n": F.sum("a").over(Window.partitionBy()), "m": F.sum("b").over(Window.partitionBy())})
    p, q = F.greatest(F.try_divide("a", "n"), F.lit(floor)), F.greatest(F.try_divide("b", "m"), F.lit(floor))
    out = total.agg(F.sum((q - p) * F.log(q / p)).alias("psi"), F.max("n").alias("reference_rows"), F.max("m").alias("recent_rows"))
    flat = edges.select(degenerate(F.col("edges"), bins).alias("flat"))
    thin = (F.col("reference_rows") < least) | (F.col("recent_rows") < least) | F.col("flat")
    return out.crossJoin(F.broadcast(flat)).withColumn("psi", F.when(~thin, F.col("psi"))).drop("flat")


def psi_windows(reference: DataFrame, rows: DataFrame, value: str, window: str, bins: int = 10, least: int = 30, floor: float = 1e-6) -> DataFrame:
    """(window, psi, rows): the index of every window of rows against one reference, in one grouped pass."""
    shares = [k / bins for k in range(1, bins)]
    found = reference.agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("edges"), F.count(value).alias("n"))  # one row
    slot = F.size(F.filter("edges", lambda e: e <= F.col(value)))
    count = lambda t, *keys: t.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(found.select("edges"))).groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    base = count(reference).withColumnRenamed("c", "a")
    grid = rows.select(window).distinct().crossJoin(F.broadcast(rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))))
    full = grid.join(F.broadcast(base), "bin", "left").join(count(rows, window), [window, "bin"], "left").na.fill(0, ["a", "c"])
    total = full.withColumns({"n": F.sum("a").over(Window.partitionBy(window)), "m": F.sum("c").over(Window.partitionBy(window))})
    p, q = F.greatest(F.try_divide("a", "n"), F.lit(floor)), F.greatest(F.try_divide("c", "m"), F.lit(floor))
    out = total.groupBy(window).agg(F.sum((q - p) * F.log(q / p)).alias("psi"), F.max("n").alias("_n"), F.max("m").alias("rows"))
    flat = found.select(degenerate(F.col("edges"), bins).alias("_flat"))
    thin = (F.col("_n") < least) | (F.col("rows") < least) | F.col("_flat")
    return out.crossJoin(F.broadcast(flat)).withColumn("psi", F.when(~thin, F.col("psi"))).drop("_n", "_flat")


def psi_status(psi_: Column, drifted: float = 0.25, minor: float = 0.1) -> Column:
    return F.when(psi_.isNull(), "insufficient_data").when(psi_ >= drifted, "drifted").when(psi_ >= minor, "minor").otherwise("stable")


#: Rows that a task may order in one bucket, and buckets at most (more rows make larger buckets).
BUCKET_ROWS, MOST_BUCKETS = 20_000, 1024


def running_totals(counts: DataFrame, by: list[str], value: str, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Running totals of parts in the order of value within by; counts has one row for each by and value.

    Values are bucketed by range, windows run inside buckets, and the totals of lower buckets are added: no
    group passes through one task.  Returns counts with _bucket, upto_<part> and all_<part>, and the buckets:
    by, _bucket, below_<part> and size_<part>.  One job runs at once, for the edges of the buckets.
    """
    placed = counts.withColumn("_bucket", _bucket(F.col(value), bucket_edges(counts, value)))
    sizes = placed.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"size_{c}") for c in parts])
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_BUCKETS rows
    every = Window.partitionBy(*by)
    buckets = sizes.withColumns({f"below_{c}": F.coalesce(F.sum(f"size_{c}").over(lower), F.lit(0)) for c in parts} | {f"all_{c}": F.sum(f"size_{c}").over(every) for c in parts})
    upto = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumns({f"upto_{c}": F.sum(c).over(upto) for c in parts})
    joined = inside.alias("i").join(buckets.alias("b"), _same([*by, "_bucket"], "i", "b"))
    out = joined.select("i.*", *[f"b.{k}_{c}" for k in ("below", "all") for c in parts]).withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"below_{c}") for c in parts})
    return out.drop(*[f"below_{c}" for c in parts]), buckets


def bucket_edges(counts: DataFrame, value: str) -> list:
    """Sorted edges that divide the rows of counts into buckets of about BUCKET_ROWS rows, at most MOST_BUCKETS of them."""
    grid = [k / MOST_BUCKETS for k in range(1, MOST_BUCKETS)]
    found = counts.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, grid, 10 * MOST_BUCKETS).alias("e")).first()
    n = min(MOST_BUCKETS, found["n"] // BUCKET_ROWS + 1)
    return sorted({found["e"][MOST_BUCKETS * k // n - 1] for k in range(1, n)}) if found["e"] else []


def _bucket(value: Column, edges: list) -> Column:
    """How many of the sorted edges are at or below value: by parts of 32 edges first, then inside one."""
    if not edges:
        return F.lit(0).cast("long")
    below = lambda part: F.size(F.filter(part, lambda e: e <= value))
    if len(edges) <= 32:
        return below(F.array(*map(F.lit, edges))).cast("long")
    parts = [edges[k : k + 32] for k in range(0, len(edges), 32)]
    part = F.greatest(below(F.array(*[F.lit(p[0]) for p in parts])) - 1, F.lit(0))
    return (part * 32 + below(F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in parts]), part + 1))).cast("long")


def counted_quantiles(counts: DataFrame, by: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """(by, quantiles, rows): exact interpolated quantiles of each group of counts (one row for each by and value), in the order of shares.

    As for ``counted_median``: by rank in running totals, or at once where groups have few distinct values.
    """
    most = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c")).first()["c"] or 0
    if most <= BUCKET_ROWS:
        return counts.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, shares)), F.col(n)).alias("quantiles"), F.sum(n).alias("rows"))
    ranked, _ = running_totals(counts, by, value, [n])
    at = lambda p: (F.col(f"all_{n}") - 1) * F.lit(p)
    pick = lambda rank: F.min(F.when(F.col(f"upto_{n}") >= rank + 1, F.col(value)))
    part = lambda p: F.max(at(p) - F.floor(at(p)))
    each = [pick(F.floor(at(p))) * (1 - part(p)) + pick(F.ceil(at(p))) * part(p) for p in shares]
    return ranked.groupBy(*by).agg(F.array(*each).alias("quantiles"), F.max(f"all_{n}").alias("rows"))


def counted_median(counts: DataFrame, by: list[str], value: str, n: str, name: str = "median") -> DataFrame:
    """(by, name, rows): exact median of each group of counts (by, value, n); a value may stand in several rows.

    The middle ranks are looked up in running totals by bucket, so no group passes through one task.  Groups of few
    distinct values need no buckets: there one weighted percentile holds a bucket's worth of rows.
    """
    most = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c")).first()["c"] or 0
    if most <= BUCKET_ROWS:
        return counts.groupBy(*by).agg(F.percentile(value, F.lit(0.5), F.col(n)).alias(name), F.sum(n).alias("rows"))
    one = counts.groupBy(*by, value).agg(F.sum(n).alias("_n"))
    ranked, _ = running_totals(one, by, value, ["_n"])
    total = F.col("all__n")
    pick = lambda rank: F.min(F.when(F.col("upto__n") >= rank, F.col(value)))
    middle = (pick(F.floor((total + 1) / 2)) + pick(F.floor((total + 2) / 2))) / 2
    return ranked.groupBy(*by).agg(middle.alias(name), F.max("all__n").alias("rows"))


def _same(names: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in names:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def ks_statistic(rows: DataFrame, by: list[str], first: str, value: str) -> DataFrame:
    """Largest distance between the two empirical distributions (first: boolean column).

    Values are counted before they are ordered, and ordered in buckets.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(first)).alias("a"), F.count_if(~F.col(first)).alias("b"))
    ranked, _ = running_totals(counts, by, value, ["a", "b"])
    apart = F.abs(F.try_divide("upto_a", "all_a") - F.try_divide("upto_b", "all_b"))
    return ranked.withColumn("d", apart).groupBy(*by).agg(F.max("d").alias("ks"), F.sum("a").alias("first_rows"), F.sum("b").alias("second_rows"))


def sigma_gate(values: DataFrame, value: str, multiplier: float = 3.0, windows: int = 4, floor: float = 0.0) -> DataFrame:
    g = values.agg(F.count(value).alias("windows"), (F.avg(value) + multiplier * F.stddev_samp(value)).alias("gate"))
    return g.withColumn("gate", F.when(F.col("windows") >= windows, F.greatest("gate", F.lit(floor))))


def bootstrap_median_ratio(rows: DataFrame, by: list[str], treated: str, draws: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Seeded percentile bootstrap of the ratio of medians; null values are left out.

    The m-th smallest of n draws from n sorted values is the value at rank ceil(n U), U the m-th smallest of n
    uniform numbers, which has a beta distribution.  So only the ranks of each draw's medians are drawn (the
    distribution is that of drawing all n values), and looked up in the counted values, bucket by bucket.
    """
    known = rows.filter(F.col("value").isNotNull() & F.col(treated).isNotNull())
    counts = known.groupBy(*by, F.col(treated).alias("_side"), "value").agg(F.count(F.lit(1)).alias("_c"))
    sides = [*by, "_side"]
    ranked, buckets = running_totals(counts, sides, "value", ["_c"])
    ends = F.sort_array(F.collect_list(F.struct((F.col("below__c") + F.col("size__c")).alias("stop"), F.col("_bucket").alias("bucket"))))
    cells = buckets.groupBy(*sides).agg(ends.alias("_ends"))  # at most MOST_BUCKETS ends a row

    def ranks(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                stops = np.array([e["stop"] for e in row[-1]], dtype=np.int64)
                places = np.array([e["bucket"] for e in row[-1]], dtype=np.int64)
                pair = median_ranks(int(stops[-1]), draws, np.random.default_rng([seed, int(row[-2])]))
                flat = pair.ravel()
                out = pd.DataFrame({"_draw": np.repeat(np.arange(draws), 2), "_rank": flat, "_bucket": places[np.searchsorted(stops, flat)]})
                for k, c in enumerate(sides):
                    out[c] = [None if pd.isna(row[k]) else row[k]] * len(out)
                yield out[[*sides, "_draw", "_rank", "_bucket"]]

    types = dict(counts.dtypes)
    wanted = cells.mapInPandas(ranks, ", ".join(f"`{c}` {types[c]}" for c in sides) + ", _draw long, _rank long, _bucket long")
    needed = wanted.groupBy(*sides, "_bucket", "_rank").agg(F.collect_list("_draw").alias("_draws"))  # a draw twice if both middles are one rank
    spans = ranked.select(*sides, "_bucket", "value", (F.col("upto__c") - F.col("_c")).alias("_from"), F.col("upto__c").alias("_to"))
    at = _same([*sides, "_bucket"], "w", "s") & (F.col("w._rank") > F.col("s._from")) & (F.col("w._rank") <= F.col("s._to"))
    met = needed.alias("w").join(spans.alias("s"), at).select(*[f"w.{c}" for c in sides], "s.value", F.explode("w._draws").alias("_draw"))
    median = lambda t: F.avg(F.when(F.col("_side") == t, F.col("value")))
    ratios = met.groupBy(*by, "_draw").agg(median(True).alias("_a"), median(False).alias("_b")).withColumn("_r", F.try_divide("_a", "_b"))
    return ratios.groupBy(*by).agg(F.percentile("_r", (1 - level) / 2).alias("lower"), F.percentile("_r", (1 + level) / 2).alias("upper"))


def median_ranks(n: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """The ranks (from 1) of the two middle values of draws samples of n from n, drawn with replacement; for odd n they are one."""
    m = (n + 1) // 2
    u = rng.beta(m, n - m + 1, draws)
    low = np.clip(np.ceil(n * u), 1, n).astype(np.int64)
    if n % 2:
        return np.stack([low, low], axis=1)
    above = u + (1 - u) * (1 - rng.random(draws) ** (1 / (n - m)))  # the least of the n - m uniform numbers above u
    return np.stack([low, np.clip(np.ceil(n * above), low, n).astype(np.int64)], axis=1)
