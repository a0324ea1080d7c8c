"""Boundary cases of the sensor engine on small hand-made frames."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions import special
from tidewatch.operators import evaluation, features, integrity, monitoring, patterns, statistics
from tidewatch.sources import feeds
from tidewatch.streaming import streams

T0 = dt.datetime(2024, 1, 1)
OBS = "observation_id string, source_id string, location_id string, metric string, event_time timestamp_ntz, source_time timestamp_ntz, received_time timestamp_ntz, value double"


def keyed(df):
    """Observations with the rest of their key."""
    return df.withColumns({"unit": F.lit("vehicles/hour"), "duration_minutes": F.lit(60), "aggregation_level": F.lit("hourly")})


def obs(spark, values, hours=1, source="s1", start=0):
    rows = [(f"o{start + i:04d}", source, "A", "m", T0 + dt.timedelta(hours=hours * i), T0, T0 + dt.timedelta(hours=hours * i), v) for i, v in enumerate(values)]
    return keyed(spark.createDataFrame(rows, OBS))


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_values_agree(spark):
    cases = [(None, None, True), (None, 1.0, False), (100.0, 105.0, True), (100.0, 106.0, False), (0.0, 0.5, True), (-0.2, 0.2, True), (-5.0, 5.0, False)]
    rows = spark.createDataFrame(cases, "x double, y double, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", C.values_agree(F.col("x"), F.col("y"), 0.05, 0.5)).collect())


def test_group_conflict_equals_pairwise(spark):
    random.seed(3)
    groups = {}
    rows = []
    for g in range(300):
        vals = [random.choice([None, random.uniform(-2, 2), random.uniform(90, 110)]) for _ in range(random.randint(1, 5))]
        groups[g] = vals
        rows += [(f"{g}-{i}", "s", str(g), "m", T0, T0, T0, v) for i, v in enumerate(vals)]
    found = {int(r.location_id): r.dissent for r in integrity.key_groups(keyed(spark.createDataFrame(rows, OBS))).collect()}

    def agree(x, y):
        if x is None or y is None:
            return x is y
        return abs(x - y) <= max(0.5, 0.05 * max(abs(x), abs(y)))

    for g, v in groups.items():
        assert found[g] == any(not agree(a, b) for i, a in enumerate(v) for b in v[i + 1 :])


def test_placement_is_a_partition(spark):
    a, b = obs(spark, [1.0, 5.0, None, 7.0]), obs(spark, [1.0, 50.0, None, 7.1], source="s2", start=100)
    placed = {r.observation_id: r.placement for r in integrity.place(a.unionByName(b)).collect()}
    assert placed == {"o0000": "unified", "o0100": "duplicate_linked", "o0001": "conflicted", "o0101": "conflicted", "o0002": "unified", "o0102": "duplicate_linked", "o0003": "unified", "o0103": "duplicate_linked"}


def test_range_check_and_units(spark):
    nan = F.lit(float("nan"))
    c = lambda v: C.range_check(v, F.lit(1.0), F.lit(9.0), F.lit(True))
    r = one(spark, c(nan), c(F.lit(-1.0)), c(F.lit(0.5)), c(F.lit(10.0)), c(F.lit(5.0)), c(F.lit(None).cast("double")))
    assert list(r) == ["not_a_number", "negative", "below_minimum", "above_maximum", None, None]
    r = one(spark, C.convert(F.lit(10.0), F.lit("m/s"), F.lit("kmph")), C.convert(F.lit(1.0), F.lit("mm"), F.lit("s")), C.convert(F.lit(1.0), F.lit("?"), F.lit("s")))
    assert r[0] == pytest.approx(36.0) and r[1] is None and r[2] is None


def test_snap_is_half_even_in_local_time(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    r = one(spark, C.snap(at("2024-01-01 00:30:00"), 60), C.snap(at("2024-01-01 01:30:00"), 60), C.snap(at("2024-01-01 00:29:00"), 60, 5.5), C.snap(at("2024-01-01 00:07:31"), 0))
    assert list(r) == [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 2), dt.datetime(2024, 1, 1, 0, 30), dt.datetime(2024, 1, 1, 0, 7, 31)]


def test_parse_feed_first_failure_wins(spark):
    ok = ("r1", "s", "2024-01-01T01:00:00+05:30", "A", "m", "1.5", "km/h")
    rows = [ok, ("", *ok[1:]), (*ok[:2], "2024-01-01T01:00:00", *ok[3:]), (*ok[:2], "x", *ok[3:]), (*ok[:5], "abc", "km/h"), (*ok[:5], "", "km/h"), (*ok[:5], "NaN", "km/h"), (*ok[:6], "kmph")]
    got = [r.error for r in integrity.parse_feed(spark.createDataFrame(rows, feeds.FEED), 60, 5.5, ["km/h"]).collect()]
    assert got == [None, "schema_error", "invalid_timestamp", "invalid_timestamp", "invalid_value", None, "invalid_value", "unknown_unit"]


def test_frozen_runs(spark):
    x = obs(spark, [5.0] * 6 + [0.0] * 8 + [7.0] * 3 + [None] + [7.0] * 3 + [9.0] * 5)
    runs = integrity.frozen_runs(x, ("location_id",), F.col("value")).collect()
    assert [(r.run_value, r.length) for r in runs] == [(5.0, 6)]


def test_mad_needs_rows_and_spread(spark):
    assert integrity.mad_outliers(obs(spark, [1.0] * 10 + [99.0]), ("metric",)).count() == 0
    assert integrity.mad_outliers(obs(spark, [1.0] * 20 + [99.0]), ("metric",)).count() == 0
    assert integrity.mad_outliers(obs(spark, [float(i % 5) for i in range(20)] + [99.0, None]), ("metric",)).count() == 1


def test_lag_leaves_holes_null_and_rolling_needs_two(spark):
    x = obs(spark, [1.0, 2.0, None, 4.0, 5.0]).filter("observation_id <> 'o0003'")
    series = features.hourly(x)
    got = [r.lag_1h for r in features.lag_features(series, (1,)).orderBy("event_time").collect()]
    assert got == [None, 1.0, 2.0, None]
    got = [r.mean_3h for r in features.rolling_features(series, (3,)).orderBy("event_time").collect()]
    assert got == [None, 1.5, 1.5, None]


def test_leakage_probe_blames_the_leaky_feature_only(spark):
    series = features.hourly(obs(spark, [float(i) for i in range(12)]))

    def leaky(s):
        from pyspark.sql import Window

        rows = features.lag_features(s, (1,))
        return rows.withColumn("peek", F.lead("value").over(Window.partitionBy("location_id").orderBy("event_time")))

    probes = series.filter(F.hour("event_time").isin(4, 7)).select("location_id", "event_time")
    found = features.leakage_probe(series, leaky, probes, ["lag_1h", "peek"]).collect()
    assert {r.feature for r in found} == {"peek"} and len(found) == 2


def test_temporal_split_has_gaps(spark):
    split = features.temporal_split(features.hourly(obs(spark, [1.0] * 100)), gap_hours=3)
    n = {r.segment: r["count"] for r in split.groupBy("segment").count().collect()}
    assert n == {"train": 60, None: 6, "validation": 17, "test": 17}


def test_special_functions():
    assert special.normal_tail(1) == pytest.approx(0.15865525393145707, abs=1e-12)
    assert special.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.t_tail_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    rows = statistics.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "id int, p double"), "p").orderBy("id").collect()
    assert [round(r.adjusted_p, 4) for r in rows] == [0.02, 0.04, 0.04, 0.02] and all(r.rejected for r in rows)


def test_psi_and_ks(spark):
    random.seed(1)
    same = spark.createDataFrame([(random.gauss(0, 1),) for _ in range(500)], "v double")
    far = spark.createDataFrame([(random.gauss(3, 1),) for _ in range(500)], "v double")
    assert statistics.psi(same, same, "v").first().psi == pytest.approx(0, abs=1e-9)
    assert statistics.psi(same, far, "v").first().psi > 0.25
    assert statistics.psi(same.limit(10), far, "v").first().psi is None
    flat = spark.createDataFrame([(1.0,)] * 50, "v double")
    assert statistics.psi(flat, far, "v").first().psi is None
    both = same.withColumn("a", F.lit(True)).unionByName(same.withColumn("a", F.lit(False))).withColumn("k", F.lit(1))
    assert statistics.ks_statistic(both, ["k"], "a", "v").first().ks == 0


def test_slope_recovers_a_planted_line(spark):
    rows = spark.createDataFrame([(1, float(x), 0.03 * x + 1) for x in range(40)], "k int, x double, y double")
    got = statistics.slope(rows, ["k"], "x", "y").first()
    assert got.slope == pytest.approx(0.03) and got.stderr == pytest.approx(0, abs=1e-9)
    assert statistics.slope(rows.limit(20), ["k"], "x", "y").count() == 0


def test_missing_prediction_counts_as_error(spark):
    fc = spark.createDataFrame([("A", 10.0, None), ("A", 10.0, 8.0)], "location_id string, actual double, predicted double")
    got = evaluation.slice_metrics(fc, {"all": F.lit(True)}).first()
    assert (got.mae, got.coverage) == (6.0, 0.5)


def test_reliability_last_bin_is_closed(spark):
    rows = spark.createDataFrame([(1.0, True), (0.95, False), (0.05, False)], "probability double, outcome boolean")
    assert {r.bin: r["count"] for r in evaluation.reliability(rows).collect()} == {9: 2, 0: 1}


def test_severity_of_unknown_threshold_is_low(spark):
    s = features.hourly(obs(spark, [5.0]))
    limits = spark.createDataFrame([], "location_id string, threshold double")
    got = evaluation.graded(s, limits).first()
    assert (got.severity, got.congested) == ("low", False)


def test_congestion_window_breaks_at_a_hole(spark):
    s = features.hourly(obs(spark, [5.0, 5.0, 1.0, 5.0]))
    w = evaluation.congestion_windows(evaluation.graded(s, spark.createDataFrame([("A", 2.0)], "location_id string, threshold double")))
    assert sorted(r.hours for r in w.collect()) == [1, 2]


def test_evolution_status(spark):
    series = {
        "up": [1.1, 1.6, 2.1, 2.6, 3.1], "down": [3.1, 2.6, 2.1, 1.6, 1.1], "flat": [1.5] * 4, "gone": [1.5, 1.5, 1.5, 1.5, None, None], "short": [2.0, None, 2.0],
        "torn": [1.3, 0.8, 1.3, 0.8, 1.3, 1.3], "once_below": [1.5, 0.9, 1.5, 1.5], "jump": [1.5, 1.5, 1.4, 3.0, 1.6], "unmeasured_gap": [1.1, None, 1.6, 2.1, None, 2.6, 3.1],
    }
    rows = [(k, f"{i}", v) for k, s in series.items() for i, v in enumerate(s)]
    got = {r.pattern_id: r for r in patterns.evolution(spark.createDataFrame(rows, "pattern_id string, window string, strength double")).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "up": "strengthening", "down": "weakening", "flat": "stable", "gone": "disappeared", "short": "insufficient_history", "torn": "conflicting", "once_below": "stable", "jump": "stable", "unmeasured_gap": "strengthening",
    }
    assert not got["jump"].within_band and got["flat"].within_band and got["gone"].historical == 1.5
    fresh = spark.createDataFrame([("new", f"{i}", 1.4 if i > 1 else None) for i in range(5)], "pattern_id string, window string, strength double")
    assert patterns.evolution(fresh, recent=3).first().status == "new"


def test_degenerate_series_do_not_crash(spark):
    flat = spark.createDataFrame([("k", float(i), 2.0, "ab"[i % 2]) for i in range(40)], "k string, x double, y double, g string")
    assert statistics.spearman(flat, ["k"], "x", "y").first().rho is None
    assert (statistics.trend(flat, ["k"], "x", "y").first().direction, statistics.trend(flat, ["k"], "x", "y").first().p_value) == ("flat", 1.0)
    for y, want in ((F.lit(2.0), 1.0), (2 * F.col("x") + 1, 0.0)):
        s = statistics.slope_test(statistics.slope(flat.withColumn("y", y), ["k"], "x", "y")).first()
        assert s.p_value == pytest.approx(want, abs=1e-9) and s.lower == pytest.approx(s.upper)
    h = statistics.kruskal_test(statistics.kruskal_wallis(flat, ["k"], "g", "y")).first()
    assert h.h is None and h.p_value is None
    nothing = flat.limit(0)
    assert statistics.psi(nothing, flat, "x").first().psi is None and statistics.psi(flat, nothing, "x").first().psi is None
    assert [r.psi for r in statistics.psi_windows(nothing, flat, "x", "g").collect()] == [None, None]
    tied = spark.createDataFrame([(float(max(i, 20)),) for i in range(100)], "x double")  # two inner quantiles are equal
    assert statistics.psi(tied, tied, "x").first().psi == pytest.approx(0, abs=1e-9)
    assert patterns.level_shifts(spark.createDataFrame([("A", f"m{i % 6}", 1.0) for i in range(60)], "location_id string, month string, value double")).count() == 0


def test_level_shifts_by_rank(spark, monkeypatch):
    """Medians of all change points against plain ones, in one bucket and in many; a change point needs two zones."""
    import statistics as plain

    rng = random.Random(3)
    rows = [(z, f"2024-{m:02d}", float(rng.randint(1, 40)) * (4.0 if z == "B" and m >= 5 else 1.0)) for z in "ABC" for m in range(1, 9) for _ in range(rng.randint(0 if z == "C" else 3, 12))] + [("D", "2024-08", 5.0)]
    df = spark.createDataFrame(rows, "location_id string, month string, value double")
    months = sorted({m for _, m, _ in rows})
    want = {}
    for z in "ABCD":
        for c in months[2:-1]:
            before, after = [v for y, m, v in rows if y == z and m < c], [v for y, m, v in rows if y == z and m >= c]
            want[z, c] = (plain.median(before) if before else None, plain.median(after) if after else None, len(before), len(after))
    for size in (20_000, 7):
        monkeypatch.setattr(statistics, "BUCKET_ROWS", size)
        got = {(r.location_id, r.change_point): (r.before_median, r.after_median, r.n_before, r.n_after) for r in patterns.shift_medians(df).collect()}
        assert got == want
    found = {r.location_id: r for r in patterns.level_shifts(df).collect()}
    assert set(found) == {"A", "B", "C"} and found["B"].change_point in ("2024-04", "2024-05") and found["B"].adjusted_ratio == pytest.approx(found["B"].raw_ratio / found["B"].peer_ratio)
    assert patterns.level_shifts(df.filter("location_id = 'B'")).count() == 0
    sure = {r.location_id: r for r in patterns.discovered_shifts(df).collect()}["B"]
    assert 1 < sure.lower <= sure.adjusted_ratio <= sure.upper and sure.p_value < 0.05


def test_counted_medians_in_buckets(spark, monkeypatch):
    import statistics as plain

    rng = random.Random(8)
    rows = [(rng.choice("aab"), None if rng.random() < 0.05 else float(rng.randint(1, 300))) for _ in range(2000)]
    x = spark.createDataFrame([(f"o{i}", k, v) for i, (k, v) in enumerate(rows)], "observation_id string, metric string, value double")
    for size in (20_000, 11):
        monkeypatch.setattr(statistics, "BUCKET_ROWS", size)
        got = {r.metric: r for r in integrity.mad_cells(x, ("metric",)).collect()}
        for k in "ab":
            v = [b for a, b in rows if a == k and b is not None]
            m = plain.median(v)
            assert (got[k].group_median, got[k].group_size) == (m, len(v)) and got[k].group_mad == pytest.approx(1.4826 * plain.median([abs(b - m) for b in v]))


def test_gates_use_every_reference_row(spark):
    windows = spark.createDataFrame([(0, 1000, 0.1, 10.0), (1, 60, 0.2, 90.0), (2, 60, 0.1, 120.0), (3, 60, 0.3, 90.0), (4, 20, 9.0, 5.0)], "w int, rows long, psi double, mae double")
    g = monitoring.calibrated_gates(windows).first()
    assert g.windows == 4 and g.reference_error == pytest.approx((10 * 1000 + 300 * 60 + 100) / 1200)
    assert monitoring.calibrated_gates(windows.limit(3)).first().prediction_psi is None
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2),)], "sample_time timestamp")
    assert monitoring.reference_after_training(rows, "2024-01-02 00:00:00").count() == 1
    with pytest.raises(ValueError):
        monitoring.reference_after_training(rows, "2024-01-02 00:00:01")


DAY = pd.Timestamp("2024-01-01")


def told(evaluations, **kw):
    """Fold (day, kinds, magnitude) rows; the episodes and the days that raised a candidate."""
    f = monitoring.EpisodeFold(**kw)
    raised = [d for d, kinds, size in evaluations if f.observe(DAY + pd.Timedelta(days=d), kinds, size)[1]]
    f.close()
    return [(e["events"], e["candidates"], e["peak"], e["kinds"]) for e in f.done], raised


def test_a_new_episode_raises_at_once_and_others_close_it():
    p = ["prediction"]
    assert told([(0, p, 1.1), (7, p, 1.4), (14, [], None), (21, p, 1.2)]) == ([(2, 1, 1.4, p), (1, 1, 1.2, p)], [0, 21])  # day 21 is within the cooldown, yet new
    assert told([(7 * k, p, 1.0) for k in range(9)])[1] == [0, 28, 56]  # one that goes on waits for the cooldown
    assert told([(0, ["feature"], 2.0), (7, ["feature", "prediction"], float("nan"))]) == ([(1, 1, 0.0, ["feature", "prediction"])], [7])  # a kind that is not required opens nothing
    assert told([(0, ["feature"], 2.0), (7, [], 1.0)], required=()) == ([(1, 1, 2.0, ["feature"])], [0])


def test_streamed_episodes_equal_the_batch_fold(spark, tmp_path):
    random.seed(8)
    days = [(7 * k, random.choice([[], ["prediction"], ["feature"], ["feature", "prediction"]]), random.random()) for k in range(30)]
    schema = "stream string, detected_at timestamp, kinds array<string>, magnitude double"
    rows = [("m", (DAY + pd.Timedelta(days=d)).to_pydatetime(), kinds, size) for d, kinds, size in days]
    for k in range(0, 30, 4):  # each file a trigger; rows in it out of order
        part = rows[k : k + 4]
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.run_to_end(streams.stream_episodes(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"), mode="update")
    out = spark.read.schema(monitoring.EPISODES + ", batch long").parquet(str(tmp_path / "out"))
    last = out.groupBy("episode_id").agg(F.max_by(F.struct("events", "candidates", "kinds", "closed_at"), "batch").alias("x")).select("episode_id", "x.*")
    want = monitoring.episodes(spark.createDataFrame(rows, schema)).select("episode_id", "events", "candidates", "kinds", "closed_at")
    key = lambda r: r[0]
    assert sorted(map(tuple, last.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and want.count() > 2


def test_registry_has_one_champion():
    r = monitoring.ModelRegistry()
    for v in ("a", "b"):
        r.register(v)
        r.promote(v)
    assert r.champion() == "b" and r.rows["a"]["status"] == "archived" and r.lineage("b") == ["b", "a"]


def test_promotion_abstains_on_absent_slices(spark):
    x = spark.createDataFrame([(10.0, 8.0, 9.9)] * 250, "actual double, champion double, challenger double")
    got = [(r.rule, r.passed) for r in monitoring.promotion(x, {"none": F.lit(False)}).collect()]
    assert got == [("rows", True), ("gain", True), ("leakage", True), ("slice:none", None)] and monitoring.decide(got) == "promoted"
    got = [(r.rule, r.passed) for r in monitoring.promotion(x, {}, respects_horizon=False).collect()]
    assert got[-1] == ("horizon", False) and monitoring.decide(got) == "rejected"


def test_explanations_rank(spark):
    one_row = spark.createDataFrame([(3.0,)], "value double")
    got = monitoring.explained(one_row, F.lit(1.0), F.lit("failed"), F.lit(2), F.lit(False)).first()
    assert [e.kind for e in got.explanations] == ["sensor_suspect", "sensor_suspect", "rainfall"] and got.support == 0.75
    assert monitoring.explained(one_row, F.lit(0.0), F.lit("ok"), F.lit(0), F.lit(False)).first().leading == "unexplained"


def test_feed_writer_refuses_labels_and_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "record_id string")
    with pytest.raises(ValueError):
        feeds.write_feed(rows.withColumn("is_anomaly", F.lit(1)), str(tmp_path / "x"))
    feeds.write_feed(rows, str(tmp_path / "x"))
    with pytest.raises(Exception):  # noqa: B017
        feeds.write_feed(rows, str(tmp_path / "x"))
    feeds.append_log(rows, str(tmp_path / "log"), "1")
    feeds.append_log(rows, str(tmp_path / "log"), "2")
    feeds.append_log(rows, str(tmp_path / "log"), "2")
    assert feeds.read_log(spark, str(tmp_path / "log"), "record_id string").count() == 2
    assert feeds.latest_run(spark, str(tmp_path / "log"), "record_id string").count() == 1


def test_registry_precedence(spark, tmp_path):
    (tmp_path / "z.yaml").write_text("zones:\n- {location_id: ZONE-A, name: North Gate, aliases: [zone-b]}\n- {location_id: ZONE-B, name: Pier}\n")
    reg = feeds.read_registry(spark, str(tmp_path / "z.yaml"))
    rows = spark.createDataFrame([("zone_b",), (" north  gate",), ("nowhere",), (None,)], "location_id string")
    got = {r.location_id: (r.resolved_id, r.match_kind) for r in feeds.resolve_locations(rows, reg).collect()}
    assert got == {"zone_b": ("ZONE-B", "canonical_id"), " north  gate": ("ZONE-A", "name"), "nowhere": (None, "unresolved"), None: (None, "unresolved")}


def test_streamed_split_keeps_every_row(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("record_id,source_id,interval_end_local,location_id,metric,value,unit\n1,s,2024-01-01T01:00:00+05:30,A,m,1,u\n2,s,bad,A,m,1,u\n")
    parsed = integrity.parse_feed(feeds.stream_feed(spark, str(tmp_path / "in")), 60, 5.5)
    streams.split_to_end(parsed, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "ckpt"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_normal_sf_udf(spark):
    assert math.isclose(one(spark, special.normal_sf(F.lit(1.0)))[0], 0.158655, abs_tol=1e-6)


def test_interaction_needs_eight_in_each_cell(spark):
    rows = [("A", a, b, math.exp(0.5 * a + 0.2 * b + 0.3 * a * b + 0.01 * (i % 3))) for a in (0, 1) for b in (0, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "location_id string, a int, b int, value double")
    got = patterns.interaction(df, ["location_id"], F.col("a") == 1, F.col("b") == 1).first()
    assert got.effect == pytest.approx(0.3) and got.testable
    got = patterns.interaction(df.filter("not (a = 1 and b = 1)"), ["location_id"], F.col("a") == 1, F.col("b") == 1).first()
    assert not got.testable


def test_level_shifts_reach_every_month(spark):
    months = [f"{y}-{m:02d}" for y in range(1995, 2001) for m in range(1, 13)]
    rows = [(z, m, (10.0 if z == "Z0" and m >= "1999-05" else 5.0) + i % 3) for z in ("Z0", "Z1", "Z2", "Z3") for m in months for i in range(6)]
    got = {r.location_id: r for r in patterns.level_shifts(spark.createDataFrame(rows, "location_id string, month string, value double")).collect()}
    assert got["Z0"].change_point > "1997-12" and got["Z0"].raw_ratio == pytest.approx(11 / 6)
    assert got["Z0"].n_before + got["Z0"].n_after == len(months) * 6


def test_covering_patterns_leaves_none_out(spark):
    n = 150_000
    many = spark.range(n).select(F.col("id").cast("string").alias("pattern_id"), F.concat(F.lit("L"), "id").alias("location_id"), F.lit(1).alias("weekday"), F.lit(None).cast("int").alias("hour"))
    rows = spark.range(0, n, 1500).select(F.concat(F.lit("L"), "id").alias("location_id"), F.lit(1).alias("weekday"), F.lit(7).alias("hour"))
    assert monitoring.covering_patterns(rows, many).filter("pattern_id is not null").count() == 100


def test_covering_patterns_equals_all_pairs(spark):
    random.seed(5)
    some = lambda xs: random.choice([None, *xs])
    rows = [(i, some("AB"), some([0, 1]), some([8, 9])) for i in range(60)]
    scopes = [(str(k), some("ABC"), some([0, 1]), some([8, 9])) for k in range(12)] + [("all", None, None, None)] * 2
    for use in (scopes, scopes[:3], []):
        got = monitoring.covering_patterns(spark.createDataFrame(rows, "id int, location_id string, weekday int, hour int"), spark.createDataFrame(use, "pattern_id string, location_id string, weekday int, hour int"))
        want = []
        for row in rows:
            hit = [p[0] for p in use if all(x is None or x == y for x, y in zip(p[1:], row[1:], strict=True))]
            want += [(row[0], h) for h in hit or [None]]
        key = lambda x: (x[0], x[1] or "")
        assert sorted([(r.id, r.pattern_id) for r in got.collect()], key=key) == sorted(want, key=key)


def test_running_totals_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(statistics, "BUCKET_ROWS", 7)
    random.seed(11)
    rows = [(random.choice("xy"), random.randint(0, 90) / 4, random.random() < 0.4) for _ in range(800)] + [(None, 1.0, True), (None, 2.0, False)]
    df = spark.createDataFrame(rows, "k string, v double, a boolean")
    got = {r.k: r for r in statistics.ks_statistic(df, ["k"], "a", "v").collect()}
    for k in ("x", "y", None):
        one, two = ([v for g, v, a in rows if g == k and a is side] for side in (True, False))
        want = max(abs(sum(v <= x for v in one) / len(one) - sum(v <= x for v in two) / len(two)) for x in one + two)
        assert got[k].ks == pytest.approx(want) and (got[k].first_rows, got[k].second_rows) == (len(one), len(two))
    counts = df.groupBy("k", "v").count()
    ranked, buckets = statistics.running_totals(counts, ["k"], "v", ["count"])
    assert buckets.filter("k = 'x'").count() > 5
    assert ranked.count() == counts.count()


def test_bootstrap_draws_ranks_like_whole_samples(spark, monkeypatch):
    import numpy as np

    for n in (1, 2, 7, 10):
        got = statistics.median_ranks(n, 40_000, np.random.default_rng(1))
        full = np.sort(np.random.default_rng(2).integers(1, n + 1, (40_000, n)), axis=1)
        for k, m in enumerate(((n - 1) // 2, n // 2)):
            assert np.abs(np.bincount(got[:, k], minlength=n + 1) - np.bincount(full[:, m], minlength=n + 1)).max() < 900
        assert abs(got.mean(axis=1).std() - full[:, [(n - 1) // 2, n // 2]].mean(axis=1).std()) < 0.05
    monkeypatch.setattr(statistics, "BUCKET_ROWS", 20)
    rng = np.random.default_rng(3)
    a, b = rng.gamma(3, 4, 301).round(1), rng.gamma(3, 3, 400).round(1)
    rows = [("z", True, float(v)) for v in a] + [("z", False, float(v)) for v in b] + [("one", True, 2.0), (None, True, 6.0), (None, False, 3.0)]
    df = spark.createDataFrame(rows, "location_id string, treated boolean, value double")
    found = statistics.bootstrap_median_ratio(df, ["location_id"], "treated")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {r.location_id: (r.lower, r.upper) for r in found.collect()}
    ratio = np.median(rng.choice(a, (2000, 301)), axis=1) / np.median(rng.choice(b, (2000, 400)), axis=1)
    assert got["z"] == pytest.approx(tuple(np.quantile(ratio, (0.025, 0.975))), rel=0.03)
    assert got["one"] == (None, None) and got[None] == (2.0, 2.0)


def test_explanations_come_from_the_evidence(spark):
    x = obs(spark, [5.0, 5.0, 5.0, 9.0, 8.0, 7.0, 6.0]).withColumns({"weekday": F.lit(0), "hour": F.hour("event_time")})
    x = x.withColumns({"source_id": F.when(F.col("hour") == 3, "s3").when(F.col("hour") == 4, "s4").otherwise("s1"), "location_id": F.when(F.col("hour") == 6, "B").otherwise("A")})
    rain = spark.createDataFrame([(T0 + dt.timedelta(hours=5), 10.0)], "event_time timestamp_ntz, mm double")
    health = spark.createDataFrame([("s1", "ok"), ("s3", "failed"), ("s4", "warning")], "source_id string, status string")
    scopes = spark.createDataFrame([("p", "A", None, 4)], "pattern_id string, location_id string, weekday int, hour int")
    shifts = spark.createDataFrame([("B",)], "location_id string")
    told = {r.observation_id: [e.kind for e in r.explanations] for r in monitoring.explained_by(x, x, rain, health, scopes, shifts).collect()}
    assert told["o0001"] == ["sensor_suspect"] and told["o0003"] == ["sensor_suspect"]
    assert told["o0004"] == ["recurring_pattern", "sensor_suspect"]
    assert told["o0005"] == ["rainfall"] and told["o0006"] == ["level_shift"]


def test_discovered_shifts_need_size_and_an_interval(spark):
    random.seed(2)
    months = [f"2024-{m:02d}" for m in range(1, 9)]
    rows = [(z, m, (14.0 if z == "Z0" and m >= "2024-05" else 10.0) + random.random()) for z in ("Z0", "Z1", "Z2", "Z3") for m in months for _ in range(20)]
    got = patterns.discovered_shifts(spark.createDataFrame(rows, "location_id string, month string, value double")).collect()
    assert [r.location_id for r in got] == ["Z0"] and got[0].lower > 1.2


def test_leakage_probe_takes_every_instant_and_sees_centred_features(spark):
    from pyspark.sql import Window

    series = features.hourly(obs(spark, [float(i) for i in range(100)]))
    at = features.probe_instants(series, 24)
    assert [r.event_time for r in at.orderBy("event_time").collect()] == [T0 + dt.timedelta(hours=24 + 3 * k) for k in range(24)]

    def centred(s):
        w = Window.partitionBy("location_id").orderBy("event_time")
        return features.lag_features(s, (1,)).withColumn("slope", F.lead("value").over(w) - F.lag("value").over(w))

    every = series.filter(F.hour("event_time") < 8).filter(F.col("event_time") < F.lit(T0 + dt.timedelta(days=4))).select("location_id", "event_time")
    assert every.count() == 32
    found = features.leakage_probe(series, centred, every, ["lag_1h", "slope"]).collect()
    assert {(r.feature, r.kind) for r in found} == {("slope", "future_event")} and len(found) == 31  # the first row has no past


def test_leakage_probe_perturbs_late_arrivals(spark):
    rows = obs(spark, [float(i) for i in range(12)]).withColumn("received_time", F.when(F.hour("event_time") == 3, F.lit(T0 + dt.timedelta(hours=9))).otherwise(F.col("received_time")))
    at = rows.filter(F.hour("event_time").isin(4, 10)).select("location_id", "event_time")
    found = features.leakage_probe(rows.select("location_id", "event_time", "received_time", "value"), lambda s: features.lag_features(features.hourly(s), (1,)), at, ["lag_1h"]).collect()
    assert [(r.feature, r.kind, r.event_time.hour) for r in found] == [("lag_1h", "late_arrival", 4)]
