"""Normalisation, feature specs, publication, drift decisions, replays and explanations on small hand-made frames."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions import special
from tidewatch.operators import adaptation, evaluation, features, forecast, integrity, monitoring, normalise, output, patterns, statistics
from tidewatch.sources import feeds, reports

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return dt.timedelta(hours=n)


def test_unit_table(spark):
    cases = [("veh/h", "vehicles/hour", 1.0), (" KMPH ", "m/s", 1 / 3.6), ("vehicles/5min", "vehicles/hour", 12.0), ("vehicles/day", "vph", 1 / 24), ("in", "mm", 25.4), ("feet", "m", 0.3048), ("%", "fraction", 0.01), ("mm", "km", None), ("furlong", "m", None)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = rows.select(C.convert(F.lit(1.0), F.col("a"), F.col("b")).alias("v"), C.compatible(F.col("a"), F.col("b")).alias("ok")).collect()
    for r, (_, _, want) in zip(got, cases, strict=True):
        assert r.v == (None if want is None else pytest.approx(want)) and r.ok == (want is not None)


KEYED = "observation_id string, source_id string, location_id string, metric string, unit string, duration_minutes int, aggregation_level string, event_time timestamp_ntz, source_time timestamp_ntz, received_time timestamp_ntz, value double"


def test_any_part_of_the_key_separates(spark):
    base = ["s", "A", "m", "vehicles/hour", 60, "hourly", T0, T0, T0, 1.0]
    other = [base, base] + [[*base[:i], x, *base[i + 1 :]] for i, x in ((1, "B"), (2, "n"), (3, "vehicles/15min"), (4, 15), (4, None), (5, "daily"), (6, T0 + hours(1)))]
    rows = spark.createDataFrame([(f"o{i}", *r) for i, r in enumerate(other + [[*base[:4], None, *base[5:]]])], KEYED)
    got = sorted(r.members for r in integrity.key_groups(rows).collect())
    assert got == [1] * 6 + [2, 2]  # the equal rows, and the two without duration
    assert integrity.place(rows).count() == rows.count()


def test_metric_names_fold_separators_only(spark):
    metrics = spark.createDataFrame([("traffic_volume", ["veh count"], "vehicles/hour", ["vph"], 0.0, 100.0, True), ("veh_count", None, "ratio", None, None, None, None)], "metric string, aliases array<string>, canonical_unit string, accepted_units array<string>, minimum double, maximum double, non_negative boolean")
    rows = spark.createDataFrame([(" Traffic-Volume",), ("VEH COUNT",), ("traffic  volume",), (None,)], "metric string")
    got = [r.canonical_metric for r in normalise.resolve_metrics(rows, metrics).collect()]
    assert sorted(got, key=str) == sorted(["traffic_volume", "veh_count", None, None], key=str)


def test_first_failure_and_original_value(spark):
    metrics = spark.createDataFrame([("m", [], "vehicles/hour", ["vph", "vehicles/15min"], 0.0, 500.0, True)], "metric string, aliases array<string>, canonical_unit string, accepted_units array<string>, minimum double, maximum double, non_negative boolean")
    rows = [("ok", "m", "vph", 5.0), ("conv", "m", "vehicles/15min", 10.0), ("unit", "m", "mm", 5.0), ("not accepted", "m", "vehicles/minute", 1.0), ("high", "m", "vehicles/15min", 200.0), ("null", "m", "vph", None), ("other", "rain", "furlong", 7.0)]
    df = spark.createDataFrame([(*r, T0, T0 + hours(3)) for r in rows], "observation_id string, metric string, unit string, value double, event_time timestamp_ntz, received_time timestamp_ntz")
    valid, bad = normalise.normalised(normalise.resolve_metrics(df, metrics))
    v = {r.observation_id: r for r in valid.collect()}
    assert {r.observation_id: r.reason for r in bad.collect()} == {"unit": "unknown_unit", "not accepted": "unknown_unit", "high": "invalid_value"}
    assert (v["conv"].value, v["conv"].original_value, v["conv"].original_unit) == (40.0, 10.0, "vehicles/15min")
    assert v["ok"].original_unit is None and v["null"].value is None and v["other"].unit == "furlong" and not v["other"].metric_known
    assert v["ok"].recency == "recent" and v["ok"].arrival_lag_seconds == 10800
    assert set(v) | {r.observation_id for r in bad.collect()} == {r[0] for r in rows}
    q = normalise.quarantine_rows(bad, F.col("reason"), F.col("detail"), "units", "observation_id") if "source_id" in bad.columns else normalise.quarantine_rows(bad.withColumn("source_id", F.lit("s")), F.col("reason"), F.col("detail"), "units", "observation_id")
    assert any('"value":200.0' in r.raw_payload and r.quarantine_id == "QTN-invalid_value-high" for r in q.collect())


def test_canonical_rows_and_origin(spark):
    feed = spark.createDataFrame([("7", "s", "2024-01-01T01:00:00+00:00", "A", "m", "1.5", "vph")], feeds.FEED)
    got = normalise.canonical_rows(integrity.parse_feed(feed, 60, 0.0), "sensor", 60, F.lit(T0)).first()
    assert (got.observation_id, got.status, got.aggregation_level, got.duration_minutes, got.value) == ("OBS-7", "pending", "hourly", 60, 1.5)
    assert got.provenance.origin == "s" and got.attributes["value"] == "1.5" and got.attributes["source_metric"] == "m"
    r = spark.range(1).select(normalise.origin(F.lit("feed"), F.lit("Report"), F.lit(3), F.lit("Summary"), F.lit("table"), F.lit(0.9)).alias("a"), normalise.origin(F.lit("feed"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")).alias("b")).first()
    assert r.a == "Report page 3 section Summary (table, confidence 90%)" and r.b == "feed"


def test_union_first_and_counts(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "observation_id string, v int"), spark.createDataFrame([("y", 9), ("z", 3), ("z", 4)], "observation_id string, v int")
    assert sorted((r.observation_id, r.v) for r in normalise.union_first(a, b).collect()) == [("x", 1), ("y", 2), ("z", 3)]
    assert tuple(normalise.disjoint(a, b).first()) == (False, 1) and tuple(normalise.disjoint(a, b.filter("observation_id = 'z'").limit(1)).first()) == (True, 0)
    assert {r.observation_id: r.rows for r in normalise.counts_by(b, "observation_id", ["z", "q"]).collect()} == {"z": 2, "q": 0}


# features


def test_specs_refuse_the_future():
    config = {"target_metric": "m", "horizon_hours": 2, "calendar": ["hour"], "lags": [1], "seasonal_lags": [24], "rolling_means": [3], "covariates": [{"metric": "rain", "location": "CITY", "window_hours": 24}], "include_zone": True}
    specs = {s.name: s for s in features.feature_specs(config)}
    assert list(specs) == ["hour", "lag_1h", "seasonal_lag_24h", "roll_mean_3h", "rain_roll_24h", "zone"]
    assert specs["seasonal_lag_24h"].offset_hours == 22 and specs["roll_mean_3h"].reach_hours == 3
    for bad in ({"seasonal_lags": [1]}, {"lags": ["x"]}, {"calendar": ["moon"]}, {"covariates": [{"metric": "x"}]}, {"lags": [1, 1]}):
        with pytest.raises(ValueError):
            features.feature_specs({"target_metric": "m", "horizon_hours": 2} | bad)


def test_declared_features_end_at_the_sample(spark):
    series = [("A", "m", T0 + hours(h), float(h)) for h in range(40) if h != 30] + [("CITY", "rain", T0 + hours(h), h / 10) for h in range(40)]
    df = spark.createDataFrame(series, "location_id string, metric string, event_time timestamp_ntz, value double")
    specs = features.feature_specs({"target_metric": "m", "lags": [1], "seasonal_lags": [24], "rolling_means": [3], "covariates": [{"metric": "rain", "location": "CITY"}], "include_zone": True})
    got = {(r.target_time - T0).seconds // 3600 + 24 * (r.target_time - T0).days: r for r in features.build_features(df, specs, "m").collect()}
    assert len(got) == 39 and got[35].lag_1h == 33.0 and got[35].seasonal_lag_24h == 11.0 and got[35].roll_mean_3h == 33.0 and got[35].rain_0h == 3.4
    assert got[32].lag_1h is None and got[31].roll_mean_3h == 28.5 and got[0].lag_1h is None and got[0].zone == 0
    missing = {r.feature: r.missing for r in features.missing_counts(features.build_features(df, specs, "m"), ["lag_1h", "seasonal_lag_24h"]).collect()}
    assert missing == {"lag_1h": 3, "seasonal_lag_24h": 24}
    with pytest.raises(ValueError):
        features.series_index(df.unionByName(df.limit(1)))


def test_stretches_of_time_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([("A", T0 + hours(h), rng.random() if rng.random() < 0.8 else None) for h in range(400) if rng.random() < 0.9], "location_id string, event_time timestamp_ntz, value double")
    get = lambda: sorted(map(tuple, features.rolling_features(features.lag_features(df, (1, 24, 168)), (3, 24, 168)).collect()))
    whole = get()
    monkeypatch.setattr(features, "BUCKET_DAYS", 2)
    assert [(r[:2], r[3:6]) for r in get()] == [(r[:2], r[3:6]) for r in whole]
    assert all(a == b or a == pytest.approx(b) for x, y in zip(get(), whole, strict=True) for a, b in zip(x[6:], y[6:], strict=True))


def test_monitorable():
    specs = [features.FeatureSpec("a", "lag", 1, 0, "m"), features.FeatureSpec("wide", "rolling", 0, 168, "m"), features.FeatureSpec("rain_0h", "covariate", 0, 0, "rainfall", "CITY")]
    kept, out = monitoring.monitorable(specs, ["a", "wide", "rain_0h", "none"], 168)
    assert kept == ["a"] and set(out) == {"wide", "rain_0h", "none"}


# publication


def test_prediction_records(spark):
    scored = spark.createDataFrame([("A", T0, 100.0), ("A", T0 + hours(1), 20.0), ("B", T0, 50.0), ("A", T0 + hours(2), None)], "location_id string, target_time timestamp_ntz, predicted double")
    limits = spark.createDataFrame([("A", 80.0)], "location_id string, threshold double")
    spans = spark.createDataFrame([("A", 10, -30.0, 30.0), ("B", 10, -5.0, 5.0)], "location_id string, rows long, lower_offset double, upper_offset double")
    got = {(r.location_id, r.target_time.hour): r for r in output.predictions(scored, limits, spans, 20.0, "v1", 5.5).collect()}
    a = got["A", 0]
    assert a.probability == pytest.approx(0.5 * math.erfc(-1 / math.sqrt(2))) and a.severity == "moderate" and not a.calibrated and a.confidence == pytest.approx(0.4)
    assert got["A", 1].interval_lower == 0.0 and got["A", 1].confidence == 0.0
    assert got["B", 0].probability is None and got["B", 0].severity == "low" and got["A", 2].interval_lower is None
    assert a.prediction_id == "v1:A:2024-01-01T00:00:00" and a.local_time.hour == 5


def test_calibration_report(spark):
    rows = spark.createDataFrame([(0.9, 0.7, True)] * 7 + [(0.9, 0.7, False)] * 3 + [(0.1, 0.2, False)] * 8 + [(0.1, 0.2, True)] * 2, "raw double, cal double, y boolean")
    got = evaluation.calibration_report(rows, "raw", "cal", "y", 0.4, "validation", "validation").first()
    assert got.improved and got.beats_base_rate and got.direction == "well matched" and got.in_sample and got.base_rate_shift == pytest.approx(-0.05)
    assert evaluation.calibration_report(rows, "cal", "raw", "y").first().direction in ("over-confident", "under-confident", "well matched")


def test_zone_risk_keeps_both_sides(spark):
    o = spark.createDataFrame([("A", 0.5, 2.0, True), ("A", 0.7, 4.0, False), ("B", None, 1.0, None)], "location_id string, probability double, error double, congested_actual boolean")
    z = spark.createDataFrame([("A", 1.0), ("C", 2.0)], "location_id string, latitude double")
    got = {r.location_id: (r.risk, r.mae, r.predictions, r.congested_hours, r.latitude) for r in output.zone_risk(o, z).collect()}
    assert got["A"] == (pytest.approx(0.6), 3.0, 2, 1, 1.0) and got["B"][0] is None and got["C"] == (None, None, 0, 0, 2.0)


def test_attribution_counts_once(spark):
    obs = spark.createDataFrame([(f"o{h}", "s1" if h % 2 else "s2", "A", "m", T0 + hours(h), 1.0 if h != 20 else None) for h in range(40)], "observation_id string, source_id string, location_id string, metric string, event_time timestamp_ntz, value double")
    s = spark.createDataFrame([("A", T0 + hours(25))], "location_id string, sample_time timestamp_ntz")
    got = {r.source_id: r.observations for r in output.attributed(obs, s, [("a", "m", 24, 0), ("b", "m", 1, 1), ("c", "rain", 3, 0)]).collect()}
    assert got == {"s1": 13, "s2": 11}


# decisions


def table(spark, n=24 * 30, zones="AB"):
    rng = random.Random(4)
    rows = [(z, T0 + hours(h + 1), T0 + hours(h), 100.0 + 20 * (h % 24 in (8, 18)) + (60 if h > 24 * 14 else 0) + rng.random()) for z in zones for h in range(n)]
    return spark.createDataFrame(rows, "location_id string, target_time timestamp_ntz, sample_time timestamp_ntz, target double")


def test_windows_at_a_decision(spark):
    t, d = table(spark, zones="A"), "2024-01-10 00:00:00"
    assert adaptation.available_at(t, d).agg(F.max("target_time")).first()[0] == dt.datetime(2024, 1, 9, 23)
    assert adaptation.training_window(t, d, 2).agg(F.min("sample_time")).first()[0] == dt.datetime(2024, 1, 8)
    assert adaptation.evaluation_window(t, d, 24, 48).count() == 48
    b = adaptation.scenario_bounds(t, 7, 7).first()
    assert (b.train_end.day, b.reference_end.day) == (8, 15)
    with pytest.raises(adaptation.TooFewRows):
        adaptation.train_challenger(t, d, adaptation.zone_means, least=5000)


def test_slice_names():
    found, rest = adaptation.parse_slices(["ZONE-A", "ZONE-B Fri 18-20", "ZONE-B Mon 1-2", "two words", ""])
    assert list(found) == ["ZONE-A", "ZONE-B Fri 18-20"] and len(rest) == 3


def test_replay_scores_before_it_acts(spark):
    t = table(spark)
    champion = adaptation.zone_means(adaptation.available_at(t, "2024-01-08"))
    asked = []

    def drifted(at, serving):
        asked.append(at)
        return at >= dt.datetime(2024, 1, 22)

    scored, arms, _ = adaptation.replay(t, dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 29), champion, adaptation.zone_means, 7, 7, drifted, lambda at, a, b: True, least=100)
    by = {a.name: a for a in arms}
    assert by["static"].retrains == 0 and by["adaptive"].retrains == 2 and by["scheduled"].retrains == 3 and len(asked) == 4
    mae = {(r.arm, r.window): r.e for r in scored.groupBy("arm", "window").agg(F.avg(F.abs(F.col("predicted") - F.col("target"))).alias("e")).collect()}
    assert mae["adaptive", 2] == pytest.approx(mae["static", 2])  # the window ahead was scored before the new model was taken
    assert mae["adaptive", 3] < mae["static", 3] and mae["scheduled", 0] == pytest.approx(mae["static", 0])
    rows = {r.arm: r.n for r in scored.groupBy("arm").agg(F.count("*").alias("n")).collect()}
    assert len(set(rows.values())) == 1
    s = adaptation.score_arms(scored.withColumnRenamed("target", "actual"), spark.createDataFrame([("A", 130.0), ("B", 130.0)], "location_id string, threshold double"), sigma=20.0)
    assert adaptation.summarise_arms(s).filter("rank = 1").first().arm in ("adaptive", "scheduled")
    seeds = adaptation.run_seeds([1, 2], lambda k: s.withColumn("mae", F.col("mae") + k))
    assert {r.seeds for r in adaptation.summarise_arms(seeds).collect()} == {2}


def test_registry_is_read_back(spark, tmp_path):
    r = reports.StoredRegistry(spark, str(tmp_path / "models"))
    for v in ("a", "b", "c"):
        r.register(v, rows=5)
    r.promote("a")
    r.promote("b")
    r.reject("c")
    again = reports.StoredRegistry(spark, str(tmp_path / "models"))
    assert again.rows == r.rows and again.champion() == "b" and again.lineage("b") == ["b", "a"] and again.rows["a"]["rows"] == 5
    assert output.selected(again.table(), status="champion").count() == 1
    assert adaptation.version_name("v1", 2, T0, "expanding") == "v1.2-20240101-expanding"


def test_report_store(spark, tmp_path):
    store = reports.ReportStore(spark, str(tmp_path / "r"), "a long, b string")
    assert store.runs() == [] and store.latest().count() == 0
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    store.write(rows, "2024-01-02")
    store.write(rows.limit(1), "2024-01-03")
    store.write(rows.limit(1), "2024-01-03")
    assert store.runs() == ["2024-01-03", "2024-01-02"] and store.latest().count() == 1 and store.read().count() == 3
    assert "| 1 | x |" in reports.markdown(rows, "Title")
    with pytest.raises(ValueError):
        reports.markdown(spark.range(300), "Title")
    assert output.available(a=rows, b=None, c=rows.limit(0)) == {"a": True, "b": False, "c": False}


def test_signals_and_candidates(spark):
    s = [("m", T0, "prediction", "p", "drifted", 0.2, 0.1), ("m", T0, "feature", "f", "drifted", float("nan"), 0.25), ("m", T0 + hours(1), "performance", "mae", "stable", 1.0, 1.1)]
    e = monitoring.fired(spark.createDataFrame(s, "stream string, detected_at timestamp, kind string, subject string, status string, statistic double, threshold double"))
    got = {r.detected_at: r for r in e.collect()}
    assert got[T0].kinds == ["feature", "prediction"] and got[T0].magnitude == pytest.approx(2.0) and got[T0].subject == "p" and not got[T0 + hours(1)].is_drift
    c = monitoring.candidates(monitoring.raised(e), "v1").collect()
    assert [(x.candidate_id, x.champion_version) for x in c] == [("CAND-20240101T000000", "v1")]
    st = spark.range(1).select(*[monitoring.prediction_status(F.lit(p), F.lit(g)).alias(n) for n, p, g in (("a", 0.2, 0.1), ("b", 0.06, 0.1), ("c", 0.01, 0.1), ("d", float("nan"), 0.1), ("e", 0.1, float("nan")))]).first()
    assert tuple(st) == ("drifted", "minor", "stable", "insufficient_data", "insufficient_reference")


# statistics and patterns


def test_tail_functions(spark):
    r = spark.range(1).select(special.t_sf_two_sided(F.lit(2.228139), F.lit(10.0)), special.chi_square_sf(F.lit(11.0705), F.lit(5.0)), special.t_upper_quantile(F.lit(0.975), F.lit(10.0))).first()
    assert r[0] == pytest.approx(0.05, abs=1e-6) and r[1] == pytest.approx(0.05, abs=1e-6) and r[2] == pytest.approx(2.228139, abs=1e-5)


def test_slope_interval_and_trend(spark):
    rng = random.Random(2)
    pts = [("A", float(x), 3 + 0.5 * x + rng.gauss(0, 1)) for x in range(60)] + [("B", float(x), float((-1) ** x)) for x in range(60)]
    df = spark.createDataFrame(pts, "z string, x double, y double")
    got = {r.z: r for r in statistics.slope_test(statistics.slope(df, ["z"], "x", "y")).collect()}
    assert got["A"].lower < 0.5 < got["A"].upper and got["A"].p_value < 1e-6 and got["B"].lower < 0 < got["B"].upper
    series = [("up", i, float(i) + (i % 2) / 10) for i in range(8)] + [("down", i, -float(i)) for i in range(5)] + [("same", i, 1.0) for i in range(5)] + [("short", i, float(i)) for i in range(3)] + [("gaps", i, float(i) if i % 2 else None) for i in range(6)]
    t = {r.p: r for r in statistics.trend(spark.createDataFrame(series, "p string, w int, s double"), ["p"], "w", "s").collect()}
    assert (t["up"].direction, t["down"].direction, t["same"].direction) == ("up", "down", "flat")
    assert t["down"].rho == pytest.approx(-1) and t["same"].p_value == 1.0 and not t["short"].tested and not t["gaps"].tested and t["short"].rho is None


def test_false_discovery_in_buckets(spark, monkeypatch):
    rng = random.Random(3)
    p = [round(rng.random() ** 3, 3) for _ in range(300)]
    order = sorted(range(300), key=lambda i: p[i])
    adjusted, low = [0.0] * 300, 1.0
    for k in range(300, 0, -1):
        low = min(low, p[order[k - 1]] * 300 / k)
        adjusted[order[k - 1]] = low
    for rows in (2000, 20):
        monkeypatch.setattr(statistics, "BUCKET_ROWS", rows)
        df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(1000, None), (1001, float("nan"))], "i int, p double")
        got = {r.i: r.adjusted_p for r in statistics.benjamini_hochberg(df, "p").collect()}
        assert got == {i: pytest.approx(a) for i, a in enumerate(adjusted)}


def test_hotspots_equal_plain_medians(spark):
    import statistics as plain

    rng = random.Random(9)
    rows = [(z, float(rng.randint(0, 30) + (25 if z == "Z3" else 0))) for z in ("Z0", "Z1", "Z2", "Z3") for _ in range(rng.randint(20, 60))] + [("Z0", None)]
    got = {r.location_id: r for r in patterns.hotspots(spark.createDataFrame(rows, "location_id string, value double")).collect()}
    for z in ("Z0", "Z1", "Z2", "Z3"):
        own, rest = [v for k, v in rows if k == z and v is not None], [v for k, v in rows if k != z and v is not None]
        assert (got[z].zone_median, got[z].other_median) == (plain.median(own), plain.median(rest))
    assert got["Z3"].hotspot and not got["Z0"].hotspot


def test_interaction_verdicts(spark):
    rng = random.Random(5)
    rows = [(z, a, b, math.exp(k * a * b + rng.gauss(0, 0.1))) for z, k in (("up", 0.8), ("down", -0.8), ("none", 0.0)) for a in (0, 1) for b in (0, 1) for _ in range(30)] + [("few", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "location_id string, a int, b int, value double")
    got = {r.location_id: r.verdict for r in patterns.interaction_verdict(patterns.interaction(df, ["location_id"], F.col("a") == 1, F.col("b") == 1)).collect()}
    assert got == {"up": "supported", "down": "contradicted", "none": "no_evidence", "few": "untestable"}


def test_planted_patterns_are_discovered(spark):
    rng = random.Random(12)
    rows, months = [], []
    for d in range(240):
        day = T0 + dt.timedelta(days=d)
        wet = d % 5 == 0
        for h in (8, 18, 19):
            for z in ("A", "B", "C"):
                mm = rng.uniform(1, 9) if wet else 0.0
                v = 100 * (2.0 if z == "B" and day.weekday() == 4 and h != 8 else 1.0) * (1.3 if z == "C" and d >= 120 else 1.0) * (1 + 0.03 * mm) * rng.uniform(0.95, 1.05)
                rows.append((z, day + hours(h), day.weekday(), h, v, mm))
                months.append((z, f"{day:%Y-%m}", v))
    df = spark.createDataFrame(rows, "location_id string, event_time timestamp_ntz, weekday int, hour int, value double, wet double")
    found = patterns.discover(df, spark.createDataFrame(months, "location_id string, month string, value double")).collect()
    by = {r.pattern_id: r for r in found}
    assert by["ST-B-4-1820"].hours == [18, 19] and by["ST-B-4-1820"].effect == pytest.approx(2.0, rel=0.15)
    shifts = [r for r in found if r.kind == "level_shift"]
    assert [r.location_id for r in shifts] == ["C"] and shifts[0].pattern_id.startswith("LVL-C-2024-") and all(f"CND-{z}" in by for z in "ABC") and by["CND-A"].effect == pytest.approx(0.03, rel=0.2)
    assert not any(r.descriptive for r in found[: sum(not r.descriptive for r in found)])
    st = patterns.cell_strengths(df.withColumn("month", F.date_format("event_time", "yyyy-MM")), spark.createDataFrame([("ST-B-4-1820", "B", 4, [18, 19])], "pattern_id string, location_id string, weekday int, hours array<int>"))
    t = patterns.tracked(st).first()
    assert t.status == "stable" and t.direction == "flat" and t.windows == 8
    cell = by["ST-B-4-1820"]
    assert 1.5 < cell.lower < cell.upper < 2.5 and shifts[0].lower < shifts[0].effect < shifts[0].upper
    assert {r.kind for r in found} <= set(patterns.KINDS) and [r.pattern_id for r in found] == [r.pattern_id for r in patterns.discover(df, spark.createDataFrame(months, "location_id string, month string, value double")).collect()]
    tests = patterns.discovered_interactions(df, spark.createDataFrame(found)).collect()
    assert [r.pattern_id for r in tests] == [r.pattern_id for r in found if r.kind == "spatiotemporal"] and all(r.verdict in ("supported", "contradicted", "no_evidence", "untestable") for r in tests)
    twice = df.withColumn("value", F.when((F.col("wet") > 0) & (F.col("weekday") == 4) & (F.col("hour") != 8), F.col("value") * 1.5).otherwise(F.col("value")))
    assert patterns.discovered_interactions(twice, spark.createDataFrame(found).filter("pattern_id = 'ST-B-4-1820'")).first().verdict == "supported"



def test_factor_shares_sum_to_one(spark):
    c = spark.createDataFrame([(1, "a", 3.0), (1, "b", -1.0), (1, "c", -2.0), (2, "a", 0.0), (2, "c", 0.0)], "i int, feature string, contribution double")
    f = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "feature string, factor string")
    got = {(r.i, r.factor): (r.contribution, r.share, r["rank"]) for r in forecast.factor_shares(c, f, ["i"]).collect()}
    assert got == {(1, "x"): (2.0, 0.5, 1), (1, "y"): (-2.0, 0.5, 2), (2, "x"): (0.0, 0.0, 1), (2, "y"): (0.0, 0.0, 2)}


def test_suggestions(spark):
    names = spark.createDataFrame([("Nort Gate",), ("Pear",), (None,), ("zzz",)], "name string")
    choices = spark.createDataFrame([("North Gate",), ("North Gates",), ("Pier",), ("Peer",), ("Peart",)], "suggestion string")
    import difflib

    got = {}
    for r in feeds.suggest_locations(names, choices).collect():
        got.setdefault(r.name, []).append((r.suggestion, r.score))
    for n, found in got.items():
        all_ = [(difflib.SequenceMatcher(None, n.lower(), c.lower()).ratio(), c) for c in ("North Gate", "North Gates", "Pier", "Peer", "Peart")]
        want = [(c, s) for s, c in sorted(all_, key=lambda x: (-x[0], x[1])) if s >= 0.6][:3]
        assert sorted(found, key=lambda x: (-x[1], x[0])) == want
    assert set(got) == {"Nort Gate", "Pear"}


def test_isotonic_is_monotone_and_clipped(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(x := rng.random(), rng.random() < x) for _ in range(400)], "raw double, outcome boolean")
    model, floor = evaluation.isotonic(rows)
    got = [r.probability for r in evaluation.calibrated(rows, model, floor).orderBy("raw").collect()]
    assert got == sorted(got) and floor == 3 / 400 and min(got) >= floor and max(got) <= 1 - floor


def test_forecaster_importance_and_occlusion(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(float(i % 10), rng.random(), 5.0 * (i % 10)) for i in range(300)], "signal double, noise double, target double")
    model = forecast.GradientForecaster(["signal", "noise"], rounds=4, depth=3).fit(rows)
    rise = {r.feature: r.importance for r in model.importance(rows, sample=100, repeats=2).collect()}
    assert rise["signal"] > 5 > rise["noise"] >= 0
    one = rows.filter("signal = 9").limit(1).withColumn("i", F.lit(1))
    parts = model.occlusion(one)
    shares = {r.factor: r.share for r in forecast.factor_shares(parts, feeds.factor_table(spark, ["signal", "noise"], {"history": ["sig*"], "other": ["noise"]}), ["i"]).collect()}
    assert shares["history"] > 0.9
    with pytest.raises(ValueError):
        feeds.factor_of("signal", {"a": ["sig*"], "b": ["*nal"]})


def test_settings_and_limited_replay(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nb: 3\n")
    (tmp_path / "prod.yaml").write_text("a: {y: 5}\n")
    assert feeds.load_settings(str(tmp_path), "prod") == {"a": {"x": 1, "y": 5}, "b": 3}
    for bad in ({"a": 1, "c": 2}, {}, {"a": "x"}, {"a": True}):
        with pytest.raises(ValueError):
            feeds.validated(bad, {"a": int})
    table_ = feeds.metric_table(spark, {"metrics": [{"name": "m", "canonical_unit": "vph", "aliases": ["volume"], "plausible_min": 0}]}).first()
    assert (table_.metric, table_.minimum, table_.maximum) == ("m", 0.0, None)
    bands = lambda *x: {"congestion": {"severity_bands": [{"name": n, "min_ratio": m} for n, m in x]}}
    assert feeds.severity_bands(bands(("low", 0), ("high", 1.3))) == [("low", 0.0), ("high", 1.3)]
    with pytest.raises(ValueError):
        feeds.severity_bands(bands(("low", 0), ("high", 1.3), ("odd", 1.3)))
    rules, slices = feeds.promotion_settings({"promotion": {"min_slice_rows": 9, "protected_slices": ["ZONE-A"]}})
    assert monitoring.PromotionRules(**rules).least_slice_rows == 9 and slices == ["ZONE-A"]
    (tmp_path / "zones.csv").write_text("location_id,latitude,longitude\nA,12.5,77\nB,99,77\nC,x,1\n")
    z = {r.location_id: (r.latitude, r.longitude) for r in feeds.read_zones(spark, str(tmp_path / "zones.csv")).collect()}
    assert z == {"A": (12.5, 77.0), "B": (None, None), "C": (None, None)}
    (tmp_path / "feed.csv").write_text("record_id,source_id,interval_end_local,location_id,metric,value,unit\n1,s,t,A,m,1,u\n,s,t,A,m,1,u\n2,s,t,A,m,2,u\n3,s,t,A,m,3,u\n")
    got = [(r.record_id, r.offset_seconds) for r in feeds.stream_limited(spark, str(tmp_path / "feed.csv"), 2, 30.0).orderBy("offset_seconds").collect()]
    assert got == [("1", 0.0), ("2", 30.0)]


def test_sources_fail_on_frozen_runs_and_warn_on_gaps(spark):
    rows = [(f"{s}{h}", s, "A", "m", "u", 60, "hourly", T0 + hours(h), T0, T0, float(h)) for s, gap in (("ok", 0), ("gap", 9), ("hole", 30), ("dead", 0), ("stuck", 0)) for h in [*range(10), *range(10 + gap, 60)] if not (s == "dead" and h > 20)]
    frozen = spark.createDataFrame([("stuck", 7)], "source_id string, length long")
    got = {r.source_id: (r.status, r.reasons) for r in integrity.assessed_sources(spark.createDataFrame(rows, KEYED), frozen, F.lit(T0 + hours(60)).cast("timestamp_ntz"), 1.0).collect()}
    assert got == {"ok": ("ok", []), "gap": ("warning", ["gap"]), "hole": ("warning", ["long_gap"]), "dead": ("failed", ["silent"]), "stuck": ("failed", ["frozen"])}


def test_invariants_on_whole_rows(spark):
    rows = [("a", T0, T0 + hours(1), "valid", None, None), ("b", T0, T0 - hours(1), "valid", None, None), ("c", T0, T0 - hours(1), "quarantined", None, None), ("d", T0 + hours(5), T0 + hours(6), "valid", "", ["d"])]
    df = spark.createDataFrame(rows, "observation_id string, event_time timestamp_ntz, received_time timestamp_ntz, status string, quarantine_reason string, links array<string>")
    got = {r.observation_id: r for r in integrity.row_invariants(df, F.lit(T0 + hours(1)).cast("timestamp_ntz")).collect()}
    assert got["a"].received_after_event and not got["b"].received_after_event and got["c"].received_after_event
    assert not got["d"].not_in_the_future and not got["d"].no_self_link and got["a"].no_self_link
    assert integrity.views(df.withColumns({"source_type": F.lit("historical")}))["clean"].count() == 3
