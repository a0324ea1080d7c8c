"""One-pass monitoring, exact attribution, paced replay, model log, event-time episodes."""

import datetime as dt
import itertools
import math
import random
import statistics as plain

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import adaptive, attribution, forecast, monitor, monitoring, output, statistics
from tidewatch.operators.attribution import Node
from tidewatch.sources import feeds, reports
from tidewatch.streaming import replay, streams

# ---- monitoring ----------------------------------------------------------------------------------------------------


def brute_psi(a, b, bins=10):
    if len(a) < 30 or len(b) < 30:
        return None
    edges = np.quantile(a, np.linspace(0, 1, bins + 1))
    edges[0], edges[-1] = -np.inf, np.inf
    if len(np.unique(edges)) < bins:
        return None
    p, q = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-6, None) for x in (a, b))
    return float(((q - p) * np.log(q / p)).sum())


def brute_ks(a, b):
    if len(a) < 30 or len(b) < 30:
        return None
    grid = sorted({*a, *b})
    return max(abs(sum(x <= g for x in a) / len(a) - sum(x <= g for x in b) / len(b)) for g in grid)


@pytest.mark.parametrize("size", [20_000, 13])
def test_every_series_of_every_window_at_once(spark, monkeypatch, size):
    monkeypatch.setattr(statistics, "BUCKET_ROWS", size)
    rng = random.Random(4)
    rows = []
    for i in range(900):
        w = rng.choice([None, 0, 1, 2, 3]) if i > 20 else 4
        shift = 2.0 if w == 2 else 0.0
        rows.append((w, w is None, rng.gauss(shift, 1), None if rng.random() < 0.1 else math.exp(rng.gauss(0, 1)), 7.0, float("nan"), rng.gauss(10, 1), rng.gauss(10 + shift, 1)))
    df = spark.createDataFrame(rows, "w int, ref boolean, a double, b double, flat double, lost double, predicted double, actual double")
    names = ["a", "b", "flat", "lost"]
    gates = monitor.Gates(prediction_psi=0.2, performance_ratio=1.5)
    got = {(r.window, r.subject): r for r in monitor.signals(df, names, F.col("ref"), F.col("w"), gates).collect()}
    ref = [r for r in rows if r[1]]
    for w in range(4):
        mine = [r for r in rows if r[0] == w]
        for name, k in (("a", 2), ("b", 3), ("flat", 4), ("prediction", 6)):
            x, y = ([r[k] for r in part if r[k] is not None] for part in (ref, mine))
            r = got[w, name]
            want = brute_psi(x, y)
            assert (r.statistic, want) == (None, None) if want is None else r.statistic == pytest.approx(want, rel=1e-9), (w, name, r, want)
            assert (r.reference_rows, r.recent_rows) == (len(x), len(y))
            if name != "prediction":
                assert r.ks == pytest.approx(brute_ks(x, y), abs=1e-12) and r.ks_agrees == (want is not None and (r.ks >= 0.1) == (want >= 0.25))
                assert r.status == ("insufficient_data" if want is None else "drifted" if want >= 0.25 else "minor" if want >= 0.1 else "stable")
        error = lambda part: plain.mean(abs(r[6] - r[7]) for r in part)
        assert got[w, "mae"].statistic == pytest.approx(error(mine) / error(ref))
        assert (w, "lost") not in got
    assert got[2, "a"].status == "drifted" and got[2, "mae"].status == "drifted" and got[0, "a"].status != "drifted"
    assert (got[4, "window"].status, got[4, "window"].recent_rows) == ("insufficient_data", len([r for r in rows if r[0] == 4])) and (4, "a") not in got
    silent = {(r.window, r.kind): r.status for r in monitor.signals(df, ["a"], F.col("ref"), F.col("w")).collect()}
    assert silent[0, "prediction"] == silent[0, "performance"] == "insufficient_reference"
    assert monitor.signals(df.limit(0), ["a"], F.col("ref"), F.col("w")).count() == 0


# ---- attribution ---------------------------------------------------------------------------------------------------


def expectation(node, x, known):
    if node.feature is None:
        return node.value
    if node.feature in known:
        return expectation(node.left if x[node.feature] <= node.threshold else node.right, x, known)
    return (node.left.cover * expectation(node.left, x, known) + node.right.cover * expectation(node.right, x, known)) / node.cover


def brute_shapley(trees, x):
    n, out = len(x), []
    value = lambda s: sum(w * expectation(t, x, s) for w, t in trees)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        total = 0.0
        for k in range(n):
            for s in itertools.combinations(rest, k):
                total += math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (value({*s, i}) - value(set(s)))
        out.append(total)
    return value(set()), out


def test_attribution_equals_all_subsets_on_six_inputs(spark):
    """Three features with their flags for missing values are six inputs; contributions add up to the prediction."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        a, b, c = rng.uniform(0, 4), None if rng.random() < 0.2 else float(rng.randint(0, 9)), rng.gauss(0, 1)
        rows.append((i, a, b, c, 3 * a + (b or 20) * (a > 2) + c * c))
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, target double")
    model = forecast.GradientForecaster(["a", "b", "c"], rounds=6, depth=4).fit(df)
    trees = attribution.spark_trees(model.model.stages[-1])
    got = {(r.i, r.feature): r for r in model.attribution(df, ["i"]).collect()}
    predicted = {r.i: r.predicted for r in model.predict(df).collect()}
    assert len(got) == 900
    for i, a, b, c, _ in rows[:40]:
        base, phi = brute_shapley(trees, [a, b or 0.0, c, 0.0, float(b is None), 0.0])
        mine = [got[i, f] for f in "abc"]
        assert [r.contribution for r in mine] == pytest.approx([phi[k] + phi[k + 3] for k in range(3)], abs=1e-9)
        assert mine[0].base_value == pytest.approx(base) and mine[0].predicted == pytest.approx(predicted[i])
        assert sum(r.contribution for r in mine) == pytest.approx(predicted[i] - base, abs=1e-9)


def test_attribution_of_leaves_and_repeated_inputs():
    deep = Node(0, 10, 0, 5.0, Node(0, 4, 0, 2.0, Node(1.0, 1), Node(3.0, 3)), Node(0, 6, 1, 0.0, Node(-2.0, 6), Node(9.0, 0)))
    trees = [(0.5, deep), (2.0, Node(4.0, 10))]
    base, tables = attribution.leaves(trees)
    for x in ([1.0, 0.0], [3.0, 1.0], [5.0, -1.0], [6.0, 1.0], [float("nan"), 0.0]):
        want_base, phi = brute_shapley(trees, x)
        assert base == pytest.approx(want_base)
        if not math.isnan(x[0]):
            assert attribution.shapley(np.array([x]), tables)[0].tolist() == pytest.approx(phi)


# ---- inputs of other places ----------------------------------------------------------------------------------------


def test_rain_of_the_city_is_credited(spark):
    t = dt.datetime(2024, 1, 2)
    hour = lambda k: t - dt.timedelta(hours=k)
    obs = [("z1", "s1", "ZONE", "traffic", hour(1), 5.0), ("c1", "gauge", "CITY", "rain", hour(2), 0.0), ("c2", "gauge", "CITY", "rain", hour(30), 1.0), ("z2", "s2", "ZONE", "rain", hour(2), 1.0), ("c3", "gauge", "CITY", "rain", hour(3), None)]
    df = spark.createDataFrame(obs, "observation_id string, source_id string, location_id string, metric string, event_time timestamp, value double")
    samples = spark.createDataFrame([("ZONE", t), ("ZONE", t)], "location_id string, sample_time timestamp")
    reach = [("lag_1h", "traffic", 1, 1), ("mean_3h", "traffic", 3, 1), ("rain", "rain", 6, 0, "CITY"), ("snow", "snow", 6, 0), ("rain_26h", "rain", 26, 26, "CITY")]
    got = {r.source_id: (r.observations, r.share) for r in output.attributed(df, samples, reach).collect()}
    assert got == {"s1": (1, 0.5), "gauge": (1, 0.5)}
    assert [tuple(r.features) for r in output.missing_inputs(df, samples, reach).collect()] == [("rain_26h", "snow")]


# ---- replay --------------------------------------------------------------------------------------------------------


@pytest.fixture
def numbered(spark, tmp_path):
    """Two files of 60 rows; every seventh row has no number and is refused."""
    for part in (0, 1):
        lines = [f"{part * 60 + k if (part * 60 + k) % 7 else ''},s,2024-01-01T01:00:00+05:30,A,m,{part * 60 + k},km/h" for k in range(60)]
        (tmp_path / f"feed{part}.csv").write_text(",".join(f.name for f in feeds.FEED) + "\n" + "\n".join(lines) + "\n")
    path = str(tmp_path / "numbered")
    replay.number_feed(feeds.read_feed(spark, str(tmp_path / "feed*.csv")), path, F.length(F.trim("record_id")) > 0, block=25)
    return path


def test_replay_goes_by_the_clock_and_goes_on_after_a_stop(spark, numbered, tmp_path):
    clock, out, cp = str(tmp_path / "clock"), str(tmp_path / "out"), str(tmp_path / "cp")
    seen = []
    for now in (1000.0, 1010.0, 1010.0, 1047.4, 5000.0):  # a new query each time: restarted from the checkpoint
        with open(clock, "w") as f:
            f.write(str(now))
        streams.run_available(replay.replay(spark, numbered, interval=2.0, speed=2.0, clock=clock, start=1000.0), out, cp)
        got = spark.read.parquet(out).orderBy("row").collect()
        assert [r.row for r in got] == list(range(len(got)))
        assert [int(r.value) for r in got] == [r.row for r in got]
        good = [r for r in got if r.accepted]
        assert all(r.received_time.timestamp() == 1000 + k + 1 for k, r in enumerate(good))
        seen.append((len(good), len(got)))
    assert [g for g, _ in seen] == [0, 10, 10, 47, 102] and seen[-1][1] == 120
    assert seen[0][1] == 1  # row 0 is refused and waits for nothing
    assert all(x.received_time <= y.received_time for x, y in itertools.pairwise(got))


@pytest.mark.parametrize("limit,rows", [(0, 0), (1, 2), (24, 28), (500, 120)])
def test_replay_limit_counts_accepted_rows(spark, numbered, tmp_path, limit, rows):
    streams.run_available(replay.replay(spark, numbered, limit=limit, start=0.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema("row long, accepted boolean").parquet(str(tmp_path / "out")).collect() if rows else []
    assert len(got) == rows and sum(r.accepted for r in got) == min(limit, 102)


def test_replay_refuses_negative_pace(spark, numbered):
    with pytest.raises(Exception, match="negative"):
        streams.run_available(replay.replay(spark, numbered, interval=-1.0, start=0.0), numbered + "-out", numbered + "-cp")


# ---- adaptive replay -----------------------------------------------------------------------------------------------


def shifted_table(spark):
    """Zone B doubles on 15 January; nine weeks of six-hourly targets."""
    rng, t0, rows = random.Random(2), dt.datetime(2024, 1, 1), []
    for k in range(63 * 4):
        at = t0 + dt.timedelta(hours=6 * k)
        for z in "AB":
            rows.append((z, at, at + dt.timedelta(hours=1), 100 * (2.0 if z == "B" and at >= dt.datetime(2024, 1, 15) else 1.0) + rng.gauss(0, 3)))
    return spark.createDataFrame(rows, "location_id string, sample_time timestamp, target_time timestamp, target double")


def replayed(spark, path, table, **kw):
    windows = (adaptive.TrainingWindow("expanding"), adaptive.TrainingWindow("last_7_days", 7), adaptive.TrainingWindow("last_day", 1))
    policy = adaptive.Policy(windows=windows, rules=monitoring.PromotionRules(20, 0.03, 0.05, 8), protected=("A", "no slice at all"), drift_ratio=1.5, evaluation_hours=120, least_rows=30)
    log, model = adaptive.StepLog(spark, path), adaptive.ZoneMeans()
    champion = {"A": 100.0, "B": 100.0}
    end = adaptive.run(log, table, dt.datetime(2024, 1, 8), dt.datetime(2024, 2, 12), champion, model, policy, scheduled_days=14, **kw)
    return log, end


def test_adaptive_replay_resumes_from_its_log(spark, tmp_path):
    table = shifted_table(spark)
    whole, end = replayed(spark, str(tmp_path / "whole"), table)
    adaptive_arm, scheduled = end.arms["adaptive"], end.arms["scheduled"]
    # The shift of the 15th shows in the step that follows; the short window knows the new level and wins.
    assert adaptive_arm.version == "20240122-last_7_days" and adaptive_arm.retrains == 1 and scheduled.retrains == 2
    judged = whole.candidates().collect()
    assert {c.version for c in judged} == {"20240122-expanding", "20240122-last_7_days"} and all(c.passed for c in judged)
    mae = {(r.arm, r.window): r.mae for r in whole.rows().groupBy("arm", "window").agg(F.avg(F.abs(F.col("predicted") - F.col("target"))).alias("mae")).collect()}
    assert mae["static", 5] > 40 and mae["adaptive", 5] < 10 and mae["adaptive", 1] == mae["static", 1] > 40
    # Broken off twice, once in the middle of a step whose rows are written but not its state.
    path = str(tmp_path / "broken")
    replayed(spark, path, table, stop_after=1)
    log, _ = replayed(spark, path, table, stop_after=3)
    log.save_rows(4, table.limit(1))
    again, last = replayed(spark, path, table)
    assert last == end
    plain_rows = lambda log_: sorted(map(str, log_.rows().select("arm", "window", "version", "location_id", "sample_time", "predicted").collect()))
    assert plain_rows(again) == plain_rows(whole)
    done, same = replayed(spark, path, table)  # nothing is left to do
    assert same == end and plain_rows(done) == plain_rows(whole)


# ---- model log -----------------------------------------------------------------------------------------------------


def test_two_writers_leave_one_champion(spark, tmp_path):
    path = str(tmp_path / "models")
    writers = [reports.StoredRegistry(spark, path) for _ in range(2)]
    writers[0].register("base", rows=5)
    writers[0].promote("base")
    for k, w in enumerate(writers):  # the second has not seen what the first wrote
        w.register(f"v{k}", rows=k)
    with pytest.raises(ValueError):
        writers[0].register("v1")
    # Both promote over the champion that they know of; the file of the change is taken when the second comes.
    taken = writers[1]._put
    calls = []

    def late(seq, rows):
        if not calls:
            writers[0].promote("v0", expected="base")
        calls.append(seq)
        return taken(seq, rows)

    writers[1]._put = late
    with pytest.raises(reports.Conflict):
        writers[1].promote("v1", expected="base")
    assert len(calls) == 1
    writers[1]._put = taken
    writers[1].promote("v1")
    fresh = reports.StoredRegistry(spark, path)
    assert fresh.champion() == "v1" and sum(r["status"] == "champion" for r in fresh.rows.values()) == 1
    assert [(r.version, r.depth) for r in fresh.lineage_table("v1").collect()] == [("v1", 0), ("v0", 1), ("base", 2)]
    assert fresh.rendered("v1").splitlines()[0] == "v1 (champion): rows 1" and "supersedes base (archived): rows 5" in fresh.rendered("v1")
    assert {r.version: r.status for r in fresh.table().collect()} == {"base": "archived", "v0": "archived", "v1": "champion"}


def test_racing_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "models")

    def write(k):
        r = reports.StoredRegistry(spark, path)
        r.register(f"m{k}")
        r.promote(f"m{k}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(6)))
    r = reports.StoredRegistry(spark, path)
    assert len(r.rows) == 6 and r.seq == 12 and sum(x["status"] == "champion" for x in r.rows.values()) == 1
    assert len(r.lineage(r.champion())) == 6


# ---- event-time streams --------------------------------------------------------------------------------------------


def run_files(spark, tmp_path, name, batches, schema, make, out_schema):
    """Batches of rows as files of a stream, one for each trigger; the rows that come out, in order of their batch."""
    source = tmp_path / name
    source.mkdir()
    out = []
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"{name}-cp")).foreachBatch(lambda df, k: out.extend((k, *r) for r in df.collect())).start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{k}"))
            part = next((tmp_path / f"{name}-{k}").glob("part-*.parquet"))
            part.rename(source / f"{k:04d}.parquet")
            q.processAllAvailable()
    finally:
        q.stop()
    return out


@pytest.fixture
def state_store(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_episodes_equal_the_batch_fold_in_any_order(spark, tmp_path, state_store):
    from tidewatch.streaming import episodes

    rng = random.Random(1)
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rows = [(s, day(d), ["prediction"] if rng.random() < 0.6 else [], rng.uniform(1, 3)) for s in ("x", "y") for d in range(12)]
    schema = "stream string, detected_at timestamp, kinds array<string>, magnitude double"
    want = {(r.stream, r.episode_id): (r.onset, r.last_seen, r.closed_at, r.events, round(r.peak, 9), r.candidates) for r in monitoring.episodes(spark.createDataFrame(rows, schema), cooldown_days=2).collect()}
    shuffled = rows[:]
    rng.shuffle(shuffled)
    shuffled.sort(key=lambda r: r[1].day // 4)  # within four days any order
    cuts = [shuffled[k : k + 5] for k in range(0, len(shuffled), 5)] + [[("z", day(90), [], 0.0)], [("z", day(91), [], 0.0)]]
    found = run_files(spark, tmp_path, "evaluations", cuts, schema, lambda s: episodes.stream_episodes(s, cooldown_days=2, late="6 days"), None)
    last = {}
    for _, stream, ident, onset, seen, closed, n, peak, _, raised in sorted(found, key=lambda r: (r[0], r[4])):
        last[stream, ident] = (onset, seen, closed, n, round(peak, 9), raised)
    assert last == want and len(want) >= 4


def test_stream_links_duplicates_to_the_first_received(spark, tmp_path, state_store):
    from tidewatch.streaming import episodes

    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    row = lambda i, zone, at, got: (i, zone, "m", t(at), t(got))
    batches = [[row("b", "A", 1, 9), row("c", "B", 1, 2)], [row("a", "A", 1, 3), row("d", "A", 2, 9)], [row("e", "A", 1, 3)], [row("z", "Z", 900, 900)], [row("y", "Z", 901, 901)]]
    schema = "observation_id string, location_id string, metric string, event_time timestamp, received_time timestamp"
    found = run_files(spark, tmp_path, "observations", batches, schema, episodes.stream_links, None)
    assert {r[1]: (r[2], r[4]) for r in found} == {"a": ("a", 3), "b": ("a", 3), "e": ("a", 3), "c": ("c", 1), "d": ("d", 1)}


# ---- artifacts -----------------------------------------------------------------------------------------------------


def test_artifacts_of_the_latest_finished_run(spark, tmp_path):
    from tidewatch.operators import integrity
    from tidewatch.sources import artifacts

    t = dt.datetime(2024, 1, 1)
    row = lambda i, source, value, at=0: (i, source, "A", "m", "u", 60, "hourly", t + dt.timedelta(hours=at), t, t + dt.timedelta(hours=5), value)
    schema = "observation_id string, source_id string, location_id string, metric string, unit string, duration_minutes int, aggregation_level string, event_time timestamp, source_time timestamp, received_time timestamp, value double"
    obs = spark.createDataFrame([row("a", "s1", 1.0), row("b", "s2", 9.0), row("c", "s1", 4.0, 1), row("d", "s2", 4.1, 1), row("e", "s1", None, 2)], schema)
    bad = spark.createDataFrame([("x", "negative"), ("y", "negative"), ("z", "schema_error")], "observation_id string, quarantine_reason string")
    path = str(tmp_path / "runs")
    reader = artifacts.ArtifactReader(spark, path)
    assert reader.read("unified") is None and {r.available for r in reader.availability().collect()} == {False}
    health = integrity.source_health(obs, F.lit("2024-01-01 03:00:00").cast("timestamp"))
    artifacts.export(obs, bad, health, path, "2024-01-01")
    assert reader.read("unified") is None  # what was looked up is kept
    reader.clear()
    assert {r.observation_id: r.members for r in reader.read("unified").collect()} == {"c": 2, "e": 1}
    group = reader.read("conflicts").first()
    assert [o.observation_id for o in group.observations] == ["a", "b"] and group.spread == 8.0
    q = reader.read("quality").first()
    assert (q.rows_in, q.valid, q.quarantined, q.missing_values, q.accounts_for_every_row) == (8, 5, 3, 1, True)
    assert q.quarantine_by_reason.asDict() == {"negative": 2, "schema_error": 1} and set(q.source_health.asDict()) == {"s1", "s2"}
    artifacts.unified_rows(integrity.place(obs)).write.json(f"{path}/run=2024-01-02/unified")  # not finished: has no quality
    reader.clear()
    assert reader.runs() == ["2024-01-01"]
    notes = {r.artifact: r.note for r in reader.availability().collect()}
    assert notes["unified"] is None and notes["patterns"] == "made by discovery"


def test_late_rows_are_split_off(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t, t + dt.timedelta(hours=48)), (2, t, t + dt.timedelta(hours=49)), (3, t, t - dt.timedelta(hours=1))], "i int, event_time timestamp, received_time timestamp")
    on_time, late = streams.late_split(rows, 48)
    assert sorted(r.i for r in on_time.collect()) == [1, 3] and [r.i for r in late.collect()] == [2]


def test_first_arrivals_of_a_stream(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[("a", "A", t(1)), ("b", "B", t(1))], [("c", "A", t(1)), ("d", "A", t(2))]]
    found = run_files(spark, tmp_path, "arrivals", batches, "observation_id string, location_id string, event_time timestamp", streams.representatives, None)
    assert sorted(r[1] for r in found) == ["a", "b", "d"]


def test_zones_with_bad_coordinates_keep_their_row(spark, tmp_path):
    (tmp_path / "zones.csv").write_text("location_id,latitude,longitude\nA,12.9,80.1\nB,95,80\nC,x,80\nD,12,\n")
    got = {r.location_id: (r.latitude, r.longitude) for r in feeds.read_zones(spark, str(tmp_path / "zones.csv")).collect()}
    assert got == {"A": (12.9, 80.1), "B": (None, None), "C": (None, None), "D": (None, None)}
