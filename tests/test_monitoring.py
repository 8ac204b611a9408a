"""Snapshots, drift, smoothing and the streaming jobs."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from evenhand.operators import drift
from evenhand.streaming import monitor

SNAPSHOT = "window_start timestamp, family string, attribute string, key string, value double"
T0 = dt.datetime(2024, 1, 1)


def day(i):
    return T0 + dt.timedelta(days=i)


def snapshot(spark, rows, windowed=True):
    df = spark.createDataFrame([(day(r[0]), *r[1:]) for r in rows], SNAPSHOT)
    return df if windowed else df.drop("window_start")


def test_statistical_drift_levels_and_missing_groups(spark):
    base = snapshot(spark, [
        (0, "statistical", "overall", "approval_rate", 0.5),
        (0, "share", "race", "a", 0.5), (0, "share", "race", "b", 0.4), (0, "share", "race", "gone", 0.1625),
    ], windowed=False)
    now = snapshot(spark, [
        (1, "statistical", "overall", "approval_rate", 0.4375), (1, "share", "race", "a", 0.625),
        (1, "share", "race", "new", 0.375), (1, "statistical", "overall", "prediction_rate", 0.9),
        (2, "statistical", "overall", "approval_rate", 0.45), (2, "share", "race", "b", 0.5),
    ])
    rows = drift.statistical_drift(now, base).collect()
    got = {(r["window_start"], r["metric"]): (r["baseline"], r["severity"]) for r in rows}
    assert got == {
        (day(1), "approval_rate"): (0.5, "medium"),
        (day(1), "demographic_proportion_race_a"): (0.5, "medium"),
        (day(1), "demographic_proportion_race_new"): (0.0, "high"),
        **({(day(2), "approval_rate"): (0.5, "medium")} if 0.5 - 0.45 > 0.05 else {}),
    }
    single = now.where(F.col("window_start") == day(1)).drop("window_start")
    full = {r["metric"] for r in drift.statistical_drift(single, base, by=(), full=True).collect()}
    assert {"demographic_proportion_race_gone", "demographic_proportion_race_b"} <= full
    with pytest.raises(ValueError):
        drift.statistical_drift(now, base, full=True)
    assert drift.all_drift(now, base.limit(0)).isEmpty()


def test_fairness_drift_needs_both_sides(spark):
    base = snapshot(spark, [(0, "fairness", "race", "m", 0.0), (0, "fairness", "race", "k", 0.0)], windowed=False)
    now = snapshot(spark, [(1, "fairness", "race", "m", 0.125), (1, "fairness", "race", "k", 0.25), (1, "fairness", "race", "new", 1.0)])
    got = {r["metric"]: r["severity"] for r in drift.fairness_drift(now, base).collect()}
    assert got == {"m": "medium", "k": "high"}


def test_summary_ranks_severities_instead_of_spelling_them(spark):
    drifts = spark.createDataFrame(
        [(T0, "statistical_drift", "high"), (T0, "statistical_drift", "medium"), (T0, "fairness_drift", "medium")],
        "window_start timestamp, type string, severity string",
    )
    summary = drift.drift_summary(drifts)
    assert {(r["type"], r["n_drifts"], r["severity"]) for r in summary.collect()} == {("statistical_drift", 2, "high"), ("fairness_drift", 1, "medium")}
    alert = drift.drift_alerts(summary).collect()
    assert [r["message"] for r in alert] == ["statistical_drift detected: Statistical drift detected in 2 metrics"]


@pytest.mark.parametrize("alpha", [0.1, 0.9])
def test_smoothing_equals_the_recurrence(spark, alpha):
    values = [((i * 37) % 101) / 101 for i in range(900)]
    rows = [(i, "statistical", "overall", "approval_rate", v) for i, v in enumerate(values)]
    got = [r["baseline"] for r in drift.ewma_baseline(snapshot(spark, rows), alpha).orderBy("window_start").collect()]
    want, b = [], None
    for v in values:
        b = v if b is None else alpha * v + (1 - alpha) * b
        want.append(b)
    assert got == pytest.approx(want, abs=1e-12)


def test_each_window_meets_the_baseline_before_it(spark):
    rows = [(i, "statistical", "overall", "approval_rate", v) for i, v in enumerate([0.5, 0.5, 0.7, 0.52])]
    rows += [(i, "share", "race", "a", v) for i, v in enumerate([0.5, 0.58, 0.62, 0.9])]
    rows += [(i, "share", "race", "late", v) for i, v in ((2, 0.2), (3, 0.05))]
    got = {(r["window_start"], r["metric"]): r["baseline"] for r in drift.drift_vs_previous(snapshot(spark, rows)).collect()}
    assert got == {
        (day(2), "approval_rate"): pytest.approx(0.5),
        (day(2), "demographic_proportion_race_a"): 0.5,
        (day(2), "demographic_proportion_race_late"): 0.0,
        (day(3), "demographic_proportion_race_a"): 0.5,
    }


def test_report_covers_the_last_days(spark):
    rows = [(day(i), t, s) for i, t, s in ((0, "DRIFT_DETECTED", "high"), (5, "DRIFT_DETECTED", "critical"), (9, "PERFORMANCE_DEGRADATION", "high"))]
    alerts = spark.createDataFrame(rows, "window_start timestamp, type string, severity string")
    assert tuple(drift.monitoring_report(alerts, days=7).first()) == (2, 1, 1, 1)
    assert tuple(drift.monitoring_report(alerts, days=7, until=day(5)).first()) == (2, 1, 2, 0)
    assert {tuple(r) for r in drift.alert_counts(alerts, days=7).collect()} == {("DRIFT_DETECTED", "critical", 1), ("PERFORMANCE_DEGRADATION", "high", 1)}


def test_snapshot_of_one_batch(spark):
    rows = [("a", 700, 0.9, 1, 1), ("a", 600, 0.4, 0, 0), ("b", 700, 0.9, 1, 1), (None, 700, 0.2, 1, 0), ("b", 700, 0.9, None, 1)]
    df = spark.createDataFrame(rows, "race string, credit_score int, predicted_probability double, predicted int, approved int")
    got = {(r["family"], r["attribute"], r["key"]): r["value"] for r in drift.window_snapshots(df, ["race"], by=()).collect()}
    assert got["sample", "overall", "sample_size"] == 4
    assert got["statistical", "overall", "approval_rate"] == 0.5
    assert got["statistical", "overall", "prediction_rate"] == 0.75
    assert (got["share", "race", "a"], got["share", "race", "b"]) == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert got["performance", "overall", "accuracy"] == 0.75
    assert got["fairness", "race", "four_fifths_rule"] == 0.5


EVENT = "ts timestamp, kind string"


def write_batches(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def counts(df, **options):
    return monitor.windowed_counts(df, "ts", ["kind"], {"n": F.lit(1)}, "1 day", **options)


def test_stream_equals_table(spark, tmp_path):
    write_batches(spark, f"{tmp_path}/in", [[(day(i % 6), "ab"[i % 2])] * 3 for i in range(12)])
    table = spark.read.parquet(f"{tmp_path}/in")
    stream = monitor.table_stream(spark, f"{tmp_path}/in", "*.parquet", table.schema)
    everything = sorted(map(tuple, counts(table).collect()))
    complete = monitor.drain_complete(counts(stream), f"{tmp_path}/complete")
    assert sorted(map(tuple, complete.collect())) == everything
    closed = monitor.drain_append(counts(stream, delay="1 day"), f"{tmp_path}/append")
    assert sorted(map(tuple, closed.collect())) == [r for r in everything if r[1] <= day(5) - dt.timedelta(days=1)]


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    batches = [[(day(10), "a")], [(day(11), "a")], [(day(1), "a"), (day(9), "a")], [(day(30), "a")]]
    write_batches(spark, f"{tmp_path}/in", batches)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = monitor.table_stream(spark, f"{tmp_path}/in", "*.parquet", schema, files_per_batch=1)
    got = monitor.drain_append(counts(stream, delay="2 days"), f"{tmp_path}/out")
    assert sorted(r["window_start"] for r in got.collect()) == [day(9), day(10), day(11)]


def test_sessions_split_at_the_gap(spark):
    minutes = [0, 20, 49, 80, 81]
    df = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), "a") for m in minutes], EVENT)
    got = monitor.session_counts(df, "ts", ["kind"], {"n": F.lit(1)}, "30 minutes").orderBy("window_start").collect()
    assert [r["n"] for r in got] == [3, 2]


def feed(spark, folder, share):
    rows = [("a" if i % 10 < share else "b", 700, 0.9, 1, i % 2) for i in range(100)]
    schema = "race string, credit_score int, predicted_probability double, predicted int, approved int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).schema


def test_monitor_survives_restarts_and_repeated_batches(spark, tmp_path):
    watcher = monitor.DriftMonitor(str(tmp_path), ["race"])
    for share in (5, 5, 9):
        schema = feed(spark, f"{tmp_path}/feed", share)
        watcher.run(monitor.table_stream(spark, f"{tmp_path}/feed", "*.parquet", schema))
    alerts = watcher.alerts(spark).collect()
    assert [(r["batch_id"], r["drift"], r["severity"]) for r in alerts] == [(2, "statistical_drift", "high")]
    last = spark.read.parquet(sorted(glob.glob(f"{tmp_path}/feed/*.parquet"), key=lambda f: __import__("os").path.getmtime(f))[-1])
    before = sorted(map(str, watcher.baselines(spark).collect()))
    watcher.process(last, 2)
    assert watcher.alerts(spark).count() == 1
    assert sorted(map(str, watcher.baselines(spark).collect())) == before
    watcher.process(last.limit(0), 3)
    assert watcher.alerts(spark).count() == 1


def test_stream_smoothing_matches_the_table_form(spark):
    values = [0.5, 0.7, 0.2]
    rows = [(i, "statistical", "overall", "approval_rate", v) for i, v in enumerate(values)]
    rows += [(i, "share", "race", "a", v) for i, v in enumerate(values)]
    table = snapshot(spark, rows)
    state = None
    for i in range(3):
        state = monitor.smoothed(state, table.where(F.col("window_start") == day(i)))
    got = {r["family"]: r["value"] for r in state.collect()}
    final = drift.ewma_baseline(table).where((F.col("window_start") == day(2)) & (F.col("family") == "statistical"))
    assert got["statistical"] == pytest.approx(final.first()["baseline"])
    assert got["share"] == 0.5
