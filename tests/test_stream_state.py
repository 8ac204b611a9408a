"""Baselines in the state store: order of arrival, restarts, stored beginnings, forgotten keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evenhand.operators import drift
from evenhand.streaming import baseline, monitor

SNAPSHOT = "window_start timestamp, family string, attribute string, key string, value double"
T0 = dt.datetime(2024, 1, 1)


def day(i):
    return T0 + dt.timedelta(days=i)


def rows_of(days, seed=1):
    rng = random.Random(seed)
    rows = [(day(i), "statistical", "overall", "approval_rate", rng.random()) for i in days]
    rows += [(day(i), "share", "race", "a", rng.random()) for i in days]
    return rows + [(day(i), "statistical", "overall", "late_key", rng.random()) for i in days if i > 7]


def deliver(spark, folder, deliveries, make):
    """Writes deliveries one after the other; the stream is started anew for each."""
    out = None
    for rows in deliveries:
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = monitor.table_stream(spark, f"{folder}/in", "*.parquet", spark.createDataFrame([], SNAPSHOT).schema)
        out = baseline.drain_state(make(stream), folder)
    return out


def test_restarts_late_keys_and_order_of_arrival_give_the_batch_result(spark, tmp_path):
    rows = rows_of(range(14))
    rng = random.Random(3)
    shuffled = sorted(rows, key=lambda r: (r[0] + dt.timedelta(days=rng.choice([0, 1, 2]))))
    parts = [shuffled[i : i + 16] for i in range(0, len(shuffled), 16)]
    found = deliver(spark, str(tmp_path), parts, lambda s: baseline.smoothed_stream(s, 0.3, delay="4 days"))
    want = drift.ewma_baseline(spark.createDataFrame(rows, SNAPSHOT), 0.3).collect()
    closed = {tuple(r)[:5]: r["baseline"] for r in want if r["window_start"] <= day(13 - 4)}
    got = {(r["window_start"], *(r[k] for k in ("family", "attribute", "key", "value"))): r["baseline"] for r in found.collect()}
    assert got.keys() == closed.keys() and len(got) > 20
    assert all(got[k] == pytest.approx(closed[k], abs=1e-12) for k in got)
    assert found.count() == len(got)


def test_a_stored_baseline_is_where_keys_begin(spark, tmp_path):
    rows = sorted(rows_of(range(1, 9), 5))
    first = rows_of([0], 6)
    stored = spark.createDataFrame(first, SNAPSHOT).withColumnRenamed("value", "baseline")
    found = deliver(spark, str(tmp_path), [rows[:10], rows[10:]], lambda s: baseline.smoothed_stream(s, 0.5, delay="1 day", initial=stored))
    want = {(r["window_start"], r["key"]): r["baseline"] for r in drift.ewma_baseline(spark.createDataFrame(first + rows, SNAPSHOT), 0.5).collect()}
    got = {(r["window_start"], r["key"]): r["baseline"] for r in found.collect()}
    assert len(got) >= 12 and all(v == pytest.approx(want[k]) for k, v in got.items())


def test_drift_against_the_state_equals_the_batch_drift(spark, tmp_path):
    rows = rows_of(range(12), 9) + [(day(6), "share", "race", "new", 0.4), (day(7), "share", "race", "new", 0.5)]
    initial = spark.createDataFrame([r for r in rows if r[0] == day(0)], SNAPSHOT)
    later = sorted(r for r in rows if r[0] > day(0))
    found = deliver(spark, str(tmp_path), [later[:11], later[11:]], lambda s: baseline.monitored(s, initial, delay="2 days"))
    every = drift.drift_vs_previous(spark.createDataFrame(rows, SNAPSHOT)).where(F.col("window_start") <= F.lit(day(11 - 2)))
    key = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(key, found.select(every.columns).collect())) == sorted(map(key, every.collect())) != []


def test_keys_that_stay_away_begin_anew(spark, tmp_path):
    quiet = [(day(i), "statistical", "overall", "quiet", v) for i, v in ((0, 1.0), (1, 0.0), (20, 8.0), (21, 9.0))]
    busy = [(day(i), "statistical", "overall", "busy", 1.0 + i) for i in range(30)]
    parts = [[r for r in quiet + busy if a <= (r[0] - T0).days < b] for a, b in ((0, 6), (6, 14), (14, 30))]
    found = deliver(spark, str(tmp_path), parts, lambda s: baseline.smoothed_stream(s, 0.5, delay="1 day", forget="5 days"))
    got = {(r["key"], (r["window_start"] - T0).days): (r["previous"], r["baseline"]) for r in found.collect()}
    assert got["quiet", 1] == (1.0, 0.5)
    assert got["quiet", 20] == (None, 8.0) and got["quiet", 21] == (8.0, 8.5)
    assert got["busy", 1] == (1.0, 1.5) and got["busy", 20][0] is not None
