"""Measures per segment: areas under the curve, sketches and their merges, accounts of late rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.operators import models, sketches
from evenhand.streaming import late, monitor


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_auc_of_each_segment(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 1), rng.choice([rng.random(), 0.5, 0.25])) for _ in range(1500)]
    rows += [("one class", 1, 0.3), ("one class", 1, 0.9), ("a", None, 0.5), ("a", 1, None), ("a", 1, float("nan")), ("none", None, None)]
    df = spark.createDataFrame(rows, "seg string, approved int, predicted_probability double").repartition(5)
    got = {r["seg"]: r for r in models.auc_by(df, ["seg"], ranges=ranges).collect()}
    assert set(got) == {"hot", "a", None, "one class"}
    for seg, r in got.items():
        mine = [(y, s) for g, y, s in rows if g == seg and y is not None and s is not None and s == s]
        assert (r["n"], r["positives"]) == (len(mine), sum(y for y, _ in mine))
        assert r["area_under_roc"] == (pytest.approx(brute_auc(mine), abs=1e-12) if seg != "one class" else None)
    whole = models.auc_by(df.where("seg = 'hot'"), [], ranges=ranges).first()
    assert whole["area_under_roc"] == pytest.approx(got["hot"]["area_under_roc"], abs=1e-12)
    assert whole["area_under_roc"] == pytest.approx(models.auc(df.where("seg = 'hot'")), abs=1e-12)
    assert models.auc_by(df.limit(0), ["seg"]).isEmpty()


def test_sketches_merge_to_the_sketch_of_everything(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 5, ["x", "y", None][i % 3], float(v)) for i, v in enumerate(rng.normal(3, 50, 2000))]
    rows += [(1, "x", 0.0), (1, "x", -0.0), (1, "y", None), (2, "y", float("nan")), (2, "z", float("inf")), (3, "tiny", 1e-300), (3, "tiny", -1e300)]
    df = spark.createDataFrame(rows, "w int, seg string, v double").repartition(6)
    fine = sketches.sketch(df, ["v"], ["w", "seg"])
    for by in ([], ["w"], ["seg"]):
        merged = sketches.profile(sketches.merge(fine, by), by).collect()
        direct = {tuple(r[k] for k in [*by, "share"]): r for r in sketches.profile(sketches.sketch(df, ["v"], by), by).collect()}
        assert len(merged) == len(direct) > 0
        for r in merged:
            other = direct[tuple(r[k] for k in [*by, "share"])]
            mine = [v for *k, v in rows if v is not None and np.isfinite(v) and all(r[c] == dict(zip(("w", "seg"), k))[c] for c in by)]
            exact = np.quantile(mine, r["share"])
            assert r["n"] == other["n"] == len(mine)
            assert (r["low"], r["high"]) == (other["low"], other["high"])
            slack = 1e-9 * max(1.0, abs(exact))
            assert r["low"] - slack <= exact <= r["high"] + slack
            assert abs(r["estimate"] - exact) <= 0.011 * max(abs(r["low"]), abs(r["high"])) + slack
            if max(map(abs, mine)) < 1e200:
                assert r["mean"] == pytest.approx(np.mean(mine)) and (len(mine) < 2 or r["std"] == pytest.approx(np.std(mine, ddof=1)))


def test_every_row_read_is_accounted_for(spark, tmp_path):
    schema = "ts timestamp, kind string"
    t0 = dt.datetime(2024, 3, 1)
    rng = random.Random(2)
    at = lambda h: t0 + dt.timedelta(hours=h)
    parts = [
        [(at(rng.uniform(0, 100)), "a") for _ in range(50)] + [(at(100), "a"), (None, "b")],
        [(at(h), "b") for h in (99, 77, 76, 75.9, 72, 71.9, 48, 3)],
        [(at(h), "c") for h in (160, 101, 136, 130, 120, 119.9, 24)],
        [(at(10), "d")],
    ]
    split = late.LateSplit(str(tmp_path / "split"), "ts", "1 day", "1 day")
    marks = []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        given = spark.createDataFrame([], schema).schema
        split.run(monitor.table_stream(spark, str(tmp_path / "in"), "*.parquet", given))
        marks.append(split.watermark(spark))
    assert marks == [at(76), at(76), at(136), at(136)]
    expected, mark = [], None
    for i, rows in enumerate(parts):
        for t, kind in rows:
            if t is None:
                status = "dropped"
            elif mark is None or t >= mark:
                status = "on_time"
            else:
                end = t.replace(hour=0, minute=0, second=0, microsecond=0) + dt.timedelta(days=1)
                status = "late" if end > mark else "dropped"
            expected.append((i, t, kind, status))
        mark = marks[i]
    got = [(r["batch_id"], r["ts"], r["kind"], r["status"]) for r in split.rows(spark, given).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert split.side_table(spark, given).count() + split.counted(spark, given).count() == sum(map(len, parts))
    assert {s for *_, s in expected} == {"on_time", "late", "dropped"}


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    split = late.LateSplit(str(tmp_path), "ts", "1 day", "1 day")
    t0 = dt.datetime(2024, 3, 1)
    first = spark.createDataFrame([(t0, "a"), (t0 + dt.timedelta(days=9), "a")], "ts timestamp, kind string")
    second = spark.createDataFrame([(t0, "old"), (t0 + dt.timedelta(days=10), "new")], "ts timestamp, kind string")
    split.process(first, 0)
    for _ in range(2):
        split.process(second, 1)
    got = sorted((r["batch_id"], r["kind"], r["status"]) for r in split.rows(spark, first.schema).collect())
    assert got == [(0, "a", "on_time"), (0, "a", "on_time"), (1, "new", "on_time"), (1, "old", "dropped")]


def test_a_cluster_needs_a_shared_folder():
    from evenhand.session import work_dir

    class Cluster:
        def get(self, name, default):
            return "spark://somewhere:7077" if name == "spark.master" else default

        def getCheckpointDir(self):
            return None

    class Session:
        conf = sparkContext = Cluster()

    with pytest.raises(RuntimeError):
        work_dir(Session(), "x")
