"""Search of forest settings by successive halving."""

import random

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evenhand.operators import models

GRID = {"numTrees": (4, 8), "maxDepth": (1, 3, 6), "minInstancesPerNode": (1, 200)}


def table(spark, count=1500):
    rng = random.Random(2)
    rows = []
    for i in range(count):
        a, b = rng.random(), rng.random()
        rows.append((i, a, b, None if i % 97 == 0 else int((a > 0.5) != (b > 0.5) if rng.random() < 0.9 else rng.random() < 0.5)))
    return spark.createDataFrame(rows, "id long, a double, b double, approved int")


def test_each_rung_keeps_its_best_and_reruns_agree(spark):
    df = table(spark)
    runs = []
    for parts in (2, 3):
        model, found = models.tune_by_halving(df.repartition(parts), ("a", "b"), "id", grid=GRID, shares=(0.25, 1.0), keep=0.25, parallelism=2)
        runs.append(sorted(map(tuple, found.collect())))
    rows = found.collect()
    first, last = ([r for r in rows if r["rung"] == k] for k in (0, 1))
    assert len(first) == 12 and sum(r["kept"] for r in first) == 3 == len(last) and sum(r["kept"] for r in last) == 1
    setting = lambda r: (r["numTrees"], r["maxDepth"], r["minInstancesPerNode"])
    assert {setting(r) for r in first if r["kept"]} == {setting(r) for r in last}
    assert min(r["area_under_roc"] for r in first if r["kept"]) >= max(r["area_under_roc"] for r in first if not r["kept"])
    best = next(r for r in last if r["kept"])
    assert best["maxDepth"] > 1 and best["area_under_roc"] > 0.85  # a tree of one split cannot tell the corners apart
    assert model.stages[-1].getNumTrees == best["numTrees"]
    assert [r[2:5] + r[6:] for r in runs[0] if r[0] == 1 and r[6]] == [r[2:5] + r[6:] for r in runs[1] if r[0] == 1 and r[6]]
    assert model.transform(df).where("prediction = approved").count() > 1200


def test_a_grid_of_one(spark):
    _, found = models.tune_by_halving(table(spark, 300), ("a", "b"), "id", grid={"numTrees": (3,), "maxDepth": (0,)}, shares=(0.5, 1.0))
    assert [(r["rung"], r["maxDepth"], r["kept"]) for r in found.orderBy("rung").collect()] == [(0, 0, True), (1, 0, True)]


def test_a_table_read_by_one_task_is_spread(spark):
    rows = table(spark).coalesce(1).withColumn("_at", F.hash("id"))
    parts = lambda df: df.select(F.spark_partition_id().alias("part")).distinct().count()
    runs = []
    for order in ("id", "b"):
        with models._spread(rows.orderBy(order).coalesce(1), "_at", rows_a_task=300) as spread:
            assert parts(spread) == 5
            runs.append([tuple(r) for r in spread.select(F.spark_partition_id(), "*").collect()])
    assert runs[0] == runs[1] and sorted(r[1] for r in runs[0]) == list(range(1500))
    with models._spread(rows, "_at", rows_a_task=1500) as spread:
        assert parts(spread) == 1


def test_deep_trees_stay_off_the_tasks_and_are_the_same(spark):
    rows = table(spark, 400).dropna().select(F.col("approved").cast("double").alias("label"), array_to_vector(F.array("a", "b")).alias("features"))
    rows = rows.coalesce(1)
    deep = models._forest_of({"numTrees": 3, "maxDepth": 0, "minInstancesPerNode": 1})
    assert deep.getCacheNodeIds() and not models._forest_of({"numTrees": 3, "maxDepth": 5}).getCacheNodeIds()
    text = lambda forest: forest.fit(rows).toDebugString.split("\n", 1)[1]
    assert text(deep) == text(deep.copy().setCacheNodeIds(False))


def test_longest_fits_begin_first_and_keep_their_scores(spark, monkeypatch):
    grid, begun, fit = {"numTrees": (2, 4), "maxDepth": (2, 0)}, [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, *a: begun.append((self.getNumTrees(), self.getMaxDepth())) or fit(self, *a))
    tables = [models.tune_by_halving(table(spark, 300), ("a", "b"), "id", grid=grid, shares=(1.0,), parallelism=p)[1].collect() for p in (1, 3)]
    assert begun[:4] == [(4, 30), (2, 30), (4, 2), (2, 2)]
    assert tables[0] == tables[1] and [(r["numTrees"], r["maxDepth"]) for r in tables[0]] == [(2, 2), (2, 0), (4, 2), (4, 0)]
