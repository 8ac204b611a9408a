"""Forests grown a tree per task, against Spark's."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evenhand.operators import forest, models

FEATURES = 4


@pytest.fixture(scope="module")
def ready(spark):
    """Rows with one label per cell at times and both at others; the last feature has more values than bins."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, n, 3000) for n in (25, 12, 2, 400)], axis=1).astype(float)
    chance = 1 / (1 + np.exp(2.5 - x[:, 0] / 8 - x[:, 3] / 200))
    rows = [(i, float(rng.random() < p), v.tolist()) for i, (p, v) in enumerate(zip(chance, x, strict=True))]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>").withColumn("test", F.col("id") % 5 == 0)
    return df.withColumn("features", array_to_vector("x")).repartition(3).persist()


def cells(ready):
    rows = ready.drop("features").withColumn("test", F.lit(False))
    cuts = forest.cut_points(rows, FEATURES)
    return cuts, forest.counted(rows, cuts)[0]


@pytest.mark.parametrize(("depth", "least"), [(4, 1), (30, 1), (11, 4)])
def test_a_tree_is_sparks(ready, depth, least, tmp_path):
    cuts, (bins, counts) = cells(ready)
    # Of values that are the bins' numbers Spark makes the same bins.
    number = lambda f, e: F.size(F.filter(F.array(*map(F.lit, e.tolist())), lambda c: c < F.get("x", F.lit(f)))).cast("double")
    numbers = F.array(*[number(f, e) for f, e in enumerate(cuts)])
    binned = ready.select("label", array_to_vector(numbers).alias("features"))
    DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, maxMemoryInMB=1024).fit(binned).write().overwrite().save(str(tmp_path))
    whole = forest.grow(bins, counts, forest.Growth(least, FEATURES, 0), 30, np.random.default_rng(0))
    halves = [np.arange(len(e)) + 0.5 for e in cuts]
    found = {r["id"]: r for r in forest.node_rows(whole, depth, halves).to_pylist()}
    stored = ready.sparkSession.read.parquet(f"{tmp_path}/data").collect()
    assert len(found) == len(stored) > 10
    for r in (r.asDict(True) for r in stored):
        own = found[r["id"]]
        assert all(r[c] == own[c] for c in ("prediction", "impurityStats", "rawCount", "leftChild", "rightChild", "split"))
        assert r["gain"] == pytest.approx(own["gain"])


def test_settings_read_off_larger_forests_are_their_own(ready):
    grid = [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": 2} for n in (3, 12, 25) for d in (2, 5, 0)]
    grid += [{"numTrees": 1, "maxDepth": 3, "minInstancesPerNode": 2}, {"numTrees": 12, "maxDepth": 5, "minInstancesPerNode": 300}]
    rows = ready.select("x", "label", "test")
    together = forest.areas(rows, FEATURES, [models._forest_of(s) for s in grid])
    alone = [forest.areas(rows.repartition(5), FEATURES, [models._forest_of(s)])[0] for s in grid[::4]]
    assert together[::4] == pytest.approx(alone, abs=1e-12) and len(set(together)) == len(grid)


def test_areas_are_those_of_the_stored_model_and_near_sparks(ready):
    setting = {"numTrees": 40, "maxDepth": 6, "minInstancesPerNode": 2}
    train, test = ready.where("not test"), ready.where("test")
    model = forest.grown_forest(train.select("x", "label"), FEATURES, models._forest_of(setting))
    area = lambda m: models.auc(m.transform(test).select("label", F.get(models.vector_to_array("rawPrediction"), F.lit(1)).alias("s")), "label", "s")
    own = forest.areas(ready.select("x", "label", "test"), FEATURES, [models._forest_of(setting)])[0]
    assert own == pytest.approx(area(model), abs=1e-9)
    sparks = models._forest_of(setting).fit(train)
    assert own == pytest.approx(area(sparks), abs=0.02)
    assert model.getNumTrees == 40 and model.totalNumNodes == pytest.approx(sparks.totalNumNodes, rel=0.1)
    assert np.abs(model.featureImportances.toArray() - sparks.featureImportances.toArray()).max() < 0.1
    assert models.tree_nodes(model, ready.sparkSession).select("tree").distinct().count() == 40


def test_bags_hold_each_row_about_once():
    counts = np.array([[1, 5, 0, 2] * 5000, [0, 1, 3, 0] * 5000])
    bag, _ = forest.drawn(counts, 42, 7)
    assert (bag[counts == 0] == 0).all()
    for n in (1, 2, 3, 5):
        drawn = bag[counts == n]
        assert drawn.mean() == pytest.approx(n, rel=0.05) and drawn.var() == pytest.approx(n, rel=0.1)
    assert (forest.drawn(counts, 42, 7)[0] == bag).all() and (forest.drawn(counts, 42, 8)[0] != bag).any()


def test_cuts_of_few_many_and_tied_values(spark):
    rng = np.random.default_rng(1)
    many, tied = rng.random(5000), np.where(rng.random(5000) < 0.6, 7.0, rng.random(5000))
    rows = [([float(i % 3 == 0), 5.0, float(a), float(b)],) for i, (a, b) in enumerate(zip(many, tied, strict=True))]
    few, one, spread, often = forest.cut_points(spark.createDataFrame(rows, "x array<double>").repartition(3), FEATURES)
    assert few.tolist() == [0.5] and not len(one) and len(spread) == 31
    assert np.abs(spread - np.quantile(many, np.arange(1, 32) / 32)).max() < 0.01
    assert 10 <= len(often) <= 14 and often.max() < 7


def test_large_tables_are_searched_without_a_histogram_per_node(spark, monkeypatch):
    """Spark's forest, whose nodes and histograms grow with rows times trees, gets two rows, for the stored form of the best setting."""
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), None if i % 97 == 0 else int(rng.random() < 0.1 + 0.8 * ((a > 0.5) != (b > 0.5)))) for i, (a, b) in enumerate(rng.random((12_000, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, approved int")
    fitted, fit = [], models.RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, rows, *a: fitted.append(rows.count()) or fit(self, rows, *a))
    monkeypatch.setattr(models, "ROWS_A_TASK", 3_000)
    monkeypatch.setattr(models, "SPARK_GROWS", 10_000)
    grid = {"numTrees": (4, 12), "maxDepth": (1, 4, 0), "minInstancesPerNode": (1, 50)}
    runs = [models.tune_by_halving(df.repartition(p), ("a", "b"), "id", grid=grid, shares=(1 / 4, 1.0)) for p in (2, 5)]
    assert fitted == [2, 2]
    first, second = (sorted(map(tuple, found.collect())) for _, found in runs)
    assert first == second and len(first) == 16 and sum(r[-1] for r in first) == 5
    (model, _), (_, _, trees, depth, _, area, _) = runs[0], next(r for r in first if r[0] == 1 and r[-1])
    assert depth != 1 and area > 0.85 and model.stages[-1].getNumTrees == trees
    assert model.transform(df).where("prediction = approved").count() > 9000
