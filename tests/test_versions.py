"""Versioned tables, and rules of whole forests."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evenhand.operators import models
from evenhand.sources.versions import VersionedTable

SCHEMA = "id long, region string, day date"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_replace_and_read_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), frame(spark, []).schema)
    assert rows_of(table.read()) == [] and table.version() == 0
    first = [(1, "a", dt.date(2024, 1, 1)), (2, None, None), (2, None, None)]
    assert table.replace(frame(spark, first)) == 1
    assert rows_of(table.read()) == sorted(first, key=repr)
    table.replace(table.read().where("id = 2"))  # from itself
    assert rows_of(table.read()) == first[1:] and rows_of(table.read(1)) == sorted(first, key=repr)
    table.replace(frame(spark, []))
    assert rows_of(table.read()) == [] and table.version() == 3
    with pytest.raises(ValueError):
        table.replace_partitions(frame(spark, first))


def test_partitions_are_replaced_and_others_kept(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), frame(spark, []).schema, ("region", "day"))
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    table.replace(frame(spark, [(1, "a", d1), (2, "a/b=c", d1), (3, None, d2), (4, None, None), (5, "a", d2)]))
    table.replace_partitions(frame(spark, [(6, "a", d1), (7, None, None), (8, "new", d2)]))
    assert [r[0] for r in rows_of(table.read().orderBy("id"))] == [2, 3, 5, 6, 7, 8]
    table.replace_partitions(frame(spark, []))
    assert sorted(r[0] for r in rows_of(table.read())) == [2, 3, 5, 6, 7, 8]


def test_a_job_killed_half_way_leaves_the_old_rows(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), frame(spark, []).schema, ("region",))
    old = [(i, "ab"[i % 2], None) for i in range(20)]
    table.replace(frame(spark, old))

    broken = frame(spark, [(i, "a", None) for i in range(20)]).repartition(4)
    broken = broken.withColumn("id", F.when(F.col("id") == 13, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    for write in (table.replace, table.replace_partitions):
        with pytest.raises(Exception, match="lost"):
            write(broken)
        assert rows_of(table.read()) == sorted(old, key=repr) and table.version() == 1
    # Data written, manifest not: the version does not exist.
    frame(spark, old[:3]).write.parquet(str(tmp_path / "t" / "data" / "2-abandoned"))
    (tmp_path / "t" / "manifest" / "2" / "_temporary" / "0").mkdir(parents=True)
    assert rows_of(table.read()) == sorted(old, key=repr)
    assert table.replace_partitions(frame(spark, [(99, "a", None)])) == 2
    assert rows_of(table.read()) == sorted([(99, "a", None), *[r for r in old if r[1] == "b"]], key=repr)


def test_rules_of_all_leaves_hold_exactly_their_rows(spark):
    rng = random.Random(6)
    rows = [(rng.random(), rng.randint(0, 50), rng.choice("xyz"), int(rng.random() < 0.5)) for _ in range(400)]
    rows = [(a, b, c, int(a > 0.5) if b > 20 else y) for a, b, c, y in rows]
    df = spark.createDataFrame(rows + [(0.2, 3, "x", None)], "a double, b int, c string, approved int")
    model, names = models.forest_fit(df, ("a", "b"), ("c",), numTrees=5, maxDepth=7)
    got = models.leaf_support(df, model, names).collect()
    by_tree = {}
    for r in got:
        by_tree[r["tree"]] = by_tree.get(r["tree"], 0) + r["samples"]
        assert r["depth"] == (len(r["rule"].split(" AND ")) if r["rule"] else 0)
    assert set(by_tree.values()) == {400} and len(by_tree) == 5 and max(r["depth"] for r in got) > 4
    prepared = model.stages[0].transform(df.where("approved IS NOT NULL")).toPandas()
    prepared = prepared.rename(columns={f"f__{i}": f"f {n}" for i, n in enumerate(names)})
    for r in got:
        inside = prepared
        for part in filter(None, r["rule"].split(" AND ")):
            name, op, cut = f"f {part}".rsplit(" ", 2)
            inside = inside[inside[name] <= float(cut)] if op == "<=" else inside[inside[name] > float(cut)]
        assert len(inside) == r["samples"]
        if r["samples"]:
            share = inside["approved"].mean()
            assert r["confidence"] == pytest.approx(max(share, 1 - share))
            assert r["prediction"] == ("Approved" if share > 0.5 else "Rejected")
