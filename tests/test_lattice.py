"""Subgroup search, its correction, and samples per segment."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evenhand.functions.stats import key_hash
from evenhand.operators import lattice
from evenhand.sources import tables

ATTRIBUTES = ("a", "b", "c", "d", "e", "f")


def people(seed=1, count=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        values = [rng.choice(["x", "y", "z", None][: 2 + i % 3]) for i in range(6)]
        approved = None if rng.random() < 0.02 else int(rng.random() < (0.2 if values[0] == "x" and values[1] == "y" else 0.6))
        rows.append((*values, approved))
    return rows


def brute_force(rows, support, depth=6):
    known = [r for r in rows if r[6] is not None]
    out = {}
    for k in range(1, depth + 1):
        for chosen in itertools.combinations(range(6), k):
            for r in known:
                if all(r[i] is not None for i in chosen):
                    key = tuple(f"{ATTRIBUTES[i]}={r[i]}" for i in chosen)
                    n, a = out.get(key, (0, 0))
                    out[key] = (n + 1, a + r[6])
    return {k: v for k, v in out.items() if v[0] >= support}


@pytest.mark.parametrize(("support", "depth"), [(1, None), (12, None), (40, 2), (10_000, None)])
def test_supported_subgroups_equal_brute_force(spark, support, depth):
    rows = people(support % 7)
    df = spark.createDataFrame(rows, ", ".join(f"{a} string" for a in ATTRIBUTES) + ", approved int").repartition(4)
    got = {tuple(r["group"]): (r["n"], r["approvals"]) for r in lattice.supported(df, ATTRIBUTES, support, depth).collect()}
    assert got == brute_force(rows, support, depth or 6)


def test_hot_combination_and_empty_table(spark):
    df = spark.createDataFrame([("x", "y", 1)] * 3000 + [("x", None, 0)] * 30, "a string, b string, approved int")
    got = {tuple(r["group"]): r["n"] for r in lattice.supported(df, ("a", "b"), 20).collect()}
    assert got == {("a=x",): 3030, ("b=y",): 3000, ("a=x", "b=y"): 3000}
    assert lattice.subgroup_tests(df.limit(0), ("a", "b")).isEmpty()


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_q_values(spark, ranges):
    rng = random.Random(ranges)
    values = [rng.choice([1.0, 0.5, rng.random() ** 3, 1e-9]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, p_value double").repartition(3)
    got = {r["i"]: r["q_value"] for r in lattice.with_q_values(df, ranges=ranges).collect()}
    order = sorted(values)
    for i, p in enumerate(values):
        want = min(1.0, min(q * len(order) / sum(x <= q for x in order) for q in order if q >= p))
        assert got[i] == pytest.approx(want, rel=1e-12)


def test_planted_subgroup_is_flagged(spark):
    df = spark.createDataFrame(people(3, 3000), ", ".join(f"{a} string" for a in ATTRIBUTES) + ", approved int")
    got = {r["subgroup"]: r for r in lattice.subgroup_tests(df, ATTRIBUTES, 60).collect()}
    assert got["a=x & b=y"]["flagged"] and got["a=x & b=y"]["gap"] < -0.2
    assert sum(r["flagged"] for r in got.values()) < len(got) / 2


def test_samples_per_segment_merge(spark):
    rows = [(i, ["hot", "hot", "a", None, "few"][i % 5 if i < 4000 else 0], i * 3) for i in range(4100)] + [(9_000, "one", 1)]
    df = spark.createDataFrame(rows, "id long, seg string, v long")
    got = tables.sample_by(df.repartition(7), 100, "id", ["seg"]).collect()
    again = tables.sample_by(df.repartition(2), 100, "id", ["seg"], salts=3).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)
    hashes = {r["id"]: r["h"] for r in df.select("id", key_hash(F.col("id")).alias("h")).collect()}
    for seg in ("hot", "a", None, "few", "one"):
        mine = sorted((hashes[i], i) for i, s, _ in rows if s == seg)[:100]
        assert sorted(r["id"] for r in got if r["seg"] == seg) == sorted(i for _, i in mine)
    parts = [tables.sample_by(df.where(f"id % 3 = {k}"), 100, "id", ["seg"]) for k in range(3)]
    merged = tables.sample_by(parts[0].unionByName(parts[1]).unionByName(parts[2]), 100, "id", ["seg"])
    assert sorted(merged.collect(), key=repr) == sorted(got, key=repr)
