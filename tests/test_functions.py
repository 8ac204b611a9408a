import math

import pytest
from pyspark.sql import functions as F

from evenhand.functions import lending, stats
from evenhand.functions.joins import join_small


def values(df):
    return [tuple(r) for r in df.collect()]


def test_age_band_edges(spark):
    ages = [18, 24, 25, 34, 35, 44, 45, 54, 55, 64, 65, 79, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    bands = [r[0] for r in df.select(lending.age_band(F.col("age"))).collect()]
    assert bands == [
        "18-24", "18-24", "25-34", "25-34", "35-44", "35-44", "45-54", "45-54", "55-64", "55-64", "65+", "65+", None,
    ]


def test_bias_factors_compound_and_clip(spark):
    rows = [("Female", "Black", 20, "Southeast", 0.5), ("Male", "White", 40, "West", 1.4), ("Female", "White", 65, "West", 0.5)]
    df = spark.createDataFrame(rows, "gender string, race string, age int, region string, p double")
    full = [r[0] for r in df.select(lending.biased_probability(F.col("p"))).collect()]
    assert full == pytest.approx([0.5 * 0.85 * 0.75 * 0.8 * 0.85 * 0.9, 1.0, 0.5 * 0.85])
    none = [r[0] for r in df.select(lending.biased_probability(F.col("p"), ())).collect()]
    assert none == pytest.approx([0.5, 1.0, 0.5])
    with pytest.raises(ValueError):
        lending.biased_probability(F.col("p"), ("height",))


def test_turning_a_bias_on_never_raises_a_probability(sample):
    from evenhand.sources.applications import ROLES

    p = F.col("predicted_probability")
    for flag in lending.BIAS_FACTORS:
        raised = sample.where(lending.biased_probability(p, (flag,), ROLES) > lending.biased_probability(p, (), ROLES))
        assert raised.isEmpty(), flag


def test_intersection_key_is_null_with_a_null_part(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "x string, y int")
    assert values(df.select(lending.intersection_key("x", "y"))) == [("a_1",), (None,)]


def test_feature_category_first_match_wins(spark):
    names = ["race_Black", "annual_income", "mortgage", "ZIP_code", "loan_term", "urban_loan", "score", "Debt"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r[0] for r in df.select(lending.feature_category(F.col("f"))).collect()]
    assert got == ["demographic", "financial", "demographic", "geographic", "loan_specific", "geographic", "other", "financial"]


def test_policy_values_keep_null(spark):
    df = spark.createDataFrame([(600, "a"), (700, "c"), (None, None)], "x int, s string")
    up = {"type": "threshold", "value": 650, "direction": "increase"}
    down = {"type": "threshold", "value": 650, "direction": "decrease"}
    rename = {"type": "categorical", "mapping": {"a": "b"}}
    got = values(
        df.select(lending.policy_value(F.col("x"), up), lending.policy_value(F.col("x"), down), lending.policy_value(F.col("s"), rename))
    )
    assert got == [(650, 600, "b"), (700, 650, "c"), (None, None, None)]
    with pytest.raises(ValueError):
        lending.policy_value(F.col("x"), {"type": "other"})


def test_p_value_matches_erfc(spark):
    chis = [0.0, 1e-6, 0.01, 0.5, 1.0, 3.841459, 5.33, 10.83, 53.8, 400.0]
    df = spark.createDataFrame([(c,) for c in chis], "c double")
    got = [r[0] for r in df.select(stats.chi_square_p_value(F.col("c"))).collect()]
    assert got == pytest.approx([math.erfc(math.sqrt(c / 2)) for c in chis], rel=2e-7, abs=1e-12)


def test_yates_caps_the_correction_and_survives_empty_margins(spark):
    df = spark.createDataFrame([(10, 20, 30, 5), (5, 5, 5, 6), (0, 0, 3, 4)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(stats.yates_chi_square(*[F.col(x) for x in "abcd"])).collect()]
    n, det = 65, abs(10 * 5 - 20 * 30)
    assert got[0] == pytest.approx(n * (det - n / 2) ** 2 / (30 * 35 * 40 * 25))
    assert got[1:] == [0.0, 0.0]


def test_key_hash_does_not_overflow(spark):
    df = spark.createDataFrame([(2**62,), (-5,), (0,)], "k bigint")
    got = [r[0] for r in df.select(stats.key_hash(F.col("k"))).collect()]
    assert all(0 <= h < stats.HASH_MODULUS for h in got)


def test_join_small_gives_the_same_rows_on_both_sides_of_the_bound(spark):
    large = spark.range(1000).withColumn("k", F.col("id") % 7)
    small = large.groupBy("k").count()
    within = join_small(large, small, ["k"])
    beyond = join_small(large, small, ["k"], max_rows=3)
    assert sorted(values(within.select("id", "count"))) == sorted(values(beyond.select("id", "count")))
    assert "BroadcastHashJoin" in within._jdf.queryExecution().executedPlan().toString()
