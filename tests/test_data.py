"""Sources, quality checks, profiles and feature preparation."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from evenhand.operators import prep, profile, quality, quantiles
from evenhand.sources import exports, tables
from evenhand.sources.applications import APPLICATION_SCHEMA


def test_tables_are_found_in_the_standard_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,y"), (2, None)], "a int, b string")
    for fmt in ("csv", "json", "parquet"):
        path = tables.save_table(df, str(tmp_path), f"t.{fmt}", subdir="raw")
        assert path.endswith(f"raw/t.{fmt}")
        back = tables.load_table(spark, str(tmp_path), f"t.{fmt}", df.schema)
        assert sorted(map(tuple, back.collect()), key=str) == [(1, "x,y"), (2, None)]
    assert tables.load_table(spark, str(tmp_path), "t.csv").dtypes == [("a", "int"), ("b", "string")]
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path), "absent.csv")
    for bad in ("t.xlsx", "t"):
        with pytest.raises(ValueError):
            tables.save_table(df, str(tmp_path), bad)


def test_sample_is_repeatable_and_bounded(spark, tmp_path):
    df = spark.range(500).withColumnRenamed("id", "application_id")
    first = {r[0] for r in tables.sample_rows(df, 50, "application_id").collect()}
    again = {r[0] for r in tables.sample_rows(df.repartition(7), 50, "application_id").collect()}
    assert first == again and len(first) == 50
    assert tables.sample_rows(df, 1000, "application_id").count() == 500
    crowded = spark.range(300).select((F.col("id") * 2**40).alias("application_id"), F.lit(1).alias("x"))
    assert tables.sample_rows(crowded, 7, "application_id").count() == 7
    same = spark.range(5000).select(F.lit(2**31).alias("application_id"), F.col("id").alias("x"))
    assert tables.sample_rows(same, 7, "application_id").count() == 7
    empty = tables.load_sample(spark, str(tmp_path), "none.csv", APPLICATION_SCHEMA)
    assert empty.isEmpty() and empty.schema == APPLICATION_SCHEMA


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0.7, 0)], "x int, flag int, p double, approved int")
    flat = exports.flatten_predictions(df, "flag", "p", "approved")
    assert flat.columns == ["x", "prediction", "prediction_probability", "actual", "correct"]
    assert flat.first()["correct"] is False
    for fmt in ("csv", "json"):
        assert spark.read.format(fmt).load(exports.write_export(flat, f"{tmp_path}/{fmt}", fmt)).count() >= 1
    with pytest.raises(ValueError):
        exports.write_export(flat, str(tmp_path), "html")


def test_quality_counters(spark):
    rows = [
        (1, "White", 17, 299, 2.1, 10.0, 11.0, 1, 2, float("nan")),
        (2, "Martian", 101, 851, -0.1, 10.0, 0.0, 1, 90, 1.0),
        (3, None, None, None, None, 10.0, 0.0, 0, 2, 1.0),
        (4, "White", 18, 850, 2.0, 10.0, 10.0, 1, 2, 1.0),
        (4, "White", 18, 850, 2.0, 10.0, 10.0, 1, 2, 1.0),
    ]
    schema = "application_id int, race string, age int, credit_score int, debt_to_income double, loan_amount double, approved_amount double, approved int, employment_years int, annual_income double"
    df = spark.createDataFrame(rows, schema)
    assert {r["column"]: r["violations"] for r in quality.range_checks(df).collect()} == {"age": 2, "credit_score": 2, "debt_to_income": 2}
    assert {(r["column"], r["value"]): r["rows"] for r in quality.domain_checks(df).collect()} == {("race", "Martian"): 1, ("race", None): 1}
    assert {r["rule"]: r["violations"] for r in quality.business_rules(df).collect()} == {
        "approved_amount_exceeds_loan": 1, "approved_without_amount": 1, "implausible_employment": 2,
    }
    summary = quality.quality_summary(df).first()
    assert (summary["total_rows"], summary["total_columns"], summary["missing_values"], summary["duplicate_rows"]) == (5, 10, 5, 1)
    findings = quality.quality_findings(df).collect()
    assert {r["check"] for r in findings} == {"range", "domain", "business_rule", "missing_values", "duplicate_rows", "missing_column"}
    assert {r["is_valid"] for r in findings} == {False}


def test_business_errors_do_not_make_a_table_invalid(spark):
    df = spark.createDataFrame([(2.0, 1.0)], "approved_amount double, loan_amount double")
    findings = quality.quality_findings(df, required=("loan_amount",)).collect()
    assert [(r["check"], r["level"], r["is_valid"]) for r in findings] == [("business_rule", "error", True)]


def test_duplicates_are_counted_exactly_when_hot(spark):
    df = spark.range(3000).select((F.col("id") % F.when(F.col("id") % 3 == 0, 1).otherwise(5000)).alias("x"), F.lit(None).cast("int").alias("y"))
    assert quality.duplicate_rows(df).first()[0] == 3000 - df.distinct().count()


@pytest.mark.parametrize("settle", [1, 20, 10**6])
def test_exact_medians(spark, settle):
    rng = random.Random(4)
    spread = [rng.random() for _ in range(2001)]
    hot = [5.0] * 700 + [rng.uniform(0, 10) for _ in range(1301)]
    two = [1.0] * 1000 + [2.0] * 1001
    gap = [1.0] * 1000 + [2.0] * 1000 + [float("nan")]
    ends = [1.0] * 990 + [1 + i / 100 for i in range(1, 21)] + [9.0] * 991
    data = list(zip(spread, hot, two, gap, ends))
    df = spark.createDataFrame(data, "spread double, hot double, two double, gap double, ends double").withColumn("none", F.lit(None).cast("double"))
    got = quantiles.exact_medians(df, df.columns, settle_rows=settle)
    want = {c: statistics.median(x for x in column if not math.isnan(x)) for c, column in zip(df.columns, zip(*data))}
    assert got == {**{k: pytest.approx(v) for k, v in want.items()}, "none": None}


def test_profile(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (10, None)], "a int, b double")
    got = {r["feature"]: (r["mean"], r["median"], r["std"]) for r in profile.numeric_profile(df, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx((13 / 3, 2, statistics.stdev([1, 2, 10])))
    assert got["b"] == pytest.approx((3, 3, 2**0.5))
    assert profile.correlations(df, [("a", "b")]).first()["correlation"] == pytest.approx(1)


def test_shares_leave_null_out(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    assert {r["grp"]: r["share"] for r in profile.value_shares(df, ["x"]).collect()} == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}


def test_imputer_uses_training_values(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, None), (float("nan"), "a"), (9.0, "b")], "x double, s string")
    imputer = prep.Imputer.fit(train, ["x"], ["s"])
    assert (imputer.medians, imputer.modes) == ({"x": 3.0}, {"s": "a"})
    other = spark.createDataFrame([(None, None), (float("nan"), "z")], "x double, s string")
    assert [tuple(r) for r in imputer.transform(other).collect()] == [(3.0, "a"), (3.0, "z")]


def test_one_hot_unseen_and_missing(spark):
    encoder = prep.OneHot.fit(spark.createDataFrame([("a", "x"), ("b", "x")], "s string, t string"), ["s", "t"])
    got = encoder.transform(spark.createDataFrame([("a",), ("c",), (None,)], "s string"))
    assert got.columns == ["s_a", "s_b", "t_x"]
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]
    with pytest.raises(ValueError):
        prep.OneHot.fit(spark.range(30).select(F.col("id").cast("string").alias("s")), ["s"], max_categories=10)


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    z = prep.Standardiser.fit(df, ["x", "k"]).transform(df)
    assert [tuple(r) for r in z.collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    wide = spark.createDataFrame([(0.0, 5.0), (2.0, 9.0), (7.0, None)], "x double, k double")
    unit = prep.MinMax.fit(df, ["x", "k"]).transform(wide)
    assert [tuple(r) for r in unit.collect()] == [(0.0, 0.0), (0.5, 0.0), (1.0, None)]


def test_preparation(spark, sample):
    with pytest.raises(ValueError):
        prep.Preparation().transform(sample)
    table = sample.select("application_id", "application_date", "age", "race", "approved")
    p = prep.Preparation()
    ready = p.fit_transform(table, keep=["application_id", "approved"])
    assert set(ready.columns) == {"application_date", "age", "application_id", "approved", *p.encoder.features}
    moments = ready.agg(F.avg("age"), F.stddev_pop("age")).first()
    assert tuple(moments) == pytest.approx((0, 1), abs=1e-9)
    assert ready.select(sum(F.col(f"`{c}`") for c in p.encoder.features).alias("s")).distinct().collect()[0]["s"] == 1


def test_split_is_a_partition_of_the_rows(spark):
    df = spark.range(20000)
    train, test = prep.split(df, "id")
    assert train.count() + test.count() == 20000
    assert train.join(test, "id").isEmpty()
    assert abs(test.count() / 20000 - 0.2) < 0.02
