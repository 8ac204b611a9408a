import random

import pytest
from naive import fairness as naive_fairness
from pyspark.sql import functions as F

from evenhand.operators import cube, fairness

SCHEMA = "seg string, race string, gender string, credit_score int, predicted_probability double, approved int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def simple(spark, rows):
    """rows: (group, approved) or (group, credit_score, approved)"""
    full = [("s", r[0], "x", r[1] if len(r) == 3 else 700, 0.9, r[-1]) for r in rows]
    return frame(spark, full)


def by_metric(table):
    return {(r["attribute"], r["metric"]): r for r in table.collect()}


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        race = rng.choice(["a", "a", "a", "b", "c", "d", None])
        score = rng.choice([None, 600, 640, 650, 651, 700, 720])
        approved = rng.choice([0, 1, 1 if race == "a" else 0, None])
        rows.append((rng.choice(["s", "t"]), race, rng.choice(["m", "f"]), score, rng.choice([None, 0.2, 0.5, 0.6]), approved))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("reference", [None, "b", "missing"])
def test_all_metrics_match_the_definitions(spark, seed, reference):
    rows = random_rows(seed)
    refs = {"race": reference} if reference else None
    table = fairness.all_metrics(frame(spark, rows), ["race", "gender"], by=["seg"], references=refs)
    got = {(r["seg"], r["attribute"], r["metric"]): r for r in table.collect()}
    assert len(got) == 20
    names = SCHEMA.replace(",", "").split()[::2]
    dicts = [dict(zip(names, r)) for r in rows]
    for seg in "st":
        for attribute in ("race", "gender"):
            part = [d for d in dicts if d["seg"] == seg]
            want = naive_fairness(part, attribute, reference if attribute == "race" else None)
            di = got[seg, attribute, "four_fifths_rule"]
            value, ref, worst = want["four_fifths_rule"]
            assert (di["reference_group"], di["impacted_group"]) == (ref, worst)
            assert di["value"] == pytest.approx(value)
            assert di["p_value"] == pytest.approx(want["p_value"], abs=1e-6)
            for metric in ("demographic_parity", "equal_opportunity"):
                row = got[seg, attribute, metric]
                gap, impacted, ref = want[metric]
                assert row["value"] == pytest.approx(gap)
                assert (row["impacted_group"], row["reference_group"]) == (impacted, ref)
            for metric in ("predictive_parity", "equalized_odds"):
                assert got[seg, attribute, metric]["value"] == pytest.approx(want[metric])


def test_severity_and_pass_at_exact_thresholds(spark):
    def impact(k):
        df = simple(spark, [("a", 1)] * 10 + [("b", 1)] * k + [("b", 0)] * (10 - k))
        r = fairness.disparate_impact(df, ["race"]).first()
        return r["value"], r["passed"], r["severity"]

    assert impact(8) == (0.8, True, "Low")
    assert impact(7) == (0.7, False, "Medium")
    assert impact(6) == (0.6, False, "High")


def test_gap_at_exact_thresholds(spark):
    def parity(k):
        rows = [("a", 1)] * 5 + [("a", 0)] * 5 + [("b", 1)] * k + [("b", 0)] * (10 - k)
        r = fairness.demographic_parity(simple(spark, rows), ["race"]).first()
        return round(r["value"], 6), r["passed"], r["severity"]

    assert parity(5) == (0.0, True, "Low")
    assert parity(4)[1:] in ((True, "Low"), (False, "Medium"))
    assert parity(2)[1:] == (False, "High")


def test_one_group_passes_with_value_one(spark):
    m = by_metric(fairness.all_metrics(simple(spark, [("a", 1), ("a", 0)]), ["race"]))
    di = m["race", "four_fifths_rule"]
    assert (di["value"], di["passed"], di["impacted_group"], di["p_value"]) == (1.0, True, None, 1.0)
    assert m["race", "demographic_parity"]["value"] == 0.0


def test_two_groups_give_p_one_by_default_and_a_real_test_on_request(spark):
    df = simple(spark, [("a", 1)] * 30 + [("a", 0)] * 5 + [("b", 1)] * 5 + [("b", 0)] * 30)
    counts = cube.rate_cube(df, ["race"])
    assert fairness.chi_square_pair(counts).first()["p_value"] == 1.0
    assert fairness.chi_square_pair(counts, pair="ref_vs_worst").first()["p_value"] < 1e-6


def test_nobody_approved(spark):
    m = by_metric(fairness.all_metrics(simple(spark, [("a", 0), ("b", 0)]), ["race"]))
    di = m["race", "four_fifths_rule"]
    assert (di["value"], di["passed"], di["impacted_group"], di["reference_group"]) == (1.0, True, None, "a")


def test_ties_go_to_the_first_names(spark):
    rows = [(g, v) for g in "dbca" for v in (0, 1)]
    di = fairness.disparate_impact(simple(spark, rows), ["race"]).first()
    assert (di["reference_group"], di["impacted_group"], di["value"]) == ("a", "b", 1.0)


def test_null_groups_and_outcomes_are_left_out(spark):
    df = simple(spark, [("a", 1), ("a", None), (None, 0), ("b", 1)])
    rows = {r["grp"]: (r["n"], r["approvals"]) for r in cube.rate_cube(df, ["race"]).collect()}
    assert rows == {"a": (1, 1), "b": (1, 1)}


def test_no_qualified_and_no_predicted(spark):
    rows = [("s", g, "x", 600, 0.1, y) for g in "ab" for y in (0, 1)]
    m = by_metric(fairness.all_metrics(frame(spark, rows), ["race"]))
    for metric in ("equal_opportunity", "predictive_parity"):
        row = m["race", metric]
        assert (row["value"], row["passed"], row["severity"]) == (0.0, True, "Low")


def test_predictive_parity_needs_a_probability_column(spark):
    df = simple(spark, [("a", 1), ("b", 0)]).drop("predicted_probability")
    assert ("race", "predictive_parity") not in by_metric(fairness.all_metrics(df, ["race"]))
    assert fairness.predictive_parity(df, ["race"]).isEmpty()


def test_null_segment_is_a_segment(spark):
    rows = [(s, g, "x", 700, 0.9, y) for s in ("s", None) for g in "ab" for y in (0, 1)]
    assert fairness.all_metrics(frame(spark, rows), ["race"], by=["seg"]).count() == 10


def test_thresholds_can_be_overridden(spark):
    df = simple(spark, [("a", 1)] * 4 + [("b", 1)] * 3 + [("b", 0)])
    r = fairness.disparate_impact(df, ["race"], thresholds={"four_fifths_rule": {"threshold": 0.7}}).first()
    assert (r["threshold"], r["passed"]) == (0.7, True)


def test_intersections_drop_null_parts_and_merge_equal_keys(spark):
    rows = [("s", "a_b", "c", 700, 0.9, 1), ("s", "a", "b_c", 700, 0.9, 0), ("s", None, "c", 700, 0.9, 1), ("s", "z", "z", 700, 0.9, 1)]
    groups = {r["grp"]: r["n"] for r in cube.intersection_cube(frame(spark, rows), ["race", "gender"]).collect()}
    assert groups == {"a_b_c": 2, "z_z": 1}


@pytest.mark.parametrize("k, expected", [(8, (True, "Low")), (6, (False, "High"))])
def test_intersectional_summary(spark, k, expected):
    rows = [("s", "a", "m", 700, 0.9, 1)] * 9 + [("s", "a", "m", 700, 0.9, 0)]
    rows += [("s", "b", "f", 700, 0.9, 1)] * (k - 1) + [("s", "b", "f", 700, 0.9, 0)] * (11 - k)
    m = by_metric(fairness.intersectional_metrics(frame(spark, rows), ["race", "gender"]))
    row = m["intersectional_group", "intersectional_summary"]
    assert (row["passed"], row["severity"]) == expected if k == 6 else row["severity"] in ("Low", "Medium")
    assert row["impacted_group"] == "b_f"


def test_group_rates_interval_is_not_clamped(spark):
    rates = fairness.group_rates(cube.rate_cube(simple(spark, [("a", 1), ("a", 1), ("a", 0)]), ["race"])).first()
    half = 1.96 * (2 / 3 * 1 / 3 / 3) ** 0.5
    assert (rates["ci_low"], rates["ci_high"]) == pytest.approx((2 / 3 - half, 2 / 3 + half))
    assert rates["ci_high"] > 1


def test_grouped_cube_levels_add_up(spark):
    df = frame(spark, random_rows(5)).where("race is not null")
    rows = cube.grouped_cube(df, ["race", "gender"]).groupBy("level").agg(F.sum("n").alias("n")).collect()
    assert len(rows) == 4 and len({r["n"] for r in rows}) == 1


def test_group_counts_add_up_to_the_table(sample):
    total = sample.count()
    sums = cube.rate_cube(sample, ["race", "gender"]).groupBy("attribute").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in sums} == {total}


def test_values_lie_in_their_ranges(sample):
    for r in fairness.all_metrics(sample, ["race", "gender", "age_group"], by=["region"]).collect():
        assert 0 <= r["value"] <= 1
        assert r["severity"] in ("Low", "Medium", "High")
        assert r["passed"] == (r["severity"] == "Low")


def test_compare_metrics(spark):
    schema = "attribute string, metric string, value double, passed boolean"
    before = spark.createDataFrame([("r", "m", 0.5, False), ("r", "z", 0.0, True), ("r", "only", 1.0, True)], schema)
    after = spark.createDataFrame([("r", "m", 0.4, True), ("r", "z", 0.1, False)], schema)
    got = {r["metric"]: r for r in fairness.compare_metrics(before, after).collect()}
    assert set(got) == {"m", "z"}
    assert got["m"]["percent_improvement"] == pytest.approx(20)
    assert got["z"]["percent_improvement"] == 0


def test_segment_cannot_be_an_attribute(spark):
    with pytest.raises(ValueError):
        cube.rate_cube(simple(spark, [("a", 1)]), ["race"], by=["race"])


def test_models_are_audited_together_as_they_are_apart(spark):
    rows = random_rows(9)
    df = frame(spark, rows).withColumn("other", F.when(F.col("credit_score") > 640, 1).when(F.col("race") == "a", 0))
    together = fairness.audit_models(df, ["race", "gender"], {"one": "approved", "two": "other"}, by=["seg"])
    for model, outcome in (("one", "approved"), ("two", "other")):
        apart = fairness.all_metrics(df, ["race", "gender"], outcome, by=["seg"])
        mine = together.where(F.col("model") == model).drop("model").select(apart.columns)
        assert sorted(map(str, mine.collect())) == sorted(map(str, apart.collect()))
