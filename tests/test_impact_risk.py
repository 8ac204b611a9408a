import statistics

import pytest
from pyspark.sql import functions as F

from evenhand.operators import cube, impact, risk

METRICS = "attribute string, metric string, value double, threshold double, passed boolean, severity string, impacted_group string"


def applications(spark, rows):
    return spark.createDataFrame(rows, "race string, gender string, approved int")


def test_quick_impact_without_any_approval_is_zero(spark):
    got = impact.quick_impact(applications(spark, [("a", "m", 0), ("b", "f", 0)]), ["race"]).first()
    assert (got["impact_ratio"], got["has_disparate_impact"]) == (0.0, True)


def test_intersections_list_empty_combinations(spark):
    df = applications(spark, [("a", "m", 1), ("a", "f", 0), ("b", "m", 1), (None, "m", 0)])
    got = {(r["race"], r["gender"]): (r["impact_ratio"], r["has_disparate_impact"]) for r in impact.intersection_impact(df, ["race", "gender"]).collect()}
    assert got == {("a", "m"): (2.0, False), ("a", "f"): (0.0, True), ("b", "m"): (2.0, False), ("b", "f"): (None, False)}


def test_redlining_ignores_unknown_places_and_repeated_demographics(spark):
    places = [f"p{i}" for i in range(12)]
    rows = []
    for i, p in enumerate(places):
        approvals = 1 if i == 0 else 8 + i % 2
        rows += [(p, 1)] * approvals + [(p, 0)] * (10 - approvals)
    rows += [("elsewhere", 0)] * 50 + [(None, 0)] * 5
    df = spark.createDataFrame(rows, "zip_code string, approved int")
    known = spark.createDataFrame([(p,) for p in places + places[:3]], "zip_code string")
    got = impact.redlining(df, known).collect()
    rates = [0.1] + [(8 + i % 2) / 10 for i in range(1, 12)]
    limit = statistics.mean(rates) - 2 * statistics.stdev(rates)
    assert [r["zip_code"] for r in got] == [p for p, x in zip(places, rates) if x < limit] == ["p0"]


def test_location_exactly_on_the_limit_is_not_suspicious(spark):
    df = spark.createDataFrame([("p", 1), ("q", 1)], "zip_code string, approved int")
    assert impact.redlining(df, df.select("zip_code")).isEmpty()


def test_hotspots_count_all_and_list_five(spark):
    risks = spark.createDataFrame([(f"z{i}", 0.647 + i / 100) for i in range(12)] + [("edge", 0.7)], "zip string, risk_score double")
    got = impact.redlining_hotspots(risks, "zip").collect()
    assert [r["zip"] for r in got] == ["z11", "z10", "z9", "z8", "z7"]
    assert {r["n_hotspots"] for r in got} == {6}
    assert impact.redlining_hotspots(risks.where("zip = 'edge'"), "zip").isEmpty()


def test_worst_intersection_needs_the_threshold(spark):
    table = spark.createDataFrame([("b", 0.2), ("a", 0.2), ("c", 0.1)], "level string, disparity double")
    assert impact.worst_intersection(table).first()["level"] == "a"
    assert impact.worst_intersection(table.where("level = 'c'")).isEmpty()


def test_ranking_orders_ties_by_name(spark):
    df = applications(spark, [("b", "m", 1), ("a", "m", 1), ("c", "m", 0)])
    from evenhand.operators.fairness import group_rates

    got = impact.group_ranking(group_rates(cube.rate_cube(df.withColumn("credit_score", F.lit(1)), ["race"]))).collect()
    assert [(r["grp"], r["position"], r["gap_to_best"]) for r in sorted(got, key=lambda r: r["position"])] == [("a", 1, 0.0), ("b", 2, 0.0), ("c", 3, 1.0)]
    assert {(r["best_group"], r["worst_group"]) for r in got} == {("a", "c")}


def test_distinct_groups_drop_null(spark):
    df = applications(spark, [("a", "m", 1), (None, "m", 1), ("a", None, 0)])
    assert sorted(tuple(r) for r in impact.distinct_groups(df, ["race", "gender"]).collect()) == [("gender", "m"), ("race", "a")]


def metrics(spark, rows):
    return spark.createDataFrame(rows, METRICS)


FAILING = [
    ("race", "four_fifths_rule", 0.1, 0.8, False, "High", "b"),
    ("race", "demographic_parity", 0.31, 0.1, False, "High", "b"),
    ("race", "equal_opportunity", 0.4, 0.1, False, "High", "b"),
]


def test_risk_uses_only_the_metrics_present(spark):
    row = risk.risk_score(metrics(spark, FAILING)).first()
    assert row["overall_risk_score"] == pytest.approx((0.4 * (1 - 0.1 / 0.8) + 0.2 + 0.2) / 0.8)
    assert (row["severity"], row["color"], row["compliant"]) == ("High", "red", False)
    assert [s["metric"] for s in row["metric_scores"]] == [m[1] for m in FAILING]
    assert [v["regulation"] for v in row["violations"]] == ["ECOA", "Fair Housing Act"]


def test_no_scored_metric_gives_zero_risk(spark):
    row = risk.risk_score(metrics(spark, [("race", "intersectional_summary", 0.5, 0.2, False, "High", "b")])).first()
    assert (row["overall_risk_score"], row["severity"], row["compliant"], row["metric_scores"]) == (0.0, "Low", True, [])


def test_rules_fire_in_order(spark):
    fired = risk.triggered_rules(metrics(spark, FAILING)).orderBy("ordinal").collect()
    assert [r["code"] for r in fired] == [
        "URGENT_REVIEW", "REVIEW_CRITERIA", "MITIGATE", "INVESTIGATE_QUALIFIED", "ANALYZE_FACTORS", "RETRAIN_BALANCED", "MONITOR_FAIRNESS",
    ]
    assert fired[1]["grp"] == "b"
    calm = [("race", "four_fifths_rule", 0.9, 0.8, True, "Low", "b"), ("race", "demographic_parity", 0.15, 0.1, False, "Medium", "b")]
    assert risk.triggered_rules(metrics(spark, calm)).isEmpty()


def test_alerts_and_priority_filter(spark):
    alerts = {r["type"]: r for r in risk.portfolio_alerts(metrics(spark, FAILING)).collect()}
    assert set(alerts) == {"HIGH_RISK", "COMPLIANCE_VIOLATION", "METRIC_FAILURE"}
    assert alerts["HIGH_RISK"]["details"] == ["URGENT_REVIEW", "REVIEW_CRITERIA", "MITIGATE"]
    assert alerts["METRIC_FAILURE"]["details"] == [m[1] for m in FAILING]
    high = risk.portfolio_alerts(metrics(spark, FAILING), priority="high").collect()
    assert [r["type"] for r in high] == ["METRIC_FAILURE"]


def test_high_risk_metrics(spark):
    rows = [*FAILING, ("gender", "equalized_odds", 0.0, 0.1, True, "Low", None)]
    got = {r["attribute"]: (r["high_risk_metrics"], r["bias_severity"]) for r in risk.high_risk_metrics(metrics(spark, rows)).collect()}
    assert got == {"race": (sorted(m[1] for m in FAILING), "High"), "gender": ([], "Low")}


def test_biased_decisions_score_worse_than_unbiased(sample):
    from evenhand.functions.lending import BIAS_FACTORS, biased_probability
    from evenhand.operators.fairness import all_metrics
    from evenhand.sources.applications import ROLES

    def race_audit(flags):
        p = biased_probability(F.col("predicted_probability"), flags, ROLES)
        draw = (F.col("application_id") * 7919) % 1000 / 1000.0
        decided = sample.withColumn("decision", (draw < p).cast("int"))
        table = all_metrics(decided, ["race"], "decision")
        ratio = table.where("metric = 'four_fifths_rule'").first()["value"]
        return ratio, risk.risk_score(table).first()

    biased_ratio, biased = race_audit(tuple(BIAS_FACTORS))
    fair_ratio, fair = race_audit(())
    assert biased_ratio < 0.8 and biased_ratio < fair_ratio
    assert biased["overall_risk_score"] > fair["overall_risk_score"]
    assert not biased["compliant"]
    assert 0 <= biased["overall_risk_score"] <= 1
