"""Models, what-if, counterfactuals, mitigation, attributions."""

import math
from itertools import product

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from evenhand.operators import attribution, counterfactual, mitigation, models, whatif
from evenhand.operators.models import LinearScore

MODEL = LinearScore(-1.0, {"x": 1.0, "y": -0.5})


def points(spark):
    rows = [(1, 0.0, 0.0, "a", 0), (2, 2.0, 1.0, "b", 1), (3, 1.0, 0.5, "a", 1), (4, -1.0, 2.0, "b", 0), (5, 0.8, 0.1, "a", 0)]
    return spark.createDataFrame(rows, "application_id int, x double, y double, race string, approved int")


def prob(x, y):
    return 1 / (1 + math.exp(-(-1 + x - 0.5 * y)))


def test_linear_score_and_its_table(spark):
    got = {r["application_id"]: (r["probability"], r["flag"]) for r in models.linear_score(points(spark), MODEL).collect()}
    assert got[2] == (pytest.approx(prob(2, 1)), 1)
    assert got[1] == (pytest.approx(prob(0, 0)), 0)
    assert LinearScore.from_table(MODEL.to_table(spark)) == MODEL


def test_performance_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "approved int, predicted int")
    row = models.performance(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1_score"]) == (0.5, 0.0, 0.0, None)


def test_auc_counts_ties_as_half(spark):
    rows = [(0, 0.1), (0, 0.5), (1, 0.5), (1, 0.9), (0, 0.5), (1, 0.2)]
    df = spark.createDataFrame(rows, "approved int, predicted_probability double")
    pairs = [(p, n) for p, n in product(*[[s for y, s in rows if y == k] for k in (1, 0)])]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert models.auc(df) == pytest.approx(want)


def test_rule_support(spark):
    rules = {"hit": [("x", ">", 0.5), ("y", "<=", 0.5)], "none": [("x", ">", 99.0)]}
    got = {r["rule"]: tuple(r)[1:] for r in models.rule_support(points(spark), rules).collect()}
    assert got == {"hit": (2, "Rejected", 0.5), "none": (0, "Rejected", None)}
    with pytest.raises(ValueError):
        models.rule_support(points(spark), {"bad": [("x", "<", 1.0)]})


def test_fitted_models(spark, sample, tmp_path):
    numeric = ("credit_score", "debt_to_income")
    model = models.logistic_fit(sample, numeric, ("race",), max_iter=50)
    scored = models.decide(sample, model, "decision", "p")
    assert scored.where("p < 0 or p > 1 or decision not in (0, 1)").isEmpty()
    assert models.performance(scored, prediction="decision").first()["accuracy"] > 0.5
    model.write().overwrite().save(f"{tmp_path}/m")
    again = models.decide(scored, PipelineModel.load(f"{tmp_path}/m"), "again")
    assert again.where("decision != again").isEmpty()
    forest, names = models.forest_fit(sample, numeric, ("race",), numTrees=4, maxDepth=3)
    importance = models.forest_importance(spark, forest, names)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert models.top_features(importance, 2).count() == 2
    rules = models.forest_rules(forest.stages[-1], names, trees=2)
    assert rules and all(len(path) <= 3 for path in rules.values())
    support = models.rule_support(sample.withColumns({n: (F.col("race") == n[5:]).cast("int") for n in names if n.startswith("race_")}), rules)
    one_tree = support.where("rule like 'tree_1%'").agg(F.sum("samples")).first()[0]
    assert one_tree == sample.count()


def test_tuning_reports_every_setting(sample):
    grid = {"numTrees": (2,), "maxDepth": (2, 0), "minInstancesPerNode": (50,)}
    _, scores = models.tune(sample, ("credit_score",), grid=grid, folds=2, parallelism=2)
    assert sorted(r["maxDepth"] for r in scores.collect()) == [2, models.DEEPEST_TREE]


def test_policy_impact_for_both_kinds_of_model(spark, sample):
    rules = {"x": {"type": "threshold", "value": 1.5, "direction": "increase"}, "absent": {"type": "threshold", "value": 0}}
    row = whatif.policy_impact(points(spark), rules, MODEL).first()
    before = [prob(r["x"], r["y"]) > 0.5 for r in points(spark).collect()]
    after = [prob(max(r["x"], 1.5), r["y"]) > 0.5 for r in points(spark).collect()]
    assert row["baseline_rate"] == pytest.approx(sum(before) / 5)
    assert row["modified_rate"] == pytest.approx(sum(after) / 5)
    assert row["affected_applications"] == sum(a != b for a, b in zip(before, after))
    groups = {r["grp"]: r for r in whatif.policy_impact_by_group(points(spark), rules, MODEL).collect()}
    assert set(groups) == {"a", "b"}
    fitted = models.logistic_fit(sample, ("credit_score",), max_iter=20)
    raised = {"credit_score": {"type": "threshold", "value": 800, "direction": "increase"}}
    assert whatif.policy_impact(sample, raised, fitted).first()["modified_rate"] == 1.0
    kept = whatif.policy_decisions(sample, raised, fitted)
    assert kept.select("application_id", "credit_score").exceptAll(sample.select("application_id", "credit_score")).isEmpty()


def test_percent_change_without_baseline_is_zero(spark):
    rules = {"x": {"type": "threshold", "value": 9.0, "direction": "increase"}}
    row = whatif.policy_impact(points(spark).where("application_id = 1"), rules, MODEL).first()
    assert (row["baseline_rate"], row["modified_rate"], row["percent_change"]) == (0.0, 1.0, 0.0)


def test_threshold_sweep(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.9), ("b", None), ("b", 0.6)], "race string, p double")
    got = {(r["grp"], r["cutoff"]): (r["approval_rate"], r["impact_ratio"]) for r in whatif.threshold_sweep(df, [0.5, 0.95], ["race"], "p").collect()}
    assert got == {("a", 0.5): (0.5, 1.0), ("b", 0.5): (0.5, 1.0), ("a", 0.95): (0.0, 0.0), ("b", 0.95): (0.0, 0.0)}


def test_changes_need_more_than_the_minimum(spark):
    a = spark.createDataFrame([(1, 1.0, 5.0)], "id int, x double, y double")
    b = spark.createDataFrame([(1, 1.1, 5.2)], "id int, x double, y double")
    got = whatif.significant_changes(a, b, "id", ["x", "y"], minimum=0.15).collect()
    assert [(r["feature"], round(r["delta"], 6)) for r in got] == [("y", 0.2)]


STEPS = {"x": (0, 1, 3), "y": (0, -1)}


def naive_counterfactuals(rows, k):
    def spread(values):
        m = sum(values) / len(values)
        return (sum((v - m) ** 2 for v in values) / len(values)) ** 0.5

    sx, sy = spread([r["x"] for r in rows]), spread([r["y"] for r in rows])
    grid = [m for m in product(STEPS["x"], STEPS["y"]) if any(m)]
    result = {}
    for r in rows:
        if prob(r["x"], r["y"]) > 0.5:
            continue
        found = []
        for i, (mx, my) in enumerate(grid):
            dx, dy = mx * 0.5 * sx, my * 0.5 * sy
            x, y = r["x"] + dx, r["y"] + dy
            if prob(x, y) > 0.5:
                found.append((i, x, y, math.hypot(dx, dy)))
        scored = []
        for i, x, y, d in found:
            cosines = [(x * u + y * v) / (math.hypot(x, y) * math.hypot(u, v)) for j, u, v, _ in found if j != i]
            diversity = 1 - sum(cosines) / len(cosines) if cosines else 1.0
            scored.append((i, 0.5 / (1 + d) + 0.3 * diversity + 0.2 * prob(x, y)))
        result[r["application_id"]] = sorted(scored, key=lambda s: (-s[1], s[0]))[:k]
    return result


def test_counterfactuals_match_pairwise_comparison(spark):
    got = {}
    for r in counterfactual.counterfactuals(points(spark), MODEL, STEPS, k=3).orderBy("application_id", "position").collect():
        got.setdefault(r["application_id"], []).append((r["candidate_id"], r["score"]))
    want = {k: v for k, v in naive_counterfactuals(points(spark).collect(), 3).items() if v}
    assert set(got) == set(want)
    for key, ranked in want.items():
        assert [c for c, _ in got[key]] == [c for c, _ in ranked]
        assert [s for _, s in got[key]] == pytest.approx([s for _, s in ranked])


def test_counterfactuals_reject_unknown_features(spark):
    with pytest.raises(ValueError):
        counterfactual.counterfactual_grid(points(spark), MODEL, {"z": (1,)})


def test_reweighing_makes_label_and_group_independent(sample):
    weighted = mitigation.reweigh(sample, "race")
    assert weighted.count() == sample.count()
    rates = weighted.groupBy("race").agg((F.sum(F.col("weight") * F.col("approved")) / F.sum("weight")).alias("r")).collect()
    overall = sample.agg(F.avg("approved")).first()[0]
    assert [r["r"] for r in rates] == pytest.approx([overall] * len(rates))


def test_mitigation_reduces_the_gap(sample):
    table = mitigation.mitigated_fairness(sample, "race", ("credit_score",), ("race",), max_iter=20).collect()
    rows = {r["metric"]: r for r in table}
    assert rows["demographic_parity"]["mitigated"] < rows["demographic_parity"]["baseline"]


def test_attributions_add_up_to_the_score(spark):
    df = points(spark)
    z = {r["application_id"]: r["x"] - 0.5 * r["y"] for r in df.collect()}
    mean = sum(z.values()) / len(z)
    sums = attribution.linear_attribution(df, MODEL).groupBy("application_id").agg(F.sum("contribution").alias("s"))
    assert {r["application_id"]: r["s"] for r in sums.collect()} == {k: pytest.approx(v - mean) for k, v in z.items()}
    direct = {r["feature"]: r["importance"] for r in attribution.global_importance(df, MODEL).collect()}
    listed = {r["feature"]: r["importance"] for r in attribution.importance_of(attribution.linear_attribution(df, MODEL)).collect()}
    assert direct == {k: pytest.approx(v) for k, v in listed.items()}


def test_protected_share(spark):
    table = spark.createDataFrame([("race_a", 1.0), ("age", 2.0), ("income", 1.0)], "feature string, importance double")
    got = {r["attribute"]: r["share"] for r in attribution.protected_contribution(table).collect()}
    assert got == {"race": 0.25, "age": 0.5}
    groups = {r["category"]: r["importance"] for r in attribution.importance_by_category(table).collect()}
    assert groups == {"demographic": 3.0, "financial": 1.0}


def test_local_attribution(spark):
    rows = attribution.local_attribution(points(spark), MODEL, instances=3, kept=1).collect()
    assert len(rows) == 3
    data = points(spark).collect()
    mx, my = (sum(r[c] for r in data) / 5 for c in "xy")
    for r in rows:
        p = next(d for d in data if d["application_id"] == r["application_id"])
        effects = {"x": prob(p["x"], p["y"]) - prob(mx, p["y"]), "y": prob(p["x"], p["y"]) - prob(p["x"], my)}
        assert r["feature"] == max(effects, key=lambda f: abs(effects[f]))
        assert r["contribution"] == pytest.approx(effects[r["feature"]])


def test_stability_counts_absent_features_as_zero(spark):
    runs = [(1, "a", 1.0), (2, "a", 3.0), (1, "b", -2.0), (3, "c", 0.0)]
    rows = {r["feature"]: r for r in attribution.attribution_stability(spark.createDataFrame(runs, "run int, feature string, contribution double")).collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert (a["mean"], a["min"], a["max"], a["appearances"]) == (pytest.approx(4 / 3), 0.0, 3.0, 2)
    assert a["std"] == pytest.approx((sum((v - 4 / 3) ** 2 for v in (1, 3, 0)) / 3) ** 0.5)
    assert (b["min"], b["max"], c["appearances"]) == (-2.0, 0.0, 0)
    va, vb = a["std"] ** 2, b["std"] ** 2
    size = (a["mean"] + abs(b["mean"]) + 0) / 3
    assert a["stability_score"] == pytest.approx(1 / (1 + (va + vb) / 2 / size))
    zero = spark.createDataFrame([(1, "a", 0.0)], "run int, feature string, contribution double")
    assert attribution.attribution_stability(zero).first()["stability_score"] == 0.0
