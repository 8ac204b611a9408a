"""The registered queries: every operator run over the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions import lending
from evenhand.operators import (
    attribution,
    counterfactual,
    cube,
    drift,
    fairness,
    impact,
    lattice,
    mitigation,
    models,
    prep,
    profile,
    quality,
    risk,
    sketches,
    whatif,
)
from evenhand.plans.inputs import (
    CHECK_DOMAINS,
    CHECK_RANGES,
    CUTOFFS,
    EXPLAINED_SCORE,
    POLICY,
    RULES,
    SCORE,
    STEPS,
    as_timed,
    day,
    demographics,
    explained_applications,
    flawed_applications,
    listed,
    located_applications,
    rounded,
    second,
    timed_events,
    windowed_applications,
)
from evenhand.session import work_dir
from evenhand.sources import exports, tables
from evenhand.sources.applications import NUMERIC, PROTECTED, ROLES, applications, applications_from, star_table
from evenhand.sources.versions import VersionedTable
from evenhand.streaming import baseline, late, monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AUDITED = ("race", "gender", "age_group")
REFERENCES = {"race": "MACHINERY", "gender": "O"}
BY_REGION = ("region",)
LATTICE = ("race", "gender", "age_group", "region", "urban_rural", "loan_type")
SKETCHED = ("age", "annual_income", "loan_amount")
SIMPLE = ("credit_score", "debt_to_income", "annual_income", "age")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- sources and sinks ---------------------------------------------------------------------------


@query
def load_table(spark, base):
    loaded = tables.load_table(spark, base, "orders.parquet")
    return loaded.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query
def save_roundtrip(spark, base):
    """The same rows written as csv, json and parquet and read back with an explicit schema."""
    rows = applications(spark, base).select("application_id", "race", "loan_amount", "approved")
    folder = work_dir(spark, "roundtrip")
    result = None
    for fmt in ("csv", "json", "parquet"):
        name = f"applications.{fmt}"
        tables.save_table(rows, folder, name)
        read = tables.load_table(spark, folder, name, rows.schema).withColumn("format", F.lit(fmt))
        part = read.groupBy("format", "race").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("approved").alias("approvals"),
            F.avg("loan_amount").alias("avg_loan_amount"),
        )
        result = part if result is None else result.unionByName(part)
    return rounded(result)


@query
def versioned_overwrite(spark, base):
    """A stored table after a partition-wise overwrite: one region's applications replaced by its approved ones, the others kept."""
    rows = applications(spark, base).select("application_id", "region", "approved")
    table = VersionedTable(spark, f"{work_dir(spark, 'versions')}/decisions", rows.schema, ("region",))
    first = table.replace(rows)
    table.replace_partitions(table.read().where((F.col("region") == "ASIA") & (F.col("approved") == 1)))
    result = None
    for name, version in (("before", first), ("after", None)):
        part = table.read(version).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("approved").alias("approvals"))
        part = part.withColumn("version", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


@query
def sample_rows(spark, base):
    rows = applications(spark, base).select("application_id", "race", "credit_score", "approved")
    return tables.sample_rows(rows, 1000, "application_id")


@query
def sample_by_segment(spark, base):
    """Two hundred applications of every region and decision."""
    rows = applications(spark, base).select("application_id", "region", "approved", "credit_score")
    return tables.sample_by(rows, 200, "application_id", ("region", "approved"))


@query
def export_metrics_flat(spark, base):
    return rounded(exports.flatten_metrics(_two_models(spark, base)))


@query
def export_predictions(spark, base):
    scored = models.linear_score(applications(spark, base), SCORE)
    kept = scored.select("application_id", *SIMPLE, "flag", "probability", "approved")
    return rounded(exports.flatten_predictions(kept, "flag", "probability", "approved"))


@query
def model_roundtrip(spark, base):
    """Rows whose decision differs between a fitted model and its reloaded copy (none should)."""
    rows = applications(spark, base)
    model = models.logistic_fit(rows, SIMPLE, max_iter=20)
    path = work_dir(spark, "model")
    model.write().overwrite().save(path)
    both = models.decide(models.decide(rows, model, "first"), PipelineModel.load(path), "second")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") != F.col("second")).alias("n_different")
    )


# --- row-level rules -----------------------------------------------------------------------------


@query
def age_band(spark, base):
    return applications(spark, base).select("application_id", "age", lending.age_band(F.col("age")).alias("band"))


@query
def approval_score(spark, base):
    score = lending.approval_score(F.col("credit_score"), F.col("debt_to_income"))
    return rounded(applications(spark, base).select("application_id", score.alias("score")))


@query
def bias_modifiers(spark, base):
    base_score = F.col("predicted_probability")
    return rounded(
        applications(spark, base).select(
            "application_id",
            lending.biased_probability(base_score, ("gender", "race"), ROLES).alias("two_switches"),
            lending.biased_probability(base_score, roles=ROLES).alias("all_switches"),
        ),
        12,
    )


@query
def intersection_key(spark, base):
    return flawed_applications(spark, base).select(
        "application_id", lending.intersection_key("race", "gender", "age").alias("intersection")
    )


@query
def feature_categories(spark, base):
    """Category and number of missing values of every column of the table."""
    table = flawed_applications(spark, base)
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in table.columns]
    long = table.agg(*counts).unpivot([], table.columns, "feature", "missing")
    return long.select("feature", lending.feature_category(F.col("feature")).alias("category"), "missing")


@query
def policy_rewrite(spark, base):
    rules = {**POLICY, "gender": {"type": "categorical", "mapping": {"F": "O"}}}
    rules["debt_to_income"] = {"type": "threshold", "value": 0.4, "direction": "decrease"}
    changed = whatif.policy_rewrite(applications(spark, base), rules)
    return rounded(changed.select("application_id", *rules))


@query
def significant_changes(spark, base):
    rows = applications(spark, base)
    return rounded(whatif.significant_changes(rows, whatif.policy_rewrite(rows, POLICY), "application_id", POLICY))


@query
def policy_changes(spark, base):
    return rounded(whatif.policy_changes(applications(spark, base), POLICY, "application_id"))


# --- fairness core -------------------------------------------------------------------------------


@query
def rate_cube(spark, base):
    return cube.rate_cube(applications(spark, base), AUDITED, by=BY_REGION)


@query
def group_rates_ci(spark, base):
    return rounded(fairness.group_rates(cube.rate_cube(applications(spark, base), PROTECTED)))


@query
def disparate_impact(spark, base):
    return rounded(fairness.disparate_impact(applications(spark, base), PROTECTED))


@query
def chi_square_pair(spark, base):
    groups = cube.rate_cube(applications(spark, base), AUDITED, by=BY_REGION)
    return rounded(fairness.chi_square_pair(groups, BY_REGION))


@query
def demographic_parity(spark, base):
    return rounded(fairness.demographic_parity(applications(spark, base), PROTECTED, references=REFERENCES))


@query
def equal_opportunity(spark, base):
    return rounded(fairness.equal_opportunity(applications(spark, base), PROTECTED, references=REFERENCES))


@query
def predictive_parity(spark, base):
    return rounded(fairness.predictive_parity(applications(spark, base), PROTECTED))


@query
def equalized_odds(spark, base):
    return rounded(fairness.equalized_odds(applications(spark, base), PROTECTED))


@query
def all_metrics(spark, base):
    return rounded(fairness.all_metrics(applications(spark, base), AUDITED, by=BY_REGION))


@query
def intersectional_metrics(spark, base):
    return rounded(fairness.intersectional_metrics(applications(spark, base), AUDITED))


@query
def quick_impact(spark, base):
    return rounded(impact.quick_impact(applications(spark, base), PROTECTED))


@query
def intersection_impact(spark, base):
    """Joint groups with the nation, so that some combinations are empty."""
    return rounded(impact.intersection_impact(applications(spark, base), ("race", "zip_code", "region")))


@query
def redlining(spark, base):
    return rounded(impact.redlining(located_applications(spark, base), demographics(spark, base), "tract"))


@query
def grouped_cube(spark, base):
    return rounded(cube.grouped_cube(applications(spark, base), AUDITED))


# --- profile, quality, scoring -------------------------------------------------------------------


@query
def portfolio_kpis(spark, base):
    return rounded(profile.portfolio_kpis(applications(spark, base)))


@query
def region_summary(spark, base):
    return rounded(profile.region_summary(applications(spark, base)))


@query
def approval_by_group(spark, base):
    return rounded(profile.approval_by_group(applications(spark, base), ("gender", "race", "region")))


@query
def value_shares(spark, base):
    return rounded(profile.value_shares(flawed_applications(spark, base), ("race", "gender", "loan_type")))


@query
def numeric_profile(spark, base):
    return rounded(profile.numeric_profile(flawed_applications(spark, base), NUMERIC[:5]))


@query
def correlations(spark, base):
    pairs = (("annual_income", "credit_score"), ("age", "employment_years"))
    return rounded(profile.correlations(applications(spark, base), pairs))


@query
def range_checks(spark, base):
    return quality.range_checks(flawed_applications(spark, base), CHECK_RANGES)


@query
def domain_checks(spark, base):
    return quality.domain_checks(flawed_applications(spark, base), CHECK_DOMAINS)


@query
def business_rules(spark, base):
    return quality.business_rules(flawed_applications(spark, base))


@query
def quality_summary(spark, base):
    return quality.quality_summary(flawed_applications(spark, base))


@query
def quality_findings(spark, base):
    table = flawed_applications(spark, base).withColumn("age", F.col("age").cast("string")).drop("approved")
    return quality.quality_findings(table, ranges={"credit_score": (300, 850)}, domains=CHECK_DOMAINS)


def _segment_metrics(spark, base) -> DataFrame:
    return fairness.all_metrics(located_applications(spark, base), AUDITED, by=("tract",))


@query
def risk_score(spark, base):
    table = risk.risk_score(_segment_metrics(spark, base), ("tract",))
    flat = table.withColumns(
        {
            "metric_scores": F.transform(
                "metric_scores",
                lambda s: F.concat_ws(":", s["metric"], F.round(s["weight"], 1), F.round(s["risk"], 4).cast("decimal(10,4)")),
            ),
            "violations": F.transform("violations", lambda v: v["regulation"]),
        }
    )
    return rounded(
        flat.select(
            "tract",
            "attribute",
            "overall_risk_score",
            "severity",
            "color",
            "compliant",
            listed("metric_scores"),
            listed("violations"),
        )
    )


@query
def worst_case_risk(spark, base):
    return rounded(risk.worst_case_risk(risk.risk_score(_segment_metrics(spark, base), ("tract",)), ("tract",)))


@query
def compliance(spark, base):
    flags = risk.compliance(_segment_metrics(spark, base), ("tract",))
    violations = F.transform("violations", lambda v: F.concat_ws(": ", v["regulation"], v["violation"], v["severity"]))
    return flags.withColumn("violations", violations).select(
        "tract", "attribute", "ecoa_ok", "fha_ok", "state_ok", "compliant", listed("violations")
    )


@query
def triggered_rules(spark, base):
    return risk.triggered_rules(_segment_metrics(spark, base), ("tract",))


@query
def portfolio_alerts(spark, base):
    alerts = risk.portfolio_alerts(_segment_metrics(spark, base), ("tract",))
    return alerts.select("tract", "attribute", "type", "priority", "message", "action_required", listed("details"))


@query
def high_risk_metrics(spark, base):
    table = risk.high_risk_metrics(_segment_metrics(spark, base), ("tract",))
    return table.select("tract", "attribute", listed("high_risk_metrics"), "bias_severity")


@query
def performance(spark, base):
    return rounded(models.performance(applications(spark, base), by=BY_REGION))


@query
def auc(spark, base):
    value = models.auc(applications(spark, base))
    return rounded(spark.createDataFrame([(value,)], "area_under_roc double"))


@query
def auc_by_segment(spark, base):
    """Area under the curve of every region and of every tract."""
    rows = located_applications(spark, base).select("region", "tract", "approved", "predicted_probability")
    parts = [
        models.auc_by(rows, [level]).select(F.lit(level).alias("level"), F.col(level).alias("segment"), "n", "positives", "area_under_roc")
        for level in ("region", "tract")
    ]
    return rounded(parts[0].unionByName(parts[1]))


@query
def segment_profile(spark, base):
    """Profiles of every window, every region and the whole, merged from one table of sketches by window and region."""
    rows = windowed_applications(spark, base).withColumn("window_start", day("window_start"))
    fine = sketches.sketch(rows, SKETCHED, ["window_start", "region"])
    path = work_dir(spark, "sketches")
    fine.write.mode("overwrite").parquet(path)
    fine = spark.read.schema(fine.schema).parquet(path)
    result = None
    for by in (["window_start"], ["region"], []):
        segment = F.col(by[0]) if by else F.lit("all")
        part = sketches.profile(sketches.merge(fine, by), by).select(
            segment.alias("segment"), "feature", "n", "mean", "std", "share", "low", "high", "estimate"
        )
        result = part if result is None else result.unionByName(part)
    return rounded(result)


@query
def pricing_gap(spark, base):
    rows = applications(spark, base)
    return rounded(
        profile.pricing_gap(rows, "race").unionByName(profile.pricing_gap(rows, "gender", reference="O"))
    )


# --- rankings and sets ---------------------------------------------------------------------------


@query
def subgroup_tests(spark, base):
    """All subgroups of six attributes with at least a hundred applications, tested against everyone else."""
    return rounded(lattice.subgroup_tests(applications(spark, base), LATTICE, support=100))


@query
def group_ranking(spark, base):
    rates = fairness.group_rates(cube.rate_cube(applications(spark, base), PROTECTED))
    return rounded(impact.group_ranking(rates))


@query
def top_features(spark, base):
    importance = attribution.global_importance(explained_applications(spark, base), EXPLAINED_SCORE)
    return rounded(models.top_features(importance.select("feature", "importance"), 5))


@query
def redlining_hotspots(spark, base):
    scores = risk.risk_score(_segment_metrics(spark, base), ("tract",))
    return rounded(impact.redlining_hotspots(impact.location_risk(scores, "tract"), "tract"))


@query
def worst_intersection(spark, base):
    pairs = cube.grouped_cube(applications(spark, base), PROTECTED).where(F.contains("level", F.lit("*")))
    return rounded(impact.worst_intersection(impact.combination_disparity(pairs)))


def _two_models(spark, base) -> DataFrame:
    outcomes = {"history": "approved", "score": "predicted"}
    return fairness.audit_models(applications(spark, base), AUDITED, outcomes)


@query
def union_metrics(spark, base):
    """Metrics of the decisions and of the score, audited apart and accumulated."""
    rows = applications(spark, base)
    audits = [
        fairness.all_metrics(rows, AUDITED, outcome).withColumn("model", F.lit(name))
        for name, outcome in (("history", "approved"), ("score", "predicted"))
    ]
    table = fairness.union_metrics(*audits)
    return rounded(table.select("model", "attribute", "metric", "value", "passed", "severity"))


@query
def distinct_groups(spark, base):
    return impact.distinct_groups(flawed_applications(spark, base), ("race", "gender", "loan_type"))


# --- feature preparation and models --------------------------------------------------------------


@query
def impute(spark, base):
    table = flawed_applications(spark, base)
    train, _ = prep.split(table, "application_id")
    imputer = prep.Imputer.fit(train, ("age", "credit_score"), ("race",))
    return rounded(imputer.transform(table).select("application_id", "age", "credit_score", "race"))


@query
def one_hot(spark, base):
    """Fitted without one loan type, so that it is unseen at transform."""
    table = applications(spark, base).select("application_id", "gender", "loan_type")
    encoder = prep.OneHot.fit(table.where(F.col("loan_type") != "5-LOW"), ("gender", "loan_type"))
    encoded = encoder.transform(table)
    return encoded.toDF(*[c.lower().replace("-", "_").replace(" ", "_") for c in encoded.columns])


@query
def standardise(spark, base):
    table = applications(spark, base).select("application_id", *SIMPLE, F.lit(7).alias("constant"))
    train, test = prep.split(table, "application_id")
    return rounded(prep.Standardiser.fit(train, (*SIMPLE, "constant")).transform(test))


@query
def prepare(spark, base):
    table = flawed_applications(spark, base).select("application_id", "age", "credit_score", "race", "approved")
    return rounded(prep.Preparation().fit_transform(table, keep=("application_id", "approved")))


@query
def split(spark, base):
    rows = applications(spark, base).select("application_id", "approved")
    train, test = prep.split(rows, "application_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def min_max(spark, base):
    table = applications(spark, base).select("application_id", *SIMPLE, F.lit(7).alias("constant"))
    train, _ = prep.split(table, "application_id")
    return rounded(prep.MinMax.fit(train, (*SIMPLE, "constant")).transform(table))


@query
def logistic_fit(spark, base):
    rows = applications(spark, base)
    train, test = prep.split(rows, "application_id")
    model = models.logistic_fit(train, SIMPLE, ("race", "gender"), max_iter=100)
    scored = models.decide(test, model, "model_decision", "model_probability")
    return rounded(models.performance(scored, prediction="model_decision"))


@query
def forest_fit(spark, base):
    rows = applications(spark, base)
    model, names = models.forest_fit(rows, SIMPLE, ("race", "gender"), numTrees=10, maxDepth=5)
    return models.top_features(models.forest_importance(spark, model, names))


@query
def tune(spark, base):
    grid = {"numTrees": (5,), "maxDepth": (3, 5), "minInstancesPerNode": (2,)}
    return models.tune(applications(spark, base), SIMPLE, (), grid=grid, folds=2)[1]


@query
def tune_by_halving(spark, base):
    """The whole grid of settings: all of it on a ninth of the rows, a third of it on a third, the best on all."""
    return models.tune_by_halving(applications(spark, base), SIMPLE, "application_id")[1]


@query
def forest_rules(spark, base):
    """Support of the shallow rules of a fitted forest on the whole table."""
    rows = applications(spark, base)
    model, names = models.forest_fit(rows, SIMPLE, numTrees=3, maxDepth=3)
    return models.rule_support(rows, models.forest_rules(model.stages[-1], names))


@query
def leaf_rules(spark, base):
    """All rules of all trees of a fitted forest, with their support on the whole table."""
    rows = applications(spark, base)
    model, names = models.forest_fit(rows, SIMPLE, ("race",), numTrees=10, maxDepth=6)
    return rounded(models.leaf_support(rows, model, names))


@query
def fairness_improvement(spark, base):
    """Metrics of the recorded decisions against those of the plain score."""
    both = _two_models(spark, base).persist()
    before, after = (both.where(F.col("model") == m).drop("model") for m in ("history", "score"))
    return rounded(fairness.compare_metrics(before, after))


@query
def linear_score(spark, base):
    scored = models.linear_score(applications(spark, base), SCORE)
    return rounded(scored.select("application_id", "probability", "flag"))


@query
def rule_support(spark, base):
    return rounded(models.rule_support(applications(spark, base), RULES))


# --- what-if, counterfactuals, mitigation --------------------------------------------------------


@query
def policy_impact(spark, base):
    return rounded(whatif.policy_impact(applications(spark, base), POLICY, SCORE))


@query
def policy_impact_by_group(spark, base):
    return rounded(whatif.policy_impact_by_group(applications(spark, base), POLICY, SCORE))


@query
def threshold_sweep(spark, base):
    return rounded(whatif.threshold_sweep(applications(spark, base), CUTOFFS, AUDITED))


@query
def counterfactual_grid(spark, base):
    grid = counterfactual.counterfactual_grid(applications(spark, base), SCORE, STEPS)
    return rounded(grid, 4)


@query
def counterfactual_rank(spark, base):
    ranked = counterfactual.counterfactuals(applications(spark, base), SCORE, STEPS)
    return rounded(ranked.select("application_id", "candidate_id", "position", "score"))


@query
def diversity(spark, base):
    grid = counterfactual.counterfactual_grid(applications(spark, base), SCORE, STEPS)
    spread = counterfactual.diversity(grid, list(SCORE.weights))
    return rounded(spread.select("application_id", "candidate_id", "diversity"))


@query
def reweigh(spark, base):
    weighted = mitigation.reweigh(applications(spark, base), "race")
    return rounded(weighted.select("application_id", "race", "approved", "weight"))


@query
def mitigated_fairness(spark, base):
    rows = applications(spark, base)
    return rounded(mitigation.mitigated_fairness(rows, "race", SIMPLE[:2], ("race",), max_iter=30))


# --- attribution ---------------------------------------------------------------------------------


@query
def linear_attribution(spark, base):
    return rounded(attribution.linear_attribution(explained_applications(spark, base), EXPLAINED_SCORE))


@query
def global_importance(spark, base):
    return rounded(attribution.global_importance(explained_applications(spark, base), EXPLAINED_SCORE))


@query
def protected_contribution(spark, base):
    importance = attribution.global_importance(explained_applications(spark, base), EXPLAINED_SCORE)
    return rounded(attribution.protected_contribution(importance))


@query
def local_attribution(spark, base):
    return rounded(attribution.local_attribution(explained_applications(spark, base), EXPLAINED_SCORE))


@query
def attribution_stability(spark, base):
    """Each region's five strongest features as one run."""
    ranked = attribution.global_importance(explained_applications(spark, base), EXPLAINED_SCORE, BY_REGION)
    runs = ranked.where(F.col("position") <= 5).select(
        F.col("region").alias("run"), "feature", F.col("importance").alias("contribution")
    )
    return rounded(attribution.attribution_stability(runs))


@query
def importance_by_category(spark, base):
    importance = attribution.global_importance(explained_applications(spark, base), EXPLAINED_SCORE)
    return rounded(attribution.importance_by_category(importance))


# --- monitoring ----------------------------------------------------------------------------------


def _snapshots(spark, base) -> DataFrame:
    return drift.window_snapshots(windowed_applications(spark, base), ("race", "gender"))


def _against_history(spark, base) -> tuple[DataFrame, DataFrame]:
    """Snapshots of all windows, and the snapshot of the whole history as their baseline."""
    return _snapshots(spark, base), drift.window_snapshots(applications(spark, base), ("race", "gender"), by=())


def _alerts(spark, base) -> DataFrame:
    alerts = drift.drift_alerts(drift.drift_summary(drift.all_drift(*_against_history(spark, base))))
    return alerts.persist()


def _dated(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("window_start", day("window_start")))


@query
def window_snapshots(spark, base):
    return _dated(_snapshots(spark, base))


@query
def statistical_drift(spark, base):
    return _dated(drift.statistical_drift(*_against_history(spark, base)))


@query
def fairness_drift(spark, base):
    return _dated(drift.fairness_drift(*_against_history(spark, base)))


@query
def drift_summary(spark, base):
    return _dated(drift.drift_summary(drift.all_drift(*_against_history(spark, base))))


@query
def drift_alerts(spark, base):
    return _dated(_alerts(spark, base))


@query
def monitoring_report(spark, base):
    return drift.monitoring_report(_alerts(spark, base), days=365)


@query
def alert_counts(spark, base):
    return drift.alert_counts(_alerts(spark, base), days=365)


@query
def ewma_baseline(spark, base):
    return _dated(drift.ewma_baseline(_snapshots(spark, base).where(F.col("family") != "fairness")))


@query
def drift_vs_previous(spark, base):
    return _dated(drift.drift_vs_previous(_snapshots(spark, base)))


def _decision_sums() -> dict:
    return {"n": F.lit(1), "approvals": F.col("approved"), "predicted_n": F.col("predicted")}


def _application_stream(spark, base) -> DataFrame:
    static = {t: star_table(spark, base, t) for t in ("orders", "customer", "nation", "region")}
    orders = monitor.stored_table_stream(spark, base, "orders.parquet", static["orders"].schema)
    return applications_from(orders, static["customer"], static["nation"], static["region"])


def _counts_by_day(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"window_start": day("window_start"), "window_end": day("window_end")})


@query
def stream_snapshots(spark, base):
    """Closed 30-day windows of the application stream, in append mode."""
    stream = _application_stream(spark, base)
    counts = monitor.windowed_counts(
        stream, "application_date", ["race"], _decision_sums(), "30 days", delay="60 days"
    )
    return _counts_by_day(monitor.drain_append(counts, work_dir(spark, "snapshots")))


@query
def stream_snapshots_complete(spark, base):
    """All 30-day windows of the application stream, in complete mode."""
    stream = _application_stream(spark, base)
    counts = monitor.windowed_counts(stream, "application_date", ["race"], _decision_sums(), "30 days")
    return _counts_by_day(monitor.drain_complete(counts, work_dir(spark, "complete")))


@query
def stream_alerts(spark, base):
    """Drift alerts of a monitor whose feed delivers one region after another.

    The monitor is stopped and restarted from its checkpoint between deliveries.
    """
    columns = ("race", "gender", "region", "credit_score", "predicted_probability", "predicted", "approved")
    rows = applications(spark, base).select(*columns)
    folder = work_dir(spark, "monitor")
    watcher = monitor.DriftMonitor(folder, ("race", "gender", "region"))
    for r in star_table(spark, base, "region").orderBy("r_name").collect():
        rows.where(F.col("region") == r["r_name"]).write.mode("append").parquet(f"{folder}/feed")
        watcher.run(monitor.table_stream(spark, f"{folder}/feed", "*.parquet", rows.schema))
    return watcher.alerts(spark)


def _deliveries() -> tuple:
    """Events of the first twenty days but a tenth, that tenth, the remaining days."""
    last = F.col("ts") >= F.lit("2024-01-21").cast("timestamp_ntz")
    tenth = F.col("event_id") % 10 == 0
    return ~last & ~tenth, ~last & tenth, last


@query
def late_events(spark, base):
    """Closed daily windows of an event stream whose tenth part arrives late.

    Three deliveries, with the stream restarted from its checkpoint for each: the punctual events
    of the first twenty days, their late tenth, and the remaining days. Spark drops a late row if
    its day had closed by then; the other late rows are counted.
    """
    events = star_table(spark, base, "events")
    folder = work_dir(spark, "late")
    sums = {"n": F.lit(1), "large_n": F.col("large")}
    for arriving in _deliveries():
        events.where(arriving).write.mode("append").parquet(f"{folder}/arrivals")
        stream = as_timed(monitor.table_stream(spark, f"{folder}/arrivals", "*.parquet", events.schema))
        counts = monitor.windowed_counts(stream, "ts", ["event_type"], sums, "1 day", delay="2 days")
        closed = monitor.drain_append(counts, folder)
    return _counts_by_day(closed)


@query
def late_accounts(spark, base):
    """How many events of each day and type were on time, late but counted, or dropped, for the deliveries of ``late_events``."""
    events = star_table(spark, base, "events")
    folder = work_dir(spark, "accounts")
    split = late.LateSplit(f"{folder}/split", "ts", "1 day", "2 days")
    schema = as_timed(events).schema
    for arriving in _deliveries():
        events.where(arriving).write.mode("append").parquet(f"{folder}/arrivals")
        split.run(as_timed(monitor.table_stream(spark, f"{folder}/arrivals", "*.parquet", events.schema)))
    window = F.window("ts", "1 day")["start"]
    counted = split.rows(spark, schema).groupBy(window.alias("window_start"), "event_type", "status")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("large").alias("large_n")).withColumn("window_start", day("window_start"))


def _snapshot_feed(spark, base, folder: str):
    """Stored snapshots, and a function that runs a stream over them in three deliveries, restarting it for each.

    Group shares are delivered one window behind the other values.
    """
    snapshots = _snapshots(spark, base)
    snapshots.write.mode("overwrite").parquet(f"{folder}/snapshots")
    snapshots = spark.read.schema(snapshots.schema).parquet(f"{folder}/snapshots")

    def run(rows: DataFrame, make) -> DataFrame:
        first, last = rows.agg(F.min("window_start"), F.max("window_start")).first()
        arrival = F.when(F.col("family") == "share", F.col("window_start") + F.expr("INTERVAL 30 DAYS")).otherwise(F.col("window_start"))
        out = None
        for i in range(3):
            start, stop = (first + (last - first) * k / 3 for k in (i, i + 1))
            arriving = (arrival >= F.lit(start) if i else F.lit(True)) & (arrival < F.lit(stop) if i < 2 else F.lit(True))
            rows.where(arriving).write.mode("append").parquet(f"{folder}/feed")
            stream = monitor.table_stream(spark, f"{folder}/feed", "*.parquet", rows.schema)
            out = baseline.drain_state(make(stream), folder)
        return out

    return snapshots, run


@query
def ewma_stream(spark, base):
    """The smoothed baselines of ``ewma_baseline`` kept in a stream's state, for windows that the watermark has passed."""
    snapshots, run = _snapshot_feed(spark, base, work_dir(spark, "ewma"))
    smooth = run(snapshots.where(F.col("family") != "fairness"), lambda stream: baseline.smoothed_stream(stream, delay="60 days"))
    return _dated(smooth.select("window_start", *drift.KEYS, "value", "baseline"))


@query
def stream_drift(spark, base):
    """The drifts of ``drift_vs_previous`` against baselines kept in a stream's state, which begins at the first window's snapshot."""
    snapshots, run = _snapshot_feed(spark, base, work_dir(spark, "drift"))
    first = F.col("window_start") == F.lit(snapshots.agg(F.min("window_start")).first()[0])
    initial = snapshots.where(first)
    return _dated(run(snapshots.where(~first), lambda stream: baseline.monitored(stream, initial, delay="60 days")))


@query
def sliding_counts(spark, base):
    counts = monitor.windowed_counts(
        timed_events(spark, base), "ts", ["event_type"], {"n": F.lit(1), "large_n": F.col("large")}, "2 days", slide="1 day"
    )
    return _counts_by_day(counts)


@query
def session_counts(spark, base):
    counts = monitor.session_counts(
        timed_events(spark, base), "ts", ["user_id"], {"n": F.lit(1), "large_n": F.col("large")}, "12 hours"
    )
    return counts.withColumns({"window_start": second("window_start"), "window_end": second("window_end")})
