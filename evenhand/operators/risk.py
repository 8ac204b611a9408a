"""Risk scores, compliance, rules and alerts from a metrics table.

Everything here is derived from ``assessment``, one aggregate of the (at most five scored) metric
rows of each segment and attribute; the rest are projections of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of each metric in the overall risk score.
WEIGHTS = {
    "four_fifths_rule": 0.4,
    "demographic_parity": 0.2,
    "equal_opportunity": 0.2,
    "predictive_parity": 0.1,
    "equalized_odds": 0.1,
}
# Score levels and alert limits.
MEDIUM_FROM, HIGH_FROM = 0.33, 0.66
ALERT_HIGH, ALERT_MEDIUM, ALERT_METRIC = 0.7, 0.4, 0.6

# Rule codes in their order.
RULE_CODES = (
    "URGENT_REVIEW",
    "REVIEW_CRITERIA",
    "MITIGATE",
    "INVESTIGATE_QUALIFIED",
    "ANALYZE_FACTORS",
    "RETRAIN_BALANCED",
    "MONITOR_FAIRNESS",
)
# Violation and alert texts.
IMPACT_VIOLATION = ("ECOA", "Failed Four-Fifths Rule")
PARITY_VIOLATION = ("Fair Housing Act", "Demographic Parity violation")
HIGH_MESSAGE = "High bias risk detected (score: %.2f)"
MEDIUM_MESSAGE = "Medium bias risk detected (score: %.2f)"
VIOLATION_MESSAGE = "Regulatory compliance violations detected: %d issues"
METRIC_MESSAGE = "Multiple fairness metrics failing: %d metrics"


def metric_risk(metric: Column, value: Column, threshold: Column) -> Column:
    """Metric value on a 0-1 scale: shortfall of the impact ratio, or a third of the excess gap."""
    impact = F.greatest(F.lit(0.0), F.lit(1.0) - value / threshold)
    gap = F.least(F.lit(1.0), value / (threshold * 3.0))
    return F.when(metric == "four_fifths_rule", impact).otherwise(gap)


def assessment(
    metrics: DataFrame, by: Sequence[str] = (), weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Scores, compliance and the facts the rules need, per segment and attribute.

    Each metric's risk is picked out by name and the weighted sum is taken in the order of the
    weights, so that scores do not depend on the order rows arrive in.
    """
    weights = dict(weights or WEIGHTS)
    scored = metrics.withColumn("risk", metric_risk(F.col("metric"), F.col("value"), F.col("threshold")))

    def of(metric: str, column: Column) -> Column:
        return F.max(F.when(F.col("metric") == metric, column))

    failed = ~F.col("passed")
    facts = scored.groupBy(*by, "attribute").agg(
        *[of(m, F.col("risk")).alias(f"risk_of_{m}") for m in weights],
        of("four_fifths_rule", failed).alias("impact_failed"),
        of("four_fifths_rule", F.col("severity")).alias("impact_severity"),
        of("four_fifths_rule", F.col("impacted_group")).alias("impact_group"),
        of("demographic_parity", failed).alias("parity_failed"),
        of("demographic_parity", F.col("severity")).alias("parity_severity"),
        of("demographic_parity", F.col("value") > F.col("threshold") * 1.5).alias("parity_strong"),
        of("equal_opportunity", failed).alias("opportunity_failed"),
    )
    risk_sum = weight_sum = F.lit(0.0)
    scores = []
    for m, w in weights.items():
        risk, weight = F.col(f"risk_of_{m}"), F.lit(float(w))
        risk_sum = risk_sum + F.coalesce(risk * weight, F.lit(0.0))
        weight_sum = weight_sum + F.when(risk.isNotNull(), weight).otherwise(0.0)
        entry = F.struct(
            F.lit(m).alias("metric"),
            risk.alias("risk"),
            weight.alias("weight"),
            (risk * weight).alias("weighted_risk"),
        )
        scores.append(F.when(risk.isNotNull(), entry))
    flags = ("impact_failed", "parity_failed", "parity_strong", "opportunity_failed")
    facts = facts.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    facts = facts.withColumns(
        {
            "overall_risk_score": F.coalesce(F.try_divide(risk_sum, weight_sum), F.lit(0.0)),
            "metric_scores": F.array_compact(F.array(*scores)),
        }
    )
    level = F.col("overall_risk_score")
    breaches = (("impact", IMPACT_VIOLATION), ("parity", PARITY_VIOLATION))
    violations = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"{name}_failed"),
                    F.struct(
                        F.lit(regulation).alias("regulation"),
                        F.lit(text).alias("violation"),
                        F.col(f"{name}_severity").alias("severity"),
                    ),
                )
                for name, (regulation, text) in breaches
            ]
        )
    )
    return facts.withColumns(
        {
            "severity": F.when(level < MEDIUM_FROM, "Low").when(level < HIGH_FROM, "Medium").otherwise("High"),
            "color": F.when(level < MEDIUM_FROM, "green").when(level < HIGH_FROM, "yellow").otherwise("red"),
            "ecoa_ok": ~F.col("impact_failed"),
            "fha_ok": ~F.col("parity_failed"),
            "state_ok": F.lit(True),
            "compliant": ~(F.col("impact_failed") | F.col("parity_failed")),
            "violations": violations,
            "rules": _rules(level),
        }
    )


def _rules(level: Column) -> Column:
    """Fired rules in their fixed order, as (ordinal, code, group)."""
    urgent, elevated = level > HIGH_FROM, level > MEDIUM_FROM
    group = F.coalesce("impact_group", F.lit("minority groups"))
    conditions = (
        urgent,
        F.col("impact_failed"),
        F.col("parity_strong"),
        F.col("opportunity_failed"),
        elevated,
        elevated,
        elevated,
    )
    entries = [
        F.when(
            condition,
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(code).alias("code"),
                (group if code == "REVIEW_CRITERIA" else F.lit(None).cast("string")).alias("grp"),
            ),
        )
        for i, (code, condition) in enumerate(zip(RULE_CODES, conditions, strict=True), 1)
    ]
    return F.array_compact(F.array(*entries))


def risk_score(
    metrics: DataFrame, by: Sequence[str] = (), weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Weighted risk score over the metrics present, with level, compliance and detail."""
    return assessment(metrics, by, weights).select(
        *by,
        "attribute",
        "overall_risk_score",
        "severity",
        "color",
        "ecoa_ok",
        "fha_ok",
        "state_ok",
        "compliant",
        "metric_scores",
        "violations",
    )


def worst_case_risk(risk: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The riskiest attribute of each segment."""
    worst = risk.groupBy(*by).agg(
        F.min(F.struct((-F.col("overall_risk_score")).alias("key"), "attribute", "overall_risk_score")).alias("w")
    )
    return worst.select(*by, "w.attribute", "w.overall_risk_score")


def compliance(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Regulation flags and the list of violations."""
    return assessment(metrics, by).select(
        *by, "attribute", "ecoa_ok", "fha_ok", "state_ok", "compliant", "violations"
    )


def triggered_rules(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per fired review rule, as a code."""
    fired = assessment(metrics, by).select(*by, "attribute", F.explode("rules").alias("rule"))
    return fired.select(*by, "attribute", "rule.*")


def portfolio_alerts(
    metrics: DataFrame, by: Sequence[str] = (), priority: str | None = None
) -> DataFrame:
    """Alerts on score level, violations and single high-risk metrics."""
    level = F.col("overall_risk_score")
    codes = F.transform("rules", lambda r: r["code"])
    risky = F.filter("metric_scores", lambda s: s["risk"] > ALERT_METRIC)

    def alert(kind: str, urgency: str, message: Column, details: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            F.lit(urgency).alias("priority"),
            message.alias("message"),
            F.lit(True).alias("action_required"),
            details.alias("details"),
        )

    high = alert(
        "HIGH_RISK",
        "CRITICAL",
        F.format_string(HIGH_MESSAGE, level),
        F.slice(codes, 1, 3),
    )
    medium = alert(
        "MEDIUM_RISK",
        "HIGH",
        F.format_string(MEDIUM_MESSAGE, level),
        F.slice(codes, 1, 2),
    )
    violation = alert(
        "COMPLIANCE_VIOLATION",
        "CRITICAL",
        F.format_string(VIOLATION_MESSAGE, F.size("violations")),
        F.transform("violations", lambda v: F.concat_ws(": ", v["regulation"], v["violation"], v["severity"])),
    )
    metric = alert(
        "METRIC_FAILURE",
        "HIGH",
        F.format_string(METRIC_MESSAGE, F.size(risky)),
        F.transform(risky, lambda s: s["metric"]),
    )
    alerts = F.array_compact(
        F.array(
            F.when(level >= ALERT_HIGH, high).when(level >= ALERT_MEDIUM, medium),
            F.when(~F.col("compliant"), violation),
            F.when(F.size(risky) > 0, metric),
        )
    )
    table = assessment(metrics, by).select(*by, "attribute", F.explode(alerts).alias("a")).select(
        *by, "attribute", "a.*"
    )
    return table if priority is None else table.where(F.col("priority") == priority.upper())


def high_risk_metrics(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Names of the metrics with high severity and the resulting bias severity."""
    high = F.when(F.col("severity") == "High", F.col("metric"))
    return (
        metrics.groupBy(*by, "attribute")
        .agg(F.array_sort(F.collect_set(high)).alias("high_risk_metrics"))
        .withColumn("bias_severity", F.when(F.size("high_risk_metrics") > 0, "High").otherwise("Low"))
    )
