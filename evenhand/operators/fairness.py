"""Fairness metrics from the rate cube.

``attribute_summary`` reduces a cube to one row per segment and attribute. It is a single linear
plan over the cube (a window and an aggregate that share one exchange), so the applications are
read once however many metrics are asked for. The window's partitions hold pre-aggregated groups,
one row per distinct value of an attribute within a segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.stats import chi_square_p_value, ratio, yates_chi_square
from evenhand.operators.cube import intersection_cube, model_cube, rate_cube

# Metric keys, display names, thresholds and regulations.
METRICS = {
    "four_fifths_rule": ("Disparate Impact (Four-Fifths Rule)", 0.8, "ECOA"),
    "demographic_parity": ("Demographic Parity Difference", 0.1, "Fair Housing Act"),
    "equal_opportunity": ("Equal Opportunity Difference", 0.1, "ECOA"),
    "predictive_parity": ("Predictive Parity", 0.1, "ECOA"),
    "equalized_odds": ("Equalized Odds", 0.1, "ECOA"),
    "intersectional_summary": ("Intersectional Disparity", 0.2, None),
}
MARGINAL_IMPACT = 0.7
SEVERE_INTERSECTION = 0.3
STANDARD_METRICS = tuple(m for m in METRICS if m != "intersectional_summary")


def group_rates(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, approvals, rate and the unclamped 95 % interval of the rate for every group."""
    rate = F.coalesce(ratio(F.col("approvals"), F.col("n")), F.lit(0.0))
    spread = F.lit(1.96) * F.coalesce(
        F.sqrt(F.try_divide(F.col("rate") * (F.lit(1.0) - F.col("rate")), F.col("n").cast("double"))), F.lit(0.0)
    )
    return (
        cube.select(*by, "attribute", "grp", "n", "approvals")
        .withColumn("rate", rate)
        .withColumns({"ci_low": F.col("rate") - spread, "ci_high": F.col("rate") + spread})
    )


def _requested(references: Mapping[str, str] | None) -> Column:
    """The caller's reference group of the row's attribute, NULL if none was named."""
    if not references:
        return F.lit(None).cast("string")
    pairs = [F.lit(str(part)) for pair in references.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), F.col("attribute"))


def _high(rate: str, *extra: str) -> Column:
    """Smallest such struct belongs to the highest rate, first name on ties."""
    return F.struct((-F.col(rate)).alias("key"), "grp", F.col(rate).alias("rate"), *extra)


def _low(rate: str, *extra: str) -> Column:
    return F.struct(F.col(rate).alias("key"), "grp", F.col(rate).alias("rate"), *extra)


def attribute_summary(
    cube: DataFrame, by: Sequence[str] = (), references: Mapping[str, str] | None = None
) -> DataFrame:
    """Everything the metrics need, one row per segment and attribute.

    The reference group of ``impact`` is the requested one if it exists, else the one with the
    highest rate; ties go to the first name. For the rate among qualified applicants a requested
    group without qualified members counts with rate 0.
    """
    keys = [*by, "attribute"]
    groups = cube.withColumns(
        {
            "rate": ratio(F.col("approvals"), F.col("n")),
            "tpr": ratio(F.col("appr_qual"), F.col("n_qual")),
            "fpr": ratio(F.col("appr_unqual"), F.col("n_unqual")),
            "precision": ratio(F.col("appr_pred"), F.col("n_pred")),
            "requested": _requested(references),
        }
    ).where(F.col("rate").isNotNull())
    within = Window.partitionBy(*keys)
    is_requested = F.col("grp") == F.col("requested")
    counts = ("n", "approvals")
    with_reference = groups.withColumn(
        "ref",
        F.coalesce(
            F.min(F.when(is_requested, _high("rate", *counts))).over(within),
            F.min(_high("rate", *counts)).over(within),
        ),
    )
    has_tpr = F.col("tpr").isNotNull()
    tpr, fpr = F.coalesce("tpr", F.lit(0.0)), F.coalesce("fpr", F.lit(0.0))
    summary = with_reference.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n"),
        F.sum("approvals").alias("approvals"),
        F.min("ref").alias("ref"),
        F.min(F.when(F.col("grp") != F.col("ref.grp"), _low("rate", *counts))).alias("worst"),
        F.min(_high("rate")).alias("top"),
        F.min(_low("rate")).alias("bottom"),
        F.max("requested").alias("requested"),
        F.min(F.when(has_tpr, _high("tpr"))).alias("qual_top"),
        F.min(F.when(has_tpr, _low("tpr"))).alias("qual_bottom"),
        F.max(F.when(has_tpr & is_requested, F.col("tpr"))).alias("qual_requested"),
        F.sum("n_pred").alias("n_pred"),
        (F.max("precision") - F.min("precision")).alias("precision_gap"),
        (F.max(tpr) - F.min(tpr)).alias("tpr_gap"),
        (F.max(fpr) - F.min(fpr)).alias("fpr_gap"),
    )
    return summary


def _gap_to_reference(top: str, bottom: str, ref_rate: Column) -> tuple[Column, Column]:
    """Largest distance of any group to the reference rate, and the group that has it."""
    above = F.col(f"{top}.rate") - ref_rate
    below = ref_rate - F.col(f"{bottom}.rate")
    gap = F.coalesce(F.greatest(above, below), F.lit(0.0))
    first = F.least(F.col(f"{top}.grp"), F.col(f"{bottom}.grp"))
    group = (
        F.when(gap <= 0, F.lit(None).cast("string"))
        .when(above == below, first)
        .when(above > below, F.col(f"{top}.grp"))
        .otherwise(F.col(f"{bottom}.grp"))
    )
    return gap, group


def _impact(summary: DataFrame, pair: str) -> DataFrame:
    """Adds ratio, impacted group, chi-square and p-value to the summary.

    ``pair="ref_and_worst"`` tests reference and worst group together against everyone else, as
    the audit defines it; ``"ref_vs_worst"`` tests the two against each other.
    """
    usable = F.col("worst").isNotNull() & (F.col("ref.rate") > 0)
    ref_n, ref_y = F.col("ref.n"), F.col("ref.approvals")
    worst_n, worst_y = F.col("worst.n"), F.col("worst.approvals")
    if pair == "ref_vs_worst":
        table = (ref_y, ref_n - ref_y, worst_y, worst_n - worst_y)
    elif pair == "ref_and_worst":
        pair_y, pair_n = ref_y + worst_y, ref_n + worst_n
        rest_y, rest_n = F.col("approvals") - pair_y, F.col("n") - pair_n
        table = (pair_y, pair_n - pair_y, rest_y, rest_n - rest_y)
    else:
        raise ValueError(f"unknown pair mode: {pair!r}")
    return summary.withColumns(
        {
            "impact_ratio": F.when(usable, F.try_divide(F.col("worst.rate"), F.col("ref.rate"))).otherwise(1.0),
            "impacted": F.when(usable, F.col("worst.grp")),
            "chi_square": F.when(usable, yates_chi_square(*table)).otherwise(0.0),
        }
    ).withColumn("p_value", chi_square_p_value(F.col("chi_square")))


def _threshold(metric: str, overrides: Mapping[str, Mapping] | None) -> float:
    return float((overrides or {}).get(metric, {}).get("threshold", METRICS[metric][1]))


def _gap_severity(value: Column, threshold: float) -> Column:
    return F.when(value < threshold, "Low").when(value < threshold * 2, "Medium").otherwise("High")


def _metric_row(
    metric: str,
    value: Column,
    passed: Column,
    severity: Column,
    thresholds: Mapping[str, Mapping] | None,
    reference: Column | None = None,
    impacted: Column | None = None,
    p_value: Column | None = None,
) -> Column:
    name, _, regulation = METRICS[metric]
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(metric).alias("metric"),
        F.lit(name).alias("metric_name"),
        value.cast("double").alias("value"),
        F.lit(_threshold(metric, thresholds)).alias("threshold"),
        passed.alias("passed"),
        severity.alias("severity"),
        F.lit(regulation).cast("string").alias("regulation"),
        (text if reference is None else reference).alias("reference_group"),
        (text if impacted is None else impacted).alias("impacted_group"),
        (F.lit(None).cast("double") if p_value is None else p_value).alias("p_value"),
    )


def metric_table(
    cube: DataFrame,
    by: Sequence[str] = (),
    references: Mapping[str, str] | None = None,
    thresholds: Mapping[str, Mapping] | None = None,
    metrics: Sequence[str] = STANDARD_METRICS,
    pair: str = "ref_and_worst",
) -> DataFrame:
    """One row per segment, attribute and requested metric."""
    summary = _impact(attribute_summary(cube, by, references), pair)
    rows = []
    for metric in metrics:
        limit = _threshold(metric, thresholds)
        if metric == "four_fifths_rule":
            value = F.col("impact_ratio")
            marginal = float((thresholds or {}).get(metric, {}).get("marginal_threshold", MARGINAL_IMPACT))
            severity = F.when(value >= limit, "Low").when(value >= marginal, "Medium").otherwise("High")
            details = (F.col("ref.grp"), F.col("impacted"), F.col("p_value"))
            rows.append(_metric_row(metric, value, value >= limit, severity, thresholds, *details))
            continue
        reference = impacted = None
        if metric == "demographic_parity":
            reference = F.col("ref.grp")
            value, impacted = _gap_to_reference("top", "bottom", F.col("ref.rate"))
        elif metric == "equal_opportunity":
            requested_rate = F.coalesce("qual_requested", F.lit(0.0))
            ref_rate = F.when(F.col("requested").isNull(), F.col("qual_top.rate")).otherwise(requested_rate)
            reference = F.when(
                F.col("qual_top").isNotNull(), F.coalesce("requested", F.col("qual_top.grp"))
            )
            value, impacted = _gap_to_reference("qual_top", "qual_bottom", ref_rate)
        elif metric == "predictive_parity":
            value = F.coalesce("precision_gap", F.lit(0.0))
        elif metric == "equalized_odds":
            value = (F.col("tpr_gap") + F.col("fpr_gap")) / 2.0
        elif metric == "intersectional_summary":
            value, impacted = F.col("top.rate") - F.col("bottom.rate"), F.col("bottom.grp")
            severity = (
                F.when(value > SEVERE_INTERSECTION, "High").when(value > limit, "Medium").otherwise("Low")
            )
            rows.append(_metric_row(metric, value, value < limit, severity, thresholds, None, impacted))
            continue
        else:
            raise ValueError(f"unknown metric: {metric!r}")
        severity = _gap_severity(value, limit)
        row = _metric_row(metric, value, value < limit, severity, thresholds, reference, impacted)
        if metric == "predictive_parity":
            row = F.when(F.col("n_pred").isNotNull(), row)
        rows.append(row)
    exploded = summary.select(*by, "attribute", F.explode(F.array_compact(F.array(*rows))).alias("m"))
    return exploded.select(*by, "attribute", "m.*")


def disparate_impact(df: DataFrame, attributes: Sequence[str], outcome: str = "approved", **options) -> DataFrame:
    """Lowest approval rate relative to the reference group (four-fifths rule)."""
    return _single("four_fifths_rule", df, attributes, outcome, **options)


def demographic_parity(df: DataFrame, attributes: Sequence[str], outcome: str = "approved", **options) -> DataFrame:
    """Largest distance of an approval rate to the reference group's."""
    return _single("demographic_parity", df, attributes, outcome, **options)


def equal_opportunity(df: DataFrame, attributes: Sequence[str], outcome: str = "approved", **options) -> DataFrame:
    """Demographic parity among qualified applicants."""
    return _single("equal_opportunity", df, attributes, outcome, **options)


def predictive_parity(df: DataFrame, attributes: Sequence[str], outcome: str = "approved", **options) -> DataFrame:
    """Spread of the approval rate among applicants predicted to be approved."""
    return _single("predictive_parity", df, attributes, outcome, **options)


def equalized_odds(df: DataFrame, attributes: Sequence[str], outcome: str = "approved", **options) -> DataFrame:
    """Mean of the spreads of the approval rates among qualified and unqualified applicants."""
    return _single("equalized_odds", df, attributes, outcome, **options)


def _single(metric, df, attributes, outcome, by=(), references=None, thresholds=None, **options) -> DataFrame:
    cube = rate_cube(df, attributes, outcome, by, **options)
    return metric_table(cube, by, references, thresholds, (metric,))


def all_metrics(
    df: DataFrame,
    attributes: Sequence[str],
    outcome: str = "approved",
    by: Sequence[str] = (),
    references: Mapping[str, str] | None = None,
    thresholds: Mapping[str, Mapping] | None = None,
    **counter_options,
) -> DataFrame:
    """All metrics of all attributes; predictive parity only where a probability column exists."""
    cube = rate_cube(df, attributes, outcome, by, **counter_options)
    return metric_table(cube, by, references, thresholds)


def audit_models(
    df: DataFrame,
    attributes: Sequence[str],
    outcomes: Mapping[str, str],
    by: Sequence[str] = (),
    references: Mapping[str, str] | None = None,
    thresholds: Mapping[str, Mapping] | None = None,
    **counter_options,
) -> DataFrame:
    """``all_metrics`` of several models at once, keyed by model, from one scan."""
    cube = model_cube(df, attributes, outcomes, by, **counter_options)
    return metric_table(cube, ["model", *by], references, thresholds)


def intersectional_metrics(
    df: DataFrame,
    attributes: Sequence[str],
    outcome: str = "approved",
    by: Sequence[str] = (),
    thresholds: Mapping[str, Mapping] | None = None,
    **counter_options,
) -> DataFrame:
    """All metrics of the joint groups plus the spread between best and worst joint group."""
    cube = intersection_cube(df, attributes, outcome, by, **counter_options)
    return metric_table(cube, by, None, thresholds, tuple(METRICS))


def chi_square_pair(
    cube: DataFrame,
    by: Sequence[str] = (),
    references: Mapping[str, str] | None = None,
    pair: str = "ref_and_worst",
) -> DataFrame:
    """Significance test behind the four-fifths rule."""
    return _impact(attribute_summary(cube, by, references), pair).select(
        *by,
        "attribute",
        F.col("ref.grp").alias("reference_group"),
        F.col("impacted").alias("impacted_group"),
        "chi_square",
        "p_value",
    )


def union_metrics(*tables: DataFrame) -> DataFrame:
    """Metric tables of several audits; every row keeps its key, nothing is overwritten."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def compare_metrics(baseline: DataFrame, mitigated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Change of every metric present in both tables."""
    keys = [*by, "attribute", "metric"]
    before = baseline.select(*keys, F.col("value").alias("baseline"), F.col("passed").alias("passed_baseline"))
    after = mitigated.select(*keys, F.col("value").alias("mitigated"), F.col("passed").alias("passed_mitigated"))
    gain = F.col("baseline") - F.col("mitigated")
    return before.join(after, keys).select(
        *keys,
        "baseline",
        "mitigated",
        gain.alias("improvement"),
        F.coalesce(F.try_divide(gain, F.col("baseline")) * 100.0, F.lit(0.0)).alias("percent_improvement"),
        "passed_baseline",
        "passed_mitigated",
    )
