"""Quick impact ratios, attribute intersections and geography."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.joins import null_safe_on
from evenhand.functions.stats import ratio
from evenhand.operators.cube import cells, cells_to_groups

IMPACT_LIMIT = 0.8
INTERSECTION_LIMIT = 0.2
HOTSPOT_RISK = 0.7


def _approval_cells(df: DataFrame, attributes: Sequence[str], outcome: str, by: Sequence[str]) -> DataFrame:
    y = F.col(outcome).cast("int")
    known = df.where(F.col(outcome).isNotNull())
    return cells(known, attributes, {"n": F.lit(1), "approvals": y}, by)


def quick_impact(
    df: DataFrame,
    attributes: Sequence[str],
    outcome: str = "approved",
    threshold: float = IMPACT_LIMIT,
    by: Sequence[str] = (),
) -> DataFrame:
    """Lowest over highest approval rate per attribute; 0 where nobody was approved."""
    sums = ("n", "approvals")
    groups = cells_to_groups(_approval_cells(df, attributes, outcome, by), attributes, sums, by)
    rate = ratio(F.col("approvals"), F.col("n"))
    extremes = groups.groupBy(*by, "attribute").agg(F.min(rate).alias("low"), F.max(rate).alias("high"))
    impact = F.coalesce(F.try_divide(F.col("low"), F.col("high")), F.lit(0.0))
    return extremes.select(*by, "attribute", impact.alias("impact_ratio")).withColumn(
        "has_disparate_impact", F.col("impact_ratio") < threshold
    )


def intersection_impact(
    df: DataFrame,
    attributes: Sequence[str],
    outcome: str = "approved",
    threshold: float = IMPACT_LIMIT,
    by: Sequence[str] = (),
) -> DataFrame:
    """Approval rate of every combination of attribute values relative to the overall rate.

    Combinations nobody belongs to are listed too, with a NULL ratio. They come from exploding the
    attributes' value lists, which are read off the cells: the output has one row per combination
    by definition, and no two tables are crossed. The first attribute's values are spread over the
    cluster before the others are expanded. The cells, a small aggregate, are cached because both
    the value lists and the rates come from them.
    """
    cell_table = _approval_cells(df, attributes, outcome, by).persist()
    totals = cell_table.groupBy(*by).agg(
        F.sum("approvals").alias("all_approvals"),
        F.sum("n").alias("all_n"),
        *[F.collect_set(a).alias(a) for a in attributes],
    )
    combos = totals.select(*by, ratio(F.col("all_approvals"), F.col("all_n")).alias("overall_rate"), *attributes)
    for i, a in enumerate(attributes):
        combos = combos.withColumn(a, F.explode(a))
        if i == 0:
            combos = combos.repartition(*by, a)
    keys = [*by, *attributes]
    rates = cell_table.select(*keys, ratio(F.col("approvals"), F.col("n")).alias("group_rate"))
    joined = combos.join(rates, null_safe_on(combos, rates, keys), "left")
    impact = F.when(F.col("overall_rate") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("group_rate"), F.col("overall_rate"))
    )
    return joined.select(*[combos[k] for k in keys], impact.alias("impact_ratio")).withColumn(
        "has_disparate_impact", F.coalesce(F.col("impact_ratio") < threshold, F.lit(False))
    )


def redlining(
    df: DataFrame, demographics: DataFrame, location: str = "zip_code", outcome: str = "approved"
) -> DataFrame:
    """Locations whose approval rate lies more than two standard deviations below the mean.

    Only locations known to ``demographics`` count. Applications are summed per location before
    the two are matched, so the join sees one row per location; it is a semi join because extra
    demographic rows of a location would repeat its applications and leave its rate unchanged.
    """
    y = F.col(outcome).cast("int")
    per_location = (
        df.where(F.col(location).isNotNull() & F.col(outcome).isNotNull())
        .groupBy(location)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("approvals"))
    )
    rates = per_location.join(demographics.select(location), location, "left_semi").select(
        location, "n", "approvals", ratio(F.col("approvals"), F.col("n")).alias("rate")
    )
    limit = rates.agg((F.avg("rate") - 2 * F.stddev_samp("rate")).alias("limit")).scalar()
    return rates.where(F.col("rate") < limit)


def location_risk(risk: DataFrame, location: str) -> DataFrame:
    """Worst risk score of each location over its audited attributes."""
    return risk.groupBy(location).agg(F.max("overall_risk_score").alias("risk_score"))


def redlining_hotspots(
    risks: DataFrame, location: str, threshold: float = HOTSPOT_RISK, listed: int = 5
) -> DataFrame:
    """The riskiest locations above the threshold and the number of all such locations.

    The hot locations, one row each, are cached because they are both counted and ranked.
    """
    hot = risks.where(F.col("risk_score") > threshold).persist()
    total = hot.agg(F.count(F.lit(1))).scalar()
    return (
        hot.orderBy(F.col("risk_score").desc(), location)
        .limit(listed)
        .select(F.col(location), "risk_score", total.alias("n_hotspots"))
    )


def combination_disparity(rates: DataFrame, combination: str = "level", by: Sequence[str] = ()) -> DataFrame:
    """Best minus worst approval rate within each attribute combination of a grouped cube."""
    return rates.groupBy(*by, combination).agg((F.max("rate") - F.min("rate")).alias("disparity"))


def worst_intersection(
    disparities: DataFrame,
    combination: str = "level",
    threshold: float = INTERSECTION_LIMIT,
    by: Sequence[str] = (),
) -> DataFrame:
    """The combination with the largest disparity, if that reaches the threshold."""
    worst = disparities.groupBy(*by).agg(
        F.min(F.struct((-F.col("disparity")).alias("key"), combination, "disparity")).alias("w")
    )
    return worst.select(*by, f"w.{combination}", "w.disparity").where(F.col("disparity") >= threshold)


def group_ranking(group_rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Groups ranked by approval rate within each attribute, with best, worst and gap to best.

    The input holds one pre-aggregated row per group.
    """
    order = Window.partitionBy(*by, "attribute").orderBy(F.col("rate").desc(), "grp")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bottom = F.struct(F.col("rate"), F.col("grp"))
    return group_rates.select(
        *by,
        "attribute",
        "grp",
        "rate",
        F.row_number().over(order).alias("position"),
        F.first("grp").over(whole).alias("best_group"),
        F.min(bottom).over(whole)["grp"].alias("worst_group"),
        (F.first("rate").over(whole) - F.col("rate")).alias("gap_to_best"),
    )


def distinct_groups(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Distinct non-NULL values of each attribute, read off one pass over their combinations."""
    combos = df.select(*[F.col(a).cast("string").alias(a) for a in attributes]).distinct()
    values = combos.unpivot([], list(attributes), "attribute", "grp")
    return values.where(F.col("grp").isNotNull()).distinct()
