"""Portfolio figures and numeric profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.stats import ratio
from evenhand.operators.cube import cells, cells_to_groups
from evenhand.operators.quantiles import exact_medians


def _rate(outcome: str) -> Column:
    return F.avg(F.col(outcome).cast("double"))


def portfolio_kpis(df: DataFrame, by: Sequence[str] = (), outcome: str = "approved") -> DataFrame:
    """Number of applications, approval rate, mean loan amount and mean credit score."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("applications"),
        _rate(outcome).alias("approval_rate"),
        F.avg("loan_amount").alias("avg_loan_amount"),
        F.avg("credit_score").alias("avg_credit_score"),
    )


def region_summary(df: DataFrame, region: str = "region", outcome: str = "approved") -> DataFrame:
    """Approval rate, number of applications and mean income per region."""
    return (
        df.where(F.col(region).isNotNull())
        .groupBy(region)
        .agg(
            _rate(outcome).alias("approval_rate"),
            F.count("application_id").alias("applications"),
            F.avg("annual_income").alias("avg_income"),
        )
    )


def approval_by_group(df: DataFrame, attributes: Sequence[str], outcome: str = "approved") -> DataFrame:
    """Mean outcome per group of each attribute, from one pass."""
    known = df.where(F.col(outcome).isNotNull())
    sums = {"n": F.lit(1), "approvals": F.col(outcome).cast("int")}
    groups = cells_to_groups(cells(known, attributes, sums), attributes, list(sums))
    return groups.select("attribute", "grp", ratio(F.col("approvals"), F.col("n")).alias("approval_rate"))


def value_shares(df: DataFrame, attributes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of each value among the non-NULL values of its attribute.

    The total is a window over the value counts, one pre-aggregated row per value.
    """
    groups = cells_to_groups(cells(df, attributes, {"n": F.lit(1)}, by), attributes, ["n"], by)
    total = F.sum("n").over(Window.partitionBy(*by, "attribute"))
    return groups.withColumn("share", ratio(F.col("n"), total))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, exact median and sample standard deviation, one row per column."""
    medians = exact_medians(df, columns)
    aggregates = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"{c}__mean") for c in columns],
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__std") for c in columns],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"{c}__mean").alias("mean"),
            F.lit(medians[c]).cast("double").alias("median"),
            F.col(f"{c}__std").alias("std"),
        )
        for c in columns
    ]
    return aggregates.select(F.inline(F.array(*rows)))


def approximate_profile(df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Like ``numeric_profile`` in a single scan, with a median of bounded rank error."""
    aggregates = []
    for c in columns:
        x = F.col(c).cast("double")
        median = F.percentile_approx(x, 0.5, accuracy)
        aggregates.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(x).alias("mean"),
                median.alias("median"),
                F.stddev_samp(x).alias("std"),
            )
        )
    return df.agg(F.array(*aggregates).alias("rows")).select(F.inline("rows"))


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each pair of columns."""
    rows = [
        F.struct(
            F.lit(x).alias("x"),
            F.lit(y).alias("y"),
            F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("correlation"),
        )
        for x, y in pairs
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def pricing_gap(
    df: DataFrame,
    attribute: str,
    reference: str | None = None,
    rate: str = "approved_interest_rate",
    outcome: str = "approved",
) -> DataFrame:
    """Mean rate charged to each group and its distance to the reference group.

    The reference is the named group, or the one with the lowest mean rate.
    """
    groups = (
        df.where((F.col(outcome) == 1) & F.col(attribute).isNotNull())
        .groupBy(F.col(attribute).cast("string").alias("grp"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(rate).alias("avg_rate"))
    )
    rate_of = F.col("avg_rate") if reference is None else F.when(F.col("grp") == reference, F.col("avg_rate"))
    base = F.min(rate_of).over(Window.partitionBy("attribute"))
    return groups.select(F.lit(attribute).alias("attribute"), "grp", "n", "avg_rate").withColumn(
        "gap", F.col("avg_rate") - base
    )
