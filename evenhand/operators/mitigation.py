"""Bias mitigation by reweighing the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.joins import join_small
from evenhand.operators.fairness import all_metrics, compare_metrics
from evenhand.operators.models import decide, logistic_fit


def reweighing_table(df: DataFrame, attribute: str, label: str = "approved") -> DataFrame:
    """Weight P(group) P(label) / P(group, label) of every group and label (Kamiran and Calders).

    The margins are window sums over the joint counts, which hold one row per group and label.
    """
    joint = (
        df.where(F.col(attribute).isNotNull() & F.col(label).isNotNull())
        .groupBy(attribute, label)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n = F.sum("n")
    margins = joint.withColumns(
        {
            "n_group": n.over(Window.partitionBy(attribute)),
            "n_label": n.over(Window.partitionBy(label)),
            "n_all": n.over(Window.partitionBy(F.lit(0))),
        }
    )
    expected = F.col("n_group").cast("double") * F.col("n_label") / F.col("n_all")
    return margins.select(attribute, label, "n", (expected / F.col("n")).alias("weight"))


def reweigh(df: DataFrame, attribute: str, label: str = "approved", weight: str = "weight") -> DataFrame:
    """Rows with their weight; under the weights the label is independent of the group."""
    table = reweighing_table(df, attribute, label).select(attribute, label, F.col("weight").alias(weight))
    return join_small(df, table, [attribute, label])


def mitigated_fairness(
    df: DataFrame,
    attribute: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    label: str = "approved",
    max_iter: int = 1000,
) -> DataFrame:
    """Fairness metrics of a plain and of a reweighed logistic model, side by side."""
    def audited(training: DataFrame, weight: str | None) -> DataFrame:
        model = logistic_fit(training, numeric, categorical, label, weight, max_iter=max_iter)
        return all_metrics(decide(df, model, "model_decision"), [attribute], "model_decision")

    return compare_metrics(audited(df, None), audited(reweigh(df, attribute, label), "weight"))
