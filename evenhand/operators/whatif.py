"""Policy what-if: decisions before and after a rule change, and under other cutoffs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.lending import policy_value
from evenhand.functions.stats import ratio
from evenhand.operators.cube import cells, cells_to_groups
from evenhand.operators.models import Model, decide

PROTECTED = ("race", "gender", "age_group", "region")
SIGNIFICANT_CHANGE = 0.1


def policy_rewrite(df: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """Features after the policy; features the table lacks are ignored."""
    changed = {f: policy_value(F.col(f), rule) for f, rule in rules.items() if f in df.columns}
    return df.withColumns(changed) if changed else df


def policy_decisions(df: DataFrame, rules: Mapping[str, Mapping], model: Model) -> DataFrame:
    """The table with ``baseline`` and ``modified`` decisions side by side, from one scan."""
    touched = [f for f in rules if f in df.columns]
    before = decide(df, model, "baseline")
    kept = before.withColumns({f"before__{f}": F.col(f) for f in touched}) if touched else before
    after = decide(policy_rewrite(kept, rules), model, "modified")
    restored = {f: F.col(f"before__{f}") for f in touched}
    return after.withColumns(restored).drop(*[f"before__{f}" for f in touched]) if touched else after


def _change(baseline: Column, modified: Column) -> dict[str, Column]:
    change = modified - baseline
    return {
        "baseline_rate": baseline,
        "modified_rate": modified,
        "change": change,
        "percent_change": F.coalesce(F.try_divide(change, baseline) * 100.0, F.lit(0.0)),
    }


def policy_impact(df: DataFrame, rules: Mapping[str, Mapping], model: Model) -> DataFrame:
    """Overall approval rate before and after, and how many decisions changed."""
    totals = policy_decisions(df, rules, model).agg(
        F.avg("baseline").alias("b"),
        F.avg("modified").alias("m"),
        F.count_if(F.col("baseline") != F.col("modified")).alias("affected_applications"),
    )
    columns = _change(F.col("b"), F.col("m"))
    return totals.select(*[c.alias(n) for n, c in columns.items()], "affected_applications")


def policy_impact_by_group(
    df: DataFrame,
    rules: Mapping[str, Mapping],
    model: Model,
    attributes: Sequence[str] = PROTECTED,
) -> DataFrame:
    """Approval rate before and after for every group of every attribute."""
    present = [a for a in attributes if a in df.columns]
    sums = {"n": F.lit(1), "baseline": F.col("baseline"), "modified": F.col("modified")}
    table = cells(policy_decisions(df, rules, model), present, sums)
    groups = cells_to_groups(table, present, list(sums))
    columns = _change(ratio(F.col("baseline"), F.col("n")), ratio(F.col("modified"), F.col("n")))
    return groups.select("attribute", "grp", *[c.alias(n) for n, c in columns.items()])


def threshold_sweep(
    df: DataFrame,
    cutoffs: Sequence[float],
    attributes: Sequence[str],
    probability: str = "predicted_probability",
) -> DataFrame:
    """Approval rate of each group, and the attribute's lowest-to-highest ratio, under each cutoff.

    The cutoffs are conditional sums of one aggregate, so rows are not repeated per cutoff.
    """
    score = F.col(probability)
    sums = {"n": F.lit(1)}
    sums |= {f"over_{i}": F.when(score > float(c), 1).otherwise(0) for i, c in enumerate(cutoffs)}
    groups = cells_to_groups(cells(df, attributes, sums), attributes, list(sums))
    options = F.array(
        *[
            F.struct(
                F.lit(float(c)).alias("cutoff"),
                ratio(F.col(f"over_{i}"), F.col("n")).alias("approval_rate"),
            )
            for i, c in enumerate(cutoffs)
        ]
    )
    rates = groups.select("attribute", "grp", "n", F.inline(options))
    same = Window.partitionBy("attribute", "cutoff")
    worst = F.try_divide(F.min("approval_rate").over(same), F.max("approval_rate").over(same))
    return rates.withColumn("impact_ratio", F.coalesce(worst, F.lit(0.0)))


def significant_changes(
    original: DataFrame,
    variant: DataFrame,
    key: str,
    features: Sequence[str],
    minimum: float = SIGNIFICANT_CHANGE,
) -> DataFrame:
    """Features whose value differs by more than ``minimum`` between two versions of a row."""
    before = original.select(key, *[F.col(f).cast("double").alias(f"before__{f}") for f in features])
    joined = before.join(variant, key)
    return _changes(joined, key, features, lambda f: F.col(f"before__{f}"), F.col, minimum)


def policy_changes(
    df: DataFrame,
    rules: Mapping[str, Mapping],
    key: str,
    minimum: float = SIGNIFICANT_CHANGE,
) -> DataFrame:
    """Numeric features a policy changes by more than ``minimum``, without joining the table to itself."""
    features = [f for f, r in rules.items() if f in df.columns and r["type"] == "threshold"]
    return _changes(df, key, features, F.col, lambda f: policy_value(F.col(f), rules[f]), minimum)


def _changes(df, key, features, before, after, minimum) -> DataFrame:
    pairs = []
    for f in features:
        x, y = before(f).cast("double"), after(f).cast("double")
        pairs.append(F.struct(F.lit(f).alias("feature"), x.alias("before"), y.alias("after")))
    delta = F.col("after") - F.col("before")
    return df.select(key, F.inline(F.array(*pairs))).withColumn("delta", delta).where(F.abs("delta") > minimum)
