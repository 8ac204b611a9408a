"""Feature attributions of linear scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.lending import feature_category
from evenhand.operators.models import LinearScore
from evenhand.sources.tables import sample_rows

# Instances explained, features kept per instance, protected name prefixes.
EXPLAINED = 100
KEPT_FEATURES = 5
PROTECTED_PREFIXES = ("race", "gender", "age")


def _means(df: DataFrame, features: Sequence[str]) -> Column:
    """Column means as one struct, a scalar subquery."""
    return df.agg(F.struct(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f) for f in features])).scalar()


def _contributions(df: DataFrame, model: LinearScore) -> tuple[DataFrame, dict[str, Column]]:
    features = list(model.weights)
    with_means = df.withColumn("means__", _means(df, features))
    return with_means, {
        f: F.lit(float(w)) * (F.col(f"`{f}`").cast("double") - F.col("means__").getField(f))
        for f, w in model.weights.items()
    }


def linear_attribution(df: DataFrame, model: LinearScore, key: str = "application_id") -> DataFrame:
    """Exact contributions weight * (value - mean), one row per application and feature."""
    table, contributions = _contributions(df, model)
    rows = [
        F.struct(F.lit(f).alias("feature"), c.alias("contribution")) for f, c in contributions.items()
    ]
    return table.select(key, F.inline(F.array(*rows)))


def global_importance(df: DataFrame, model: LinearScore, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature with its rank.

    Computed as one wide aggregate, without listing contributions per application.
    """
    table, contributions = _contributions(df, model)
    names = list(contributions)
    wide = table.groupBy(*by).agg(*[F.avg(F.abs(contributions[f])).alias(f"a__{i}") for i, f in enumerate(names)])
    entries = [
        F.struct((-F.col(f"a__{i}")).alias("key"), F.lit(f).alias("feature"), F.col(f"a__{i}").alias("importance"))
        for i, f in enumerate(names)
    ]
    ranked = wide.select(*by, F.posexplode(F.array_sort(F.array(*entries))).alias("pos", "e"))
    return ranked.select(*by, (F.col("pos") + 1).alias("position"), "e.feature", "e.importance")


def importance_of(attributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature of a stored attribution table."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def protected_contribution(
    importance: DataFrame, prefixes: Sequence[str] = PROTECTED_PREFIXES
) -> DataFrame:
    """Total importance, and share of all importance, of features named after protected attributes.

    One aggregate over the importance table, with a sum per prefix.
    """
    sums = [
        F.sum(F.when(F.startswith(F.col("feature"), F.lit(p)), F.col("importance"))).alias(f"of__{i}")
        for i, p in enumerate(prefixes)
    ]
    totals = importance.agg(F.sum("importance").alias("total"), *sums)
    rows = [
        F.struct(
            F.lit(p).alias("attribute"),
            F.col(f"of__{i}").alias("importance"),
            F.coalesce(F.try_divide(F.col(f"of__{i}"), F.col("total")), F.lit(0.0)).alias("share"),
        )
        for i, p in enumerate(prefixes)
    ]
    return totals.select(F.inline(F.array(*rows))).where(F.col("importance").isNotNull())


def importance_by_category(importance: DataFrame) -> DataFrame:
    """Importance summed over the category of the feature's name."""
    return (
        importance.withColumn("category", feature_category(F.col("feature")))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("importance"))
    )


def local_attribution(
    df: DataFrame,
    model: LinearScore,
    key: str = "application_id",
    instances: int = EXPLAINED,
    kept: int = KEPT_FEATURES,
) -> DataFrame:
    """Change of the score when one feature is set to its mean, strongest features first.

    ``instances`` applications are explained, the same ones on every run; the means are those of
    the whole table.
    """
    features = list(model.weights)
    narrow = df.select(key, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    means = _means(df, features)
    table = sample_rows(narrow, instances, key).withColumn("means__", means)
    score = model.probability()
    effects = []
    for f in features:
        effect = score - model.probability({f: F.col("means__").getField(f)})
        effects.append(
            F.struct((-F.abs(effect)).alias("key"), F.lit(f).alias("feature"), effect.alias("contribution"))
        )
    strongest = F.slice(F.array_sort(F.array(*effects)), 1, kept)
    listed = table.select(key, F.posexplode(strongest).alias("pos", "e"))
    return listed.select(key, (F.col("pos") + 1).alias("position"), "e.feature", "e.contribution")


def attribution_stability(runs: DataFrame, run: str = "run") -> DataFrame:
    """Spread of each feature's contribution over repeated runs, and the overall stability.

    ``runs`` holds (run, feature, contribution); a feature absent from a run counts as 0 there. The
    zeros are added to the moments of the values present instead of being listed. ``runs`` is
    cached: it is counted before it is summarised.
    """
    runs = runs.persist()
    n_runs = runs.agg(F.count_distinct(run)).scalar()
    c = F.col("contribution")
    present = runs.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(c).alias("m"),
        F.var_pop(c).alias("v"),
        F.min(c).alias("lo"),
        F.max(c).alias("hi"),
        F.count_if(c != 0).alias("appearances"),
    )
    total = F.col("runs").cast("double")
    absent = total - F.col("n")
    missing = F.col("n") < F.col("runs")
    mean = F.col("m") * F.col("n") / total
    variance = (F.col("v") * F.col("n") + F.col("m") * F.col("m") * F.col("n") * absent / total) / total
    features = present.withColumn("runs", n_runs).select(
        "feature",
        mean.alias("mean"),
        F.sqrt(variance).alias("std"),
        F.when(missing, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min"),
        F.when(missing, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max"),
        "appearances",
        variance.alias("variance"),
    )
    every = Window.partitionBy(F.lit(0))
    spread = F.avg(F.when(F.col("appearances") > 0, F.col("variance"))).over(every)
    size = F.avg(F.abs("mean")).over(every)
    stability = (
        F.when(spread.isNull(), 0.0)
        .when(size == 0, 1.0)
        .otherwise(F.lit(1.0) / (F.lit(1.0) + F.try_divide(spread, size)))
    )
    return features.withColumn("stability_score", stability).drop("variance")
