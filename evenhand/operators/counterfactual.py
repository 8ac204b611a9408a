"""Counterfactuals: the nearest changes to an application that turn its decision around.

Every application is tried against the same small grid of changes. A row's candidates never leave
its partition: the table is partitioned by application once, while rows are still narrow, and the
expansion, the diversity windows and the ranking that follow all reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.stats import cosine_weight
from evenhand.operators.models import LinearScore

# Share of a standard deviation per grid step, and the ranking weights.
STEP = 0.5
PROXIMITY_WEIGHT, DIVERSITY_WEIGHT, VALIDITY_WEIGHT = 0.5, 0.3, 0.2
KEPT = 5


def counterfactual_grid(
    df: DataFrame,
    model: LinearScore,
    steps: Mapping[str, Sequence[float]],
    key: str = "application_id",
    target: int = 1,
    training: DataFrame | None = None,
) -> DataFrame:
    """Changed versions of every application decided otherwise that reach the target decision.

    ``steps`` lists, per feature, the moves to try in units of half the feature's standard
    deviation over ``training`` (default: the table itself). Columns: key, candidate_id, the
    model's features after the change, confidence and proximity (distance to the original).
    """
    features = list(model.weights)
    moved = list(steps)
    unknown = set(moved) - set(features)
    if unknown:
        raise ValueError(f"features not in the model: {sorted(unknown)}")
    spreads = (df if training is None else training).agg(
        F.struct(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in moved])
    )
    spread = spreads.scalar()
    grid = [moves for moves in product(*(steps[f] for f in moved)) if any(moves)]
    options = F.array(
        *[
            F.struct(F.lit(i).alias("candidate_id"), *[F.lit(float(m)).alias(f"move__{f}") for f, m in zip(moved, g)])
            for i, g in enumerate(grid)
        ]
    )
    other = df.where(model.decision() == 1 - target)
    rows = other.select(key, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    # A fixed number of partitions: judged by the narrow rows, AQE would merge too many of them.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(partitions, key).withColumn("spread", spread)
    tried = placed.select(key, *features, "spread", F.inline(options))
    change = {f: F.col(f"move__{f}") * STEP * F.col("spread")[f] for f in moved}
    squares = F.lit(0.0)
    for f in moved:
        squares = squares + change[f] * change[f]
    candidates = tried.select(
        key,
        "candidate_id",
        *[(F.col(f) + change[f]).alias(f) if f in change else F.col(f) for f in features],
        F.sqrt(squares).alias("proximity"),
    )
    approval = model.probability()
    confidence = approval if target == 1 else F.lit(1.0) - approval
    reached = candidates.where(model.decision() == target)
    return reached.select(key, "candidate_id", *features, confidence.alias("confidence"), "proximity")


def diversity(candidates: DataFrame, features: Sequence[str], key: str = "application_id") -> DataFrame:
    """Adds 1 minus the mean cosine similarity to the key's other candidates, 1 if it has none.

    The mean over the others equals (u . sum(u) - 1) / (n - 1) for unit vectors u, so component
    sums replace comparing candidates with each other.
    """
    norm = cosine_weight([F.col(f) for f in features])
    units = candidates.withColumn("norm", norm).withColumns(
        {f"unit__{f}": F.coalesce(F.try_divide(F.col(f), F.col("norm")), F.lit(0.0)) for f in features}
    )
    same = Window.partitionBy(key)
    dot = F.lit(0.0)
    for f in features:
        dot = dot + F.col(f"unit__{f}") * F.sum(f"unit__{f}").over(same)
    n = F.count(F.lit(1)).over(same)
    own = F.when(F.col("norm") > 0, 1.0).otherwise(0.0)
    mean = F.try_divide(dot - own, (n - 1).cast("double"))
    added = units.withColumn("diversity", F.coalesce(F.lit(1.0) - mean, F.lit(1.0)))
    return added.drop("norm", *[f"unit__{f}" for f in features])


def counterfactual_rank(
    candidates: DataFrame, k: int = KEPT, key: str = "application_id"
) -> DataFrame:
    """The k best candidates per application by proximity, diversity and confidence."""
    score = (
        PROXIMITY_WEIGHT * (F.lit(1.0) / (F.lit(1.0) + F.col("proximity")))
        + DIVERSITY_WEIGHT * F.col("diversity")
        + VALIDITY_WEIGHT * F.col("confidence")
    )
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "candidate_id")
    return (
        candidates.withColumn("score", score)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
    )


def counterfactuals(
    df: DataFrame,
    model: LinearScore,
    steps: Mapping[str, Sequence[float]],
    k: int = KEPT,
    key: str = "application_id",
    target: int = 1,
) -> DataFrame:
    """The whole search: grid, diversity and ranking."""
    grid = counterfactual_grid(df, model, steps, key, target)
    return counterfactual_rank(diversity(grid, list(model.weights), key), k, key)
