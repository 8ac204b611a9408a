"""The rate cube: conditional counts per protected attribute and group, from one scan.

All fairness numbers derive from these counts. The row-level table is aggregated once to *cells*,
one row per distinct combination of segment and attribute values, with map-side partial sums.
Everything after that works on cells, whose number depends on the attributes' value sets and not
on the number of applications, and so neither multiplies rows per attribute nor shuffles them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.lending import all_present, intersection_key
from evenhand.functions.stats import ratio

COUNTERS = (
    "n",
    "approvals",
    "n_qual",
    "appr_qual",
    "n_unqual",
    "appr_unqual",
    "n_pred",
    "appr_pred",
)
QUALIFIED_ABOVE = 650
PREDICTED_ABOVE = 0.5


def cells(
    df: DataFrame, attributes: Sequence[str], sums: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Sums per distinct combination of segment and attribute values."""
    overlap = set(by) & set(attributes)
    if overlap:
        raise ValueError(f"segment columns cannot be audited attributes: {sorted(overlap)}")
    keys = [F.col(b) for b in by] + [F.col(a).cast("string").alias(a) for a in attributes]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def cells_to_groups(
    cell_table: DataFrame, attributes: Sequence[str], sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Cells summed to one row per segment, attribute and group; NULL groups are dropped."""
    long = cell_table.unpivot([*by, *sums], list(attributes), "attribute", "grp")
    return (
        long.where(F.col("grp").isNotNull())
        .groupBy(*by, "attribute", "grp")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )


def decision_counters(
    df: DataFrame,
    outcome: str = "approved",
    score: str = "credit_score",
    qualified_above: float = QUALIFIED_ABOVE,
    probability: str = "predicted_probability",
    predicted_above: float = PREDICTED_ABOVE,
) -> dict[str, Column]:
    """Expressions whose sums are the cube's counters.

    "Qualified" is a score above the limit, "unqualified" one at or below it; a NULL score is in
    neither. Without a probability column the two prediction counters stay NULL.
    """
    y = F.col(outcome).cast("int")
    one = F.lit(1)
    qualified = F.col(score) > qualified_above
    unqualified = F.col(score) <= qualified_above
    counters = {
        "n": one,
        "approvals": y,
        "n_qual": F.when(qualified, one).otherwise(0),
        "appr_qual": F.when(qualified, y).otherwise(0),
        "n_unqual": F.when(unqualified, one).otherwise(0),
        "appr_unqual": F.when(unqualified, y).otherwise(0),
        "n_pred": F.lit(None).cast("int"),
        "appr_pred": F.lit(None).cast("int"),
    }
    if probability in df.columns:
        predicted = F.col(probability) > predicted_above
        counters["n_pred"] = F.when(predicted, one).otherwise(0)
        counters["appr_pred"] = F.when(predicted, y).otherwise(0)
    return counters


def decision_cells(
    df: DataFrame,
    attributes: Sequence[str],
    outcome: str = "approved",
    by: Sequence[str] = (),
    **counter_options,
) -> DataFrame:
    """Cube counters per distinct combination of attribute values; NULL outcomes are left out."""
    counters = decision_counters(df, outcome, **counter_options)
    return cells(df.where(F.col(outcome).isNotNull()), attributes, counters, by)


def rate_cube(
    df: DataFrame,
    attributes: Sequence[str],
    outcome: str = "approved",
    by: Sequence[str] = (),
    **counter_options,
) -> DataFrame:
    """Cube counters per segment, attribute and group."""
    cell_table = decision_cells(df, attributes, outcome, by, **counter_options)
    return cells_to_groups(cell_table, attributes, COUNTERS, by)


def model_cube(
    df: DataFrame,
    attributes: Sequence[str],
    outcomes: Mapping[str, str],
    by: Sequence[str] = (),
    **counter_options,
) -> DataFrame:
    """Cube of several models' decisions (``{model: outcome column}``) with a leading model column.

    All models are counted in the same scan; a row without one model's outcome still counts for
    the others.
    """
    sums = {}
    for i, outcome in enumerate(outcomes.values()):
        known = F.col(outcome).isNotNull()
        for name, counter in decision_counters(df, outcome, **counter_options).items():
            sums[f"{name}__{i}"] = F.when(known, counter)
    table = cells(df, attributes, sums, by)
    rows = [
        F.struct(F.lit(model).alias("model"), *[F.col(f"{c}__{i}").alias(c) for c in COUNTERS])
        for i, model in enumerate(outcomes)
    ]
    per_model = table.select(*by, *attributes, F.inline(F.array(*rows))).where(F.col("n") > 0)
    return cells_to_groups(per_model, attributes, COUNTERS, ["model", *by])


def intersection_cube(
    df: DataFrame,
    attributes: Sequence[str],
    outcome: str = "approved",
    by: Sequence[str] = (),
    **counter_options,
) -> DataFrame:
    """Cube over the joint groups of several attributes; rows with a NULL part are left out."""
    cell_table = decision_cells(df, attributes, outcome, by, **counter_options)
    return (
        cell_table.where(all_present(attributes))
        .withColumn("grp", intersection_key(*attributes))
        .groupBy(*by, F.lit("intersectional_group").alias("attribute"), "grp")
        .agg(*[F.sum(c).alias(c) for c in COUNTERS])
    )


def grouped_cube(
    df: DataFrame, attributes: Sequence[str], outcome: str = "approved", by: Sequence[str] = ()
) -> DataFrame:
    """Approval rates overall, per attribute and per pair of attributes in one pass.

    ``level`` names the grouped attributes joined by ``*`` ("overall" for none); the other
    attribute columns are NULL.
    """
    y = F.col(outcome).cast("int")
    known = df.where(F.col(outcome).isNotNull())
    cell_table = cells(known, attributes, {"n": F.lit(1), "approvals": y}, by)
    single = [(a,) for a in attributes]
    sets = [(), *single, *combinations(attributes, 2)]
    grouped = cell_table.groupingSets(
        [[F.col(c) for c in (*by, *s)] for s in sets], *by, *attributes
    ).agg(
        F.sum("n").alias("n"),
        F.sum("approvals").alias("approvals"),
        *[F.grouping(a).alias(f"rolled_{a}") for a in attributes],
    )
    present = F.lit(True)
    for a in attributes:
        present = present & ((F.col(f"rolled_{a}") == 1) | F.col(a).isNotNull())
    names = F.concat_ws("*", *[F.when(F.col(f"rolled_{a}") == 0, F.lit(a)) for a in attributes])
    return (
        grouped.where(present & F.col("n").isNotNull())
        .withColumn("level", F.when(names == "", "overall").otherwise(names))
        .select(*by, "level", *attributes, "n", "approvals")
        .withColumn("rate", ratio(F.col("approvals"), F.col("n")))
    )
