"""Row-level lending rules as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper age (inclusive) and label of each age band.
AGE_BANDS = ((24, "18-24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"))
OLDEST_BAND = "65+"

# Name fragments of each feature category, first match wins.
FEATURE_CATEGORIES = (
    ("demographic", ("race", "gender", "age")),
    ("financial", ("income", "credit", "debt", "employment")),
    ("geographic", ("region", "zip", "urban")),
    ("loan_specific", ("loan", "amount", "term", "interest")),
)

# Multiplier of the approval probability under each bias switch.
BIAS_FACTORS = {"gender": 0.85, "race": 0.75, "age": 0.8, "geographic": 0.85, "intersectional": 0.9}


@dataclass(frozen=True)
class BiasRoles:
    """Which column values play the disadvantaged roles."""

    female: tuple[str, ...] = ("Female",)
    minority: tuple[str, ...] = ("Black", "Hispanic")
    redlined: tuple[str, ...] = ("Southeast", "Southwest")


def age_band(age: Column) -> Column:
    band = F.when(age.isNull(), F.lit(None).cast("string"))
    for upper, label in AGE_BANDS:
        band = band.when(age <= upper, F.lit(label))
    return band.otherwise(F.lit(OLDEST_BAND))


def approval_score(credit_score: Column, debt_to_income: Column) -> Column:
    scaled = (credit_score - F.lit(300)).cast("double") / F.lit(550.0)
    return scaled * F.lit(0.7) + (F.lit(1.0) - debt_to_income) * F.lit(0.3)


def biased_probability(
    base: Column,
    flags: Iterable[str] = tuple(BIAS_FACTORS),
    roles: BiasRoles = BiasRoles(),
    gender: str = "gender",
    race: str = "race",
    age: str = "age",
    region: str = "region",
) -> Column:
    """Approval probability after the switched-on bias modifiers, clipped to [0, 1]."""
    is_female = F.col(gender).isin(*roles.female)
    is_minority = F.col(race).isin(*roles.minority)
    affected = {
        "gender": is_female,
        "race": is_minority,
        "age": (F.col(age) < 25) | (F.col(age) > 65),
        "geographic": F.col(region).isin(*roles.redlined),
        "intersectional": is_female & is_minority,
    }
    wanted = set(flags)
    unknown = wanted - set(affected)
    if unknown:
        raise ValueError(f"unknown bias flags: {sorted(unknown)}")
    probability = base
    for name, condition in affected.items():
        if name in wanted:
            factor = F.when(condition, F.lit(BIAS_FACTORS[name])).otherwise(F.lit(1.0))
            probability = probability * factor
    return F.least(F.greatest(probability, F.lit(0.0)), F.lit(1.0))


def intersection_key(*attributes: str) -> Column:
    """Attribute values joined by ``_``; NULL if any part is NULL."""
    parts = [F.col(a).cast("string") for a in attributes]
    return F.when(all_present(attributes), F.concat_ws("_", *parts))


def all_present(columns: Iterable[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def feature_category(name: Column) -> Column:
    lowered = F.lower(name)
    category = F.when(name.isNull(), F.lit(None).cast("string"))
    for label, fragments in FEATURE_CATEGORIES:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.contains(lowered, F.lit(fragment))
        category = category.when(hit, F.lit(label))
    return category.otherwise(F.lit("other"))


def policy_value(column: Column, rule: Mapping) -> Column:
    """One feature after a policy rule; NULL stays NULL.

    ``{"type": "threshold", "value": v, "direction": "increase" | "decrease"}`` floors or caps the
    feature, ``{"type": "categorical", "mapping": {...}}`` renames values and keeps the rest.
    """
    if rule["type"] == "threshold":
        bound = F.lit(rule["value"])
        limit = F.greatest if rule.get("direction") == "increase" else F.least
        return F.when(column.isNotNull(), limit(column, bound))
    if rule["type"] == "categorical":
        replaced = column
        if rule["mapping"]:
            pairs = [F.lit(part) for pair in rule["mapping"].items() for part in pair]
            replaced = F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)
        return F.when(column.isNotNull(), replaced)
    raise ValueError(f"unknown policy rule type: {rule['type']!r}")
