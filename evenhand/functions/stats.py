"""Statistical expressions built from Spark's own column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation of erfc (constant term first).
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def erfc_non_negative(z: Column) -> Column:
    """Complementary error function for z >= 0, relative error below 1.2e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-z * z + poly)


def yates_chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Continuity-corrected chi-square of the table ((a, b), (c, d)); 0 if a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    total = a + b + c + d
    excess = F.greatest(F.abs(a * d - b * c) - total / 2.0, F.lit(0.0))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.coalesce(F.try_divide(total * excess * excess, margins), F.lit(0.0))


def chi_square_p_value(chi_square: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    tail = erfc_non_negative(F.sqrt(chi_square / 2.0))
    return F.when(chi_square <= 0, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))


def cosine_weight(values: list[Column]) -> Column:
    """Euclidean norm of a vector held in separate columns."""
    squares = F.lit(0.0)
    for v in values:
        squares = squares + v * v
    return F.sqrt(squares)


# A prime modulus and a multiplier near its golden section, so that even consecutive
# keys spread evenly; their product stays within 64 bits.
HASH_MODULUS = 2_147_483_647
HASH_MULTIPLIER = 1_327_217_885


def key_hash(key: Column, salt: int = 0) -> Column:
    """Repeatable pseudo-random integer in [0, HASH_MODULUS) for an integer key."""
    folded = F.pmod(key.cast("bigint"), F.lit(HASH_MODULUS).cast("bigint"))
    return (folded * F.lit(HASH_MULTIPLIER) + F.lit(104729 + salt)) % F.lit(HASH_MODULUS).cast("bigint")
