"""Joins of a large table with a table that is usually, but not provably, small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def join_small(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join that broadcasts ``small`` only after counting it.

    ``small`` is an aggregate, so it is cached and counted up to ``max_rows + 1``. Within the
    bound it is broadcast and ``large`` is not shuffled at all; beyond it the plain join is used,
    which Spark runs as a sort-merge join and splits on skewed keys.
    """
    small = small.persist()
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return large.join(small, list(on), how)


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Equality of all keys where NULL equals NULL."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition
