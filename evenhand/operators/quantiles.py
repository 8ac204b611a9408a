"""Exact medians of large columns without bringing a column into one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

BINS = 1_000
SETTLE_ROWS = 200_000


@dataclass
class _Band:
    """Interval of values known to hold the wanted ranks."""

    low: float
    high: float
    below: int
    inside: int
    ranks: tuple[int, int]

    def contains(self, x: Column) -> Column:
        return (x >= self.low) & (x <= self.high)

    def bin_of(self, x: Column) -> Column:
        """Equal-width bin of a value; monotone in x, so bins are ranges of ranks."""
        position = (x - self.low) / F.lit(self.high - self.low) * BINS
        return F.least(F.floor(position), F.lit(BINS - 1)).cast("int")


def _number(column: str) -> Column:
    """The column as double, NaN as NULL."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def exact_medians(
    df: DataFrame, columns: Sequence[str], settle_rows: int = SETTLE_ROWS, max_rounds: int = 20
) -> dict[str, float | None]:
    """Median of each column, interpolated between the two middle values.

    A first scan takes count, minimum and maximum. Each further scan counts the values of every
    unfinished column per bin of the band around its median; the bin with the middle becomes the
    next band. Only these counts reach the driver, at most ``BINS`` per column. A column is finished
    when the two middle values lie in different bins or the bin holds one value, however frequent;
    a band with few rows left is ranked exactly.
    """
    bands: dict[str, _Band] = {}
    medians: dict[str, float | None] = {}
    first = _extremes(df, columns)
    for i, c in enumerate(columns):
        count, low, high = first[f"n_{i}"], first[f"low_{i}"], first[f"high_{i}"]
        if count == 0 or low == high:
            medians[c] = low
        else:
            bands[c] = _Band(low, high, 0, count, ((count - 1) // 2, count // 2))
    for _ in range(max_rounds):
        wide = [c for c in bands if c not in medians and bands[c].inside > settle_rows]
        if not wide:
            break
        counted = _count_bins(df, wide, bands)
        for c in wide:
            medians |= _narrow(c, bands[c], [r for r in counted if r["feature"] == c])
    rest = [c for c in bands if c not in medians]
    if rest:
        medians |= _settle(df, rest, bands)
    return medians


def _extremes(df: DataFrame, columns: Sequence[str]) -> Row:
    wanted = []
    for i, c in enumerate(columns):
        x = _number(c)
        wanted += [F.count(x).alias(f"n_{i}"), F.min(x).alias(f"low_{i}"), F.max(x).alias(f"high_{i}")]
    return df.agg(*wanted).first()


def _in_bands(df: DataFrame, columns: Sequence[str], bands: dict[str, _Band], binned: bool) -> DataFrame:
    """Rows (feature, x[, bin]) of the values inside their column's band.

    The bands are tested after the expansion: as a filter on the table they would be pushed down
    and repeat every column's expression for each comparison.
    """
    numbers = df.select(*[_number(c).alias(f"x_{i}") for i, c in enumerate(columns)])
    entries = []
    for i, c in enumerate(columns):
        x = F.col(f"x_{i}")
        inside = bands[c].contains(x)
        fields = [F.lit(c).alias("feature"), F.when(inside, x).alias("x")]
        if binned:
            fields.append(F.when(inside, bands[c].bin_of(x)).alias("bin"))
        entries.append(F.struct(*fields))
    return numbers.select(F.inline(F.array(*entries))).where(F.col("x").isNotNull())


def _count_bins(df: DataFrame, columns: Sequence[str], bands: dict[str, _Band]) -> list[Row]:
    return (
        _in_bands(df, columns, bands, binned=True)
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .collect()
    )


def _narrow(column: str, band: _Band, counted: list[Row]) -> dict[str, float]:
    """Move the band to the bin of the middle; the median itself if that settles it."""
    at = band.below
    holding = {}
    for r in sorted(counted, key=lambda r: r["bin"]):
        for rank in band.ranks:
            if at <= rank < at + r["n"]:
                holding[rank] = (r, at)
        at += r["n"]
    (lower, below), (upper, _) = (holding[rank] for rank in band.ranks)
    if lower["bin"] != upper["bin"]:
        return {column: (lower["high"] + upper["low"]) / 2.0}
    if lower["low"] == lower["high"]:
        return {column: lower["low"]}
    band.low, band.high, band.below, band.inside = lower["low"], lower["high"], below, lower["n"]
    return {}


def _settle(df: DataFrame, columns: Sequence[str], bands: dict[str, _Band]) -> dict[str, float]:
    """Rank the values left in small bands; equal values are counted together first."""
    counts = _in_bands(df, columns, bands, binned=False).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("feature").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.lit(False)
    for c in columns:
        for rank in set(bands[c].ranks):
            at = rank - bands[c].below
            hit = hit | ((F.col("feature") == c) & (F.col("last") > at) & (F.col("last") - F.col("n") <= at))
    found: dict[str, list[float]] = {c: [] for c in columns}
    for row in counts.withColumn("last", F.sum("n").over(running)).where(hit).collect():
        found[row["feature"]].append(row["x"])
    return {c: (min(v) + max(v)) / 2.0 for c, v in found.items()}
