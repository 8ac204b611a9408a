"""Profiles of numeric columns from mergeable sketches kept as rows.

A sketch counts a column's values in bins whose edges grow by a fixed factor, with each bin's least and greatest value, sum and spread.
Sketches of any segments are built in one scan and merge by adding up bins, so windows, regions and the whole come from the same
rows. Ranks are exact; a quantile is known to lie between the least and the greatest value of its bin, which differ by the factor
at most, and is exact where a bin holds one value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative width of a bin.
WIDTH = 0.02
#: Added to bin numbers so that those of positive values are positive; doubles reach from e^-745 to e^710.
OFFSET = 40_000


def bin_of(x: Column, width: float = WIDTH) -> Column:
    """Bin of a finite value: monotone in x, 0 for 0, mirrored for negative values."""
    size = F.ceil(F.ln(F.abs(x)) / F.lit(math.log(1.0 + width))) + F.lit(OFFSET)
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size).cast("int")


def sketch(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), width: float = WIDTH) -> DataFrame:
    """One row per segment, column and bin in use. NULL, NaN and infinite values are not counted; null segments are segments.

    Each task sends one row per segment, column and bin at most, however many rows share a segment.
    """
    values = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]
    long = df.select(*by, F.inline(F.array(*values))).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    return (
        long.withColumn("bin", bin_of(F.col("x"), width))
        .groupBy(*by, "feature", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("x").alias("total"),
            (F.var_pop("x") * F.count(F.lit(1))).alias("m2"),
            F.min("x").alias("low"),
            F.max("x").alias("high"),
        )
    )


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of coarser segments ``by``, from those of finer ones: bins add up, spreads by their distance to the joint mean."""
    bins = Window.partitionBy(*by, "feature", "bin")
    mean = F.sum("total").over(bins) / F.sum("n").over(bins)
    apart = sketches.withColumn("_apart", F.col("m2") + F.col("n") * F.pow(F.col("total") / F.col("n") - mean, 2))
    return apart.groupBy(*by, "feature", "bin").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("_apart").alias("m2"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def profile(sketches: DataFrame, by: Sequence[str] = (), shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Rows (by, feature, n, mean, std, share, low, high, estimate): moments, and for each share the bounds of the interpolated quantile.

    The windows run over bins, a few thousand rows per segment and column at most.
    """
    segment = Window.partitionBy(*by, "feature")
    running = segment.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = sketches.withColumns({"_last": F.sum("n").over(running), "_all": F.sum("n").over(segment), "_mean": F.sum("total").over(segment) / F.sum("n").over(segment)})
    around = F.col("m2") + F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("_mean"), 2)
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in shares]))
    spread = F.sum(around).over(segment)
    placed = counted.withColumn("_spread", spread).withColumn("share", wanted)
    position = (F.col("_all") - 1) * F.col("share")
    first = F.col("_last") - F.col("n")

    def holds(rank: Column) -> Column:
        return (first <= rank) & (rank < F.col("_last"))

    low, high, part = F.floor(position), F.ceil(position), position - F.floor(position)

    def between(c: str) -> Column:
        below, above = F.max(F.when(holds(low), F.col(c))), F.max(F.when(holds(high), F.col(c)))
        return below + F.max(part) * (above - below)

    bounds = placed.groupBy(*by, "feature", "share").agg(
        F.max("_all").alias("n"), F.max("_mean").alias("mean"), F.max("_spread").alias("_spread"), between("low").alias("low"), between("high").alias("high")
    )
    return bounds.select(
        *by, "feature", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("_spread") / (F.col("n") - 1))).alias("std"), "share", "low", "high",
        ((F.col("low") + F.col("high")) / 2).alias("estimate"),
    )
