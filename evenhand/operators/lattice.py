"""Search of the subgroup lattice: every combination of attribute values with enough applications, tested and corrected.

Levels are walked from single values to full combinations. Only subgroups with enough support are extended, and only by values
that occur together with them, so combinations that are too small are never built. The search works on cells, one row per
combination of all attributes. Each supported subgroup is tested against everyone else, and the false discovery rate over
all tests is controlled (Benjamini and Hochberg).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.stats import chi_square_p_value, ratio, yates_chi_square
from evenhand.operators.cube import cells
from evenhand.session import work_dir

RANGES = 64


def _stored(df: DataFrame, purpose: str) -> DataFrame:
    path = work_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def supported(df: DataFrame, attributes: Sequence[str], support: int, depth: int | None = None, outcome: str = "approved") -> DataFrame:
    """Subgroups (group: array of ``attribute=value`` in the order given, size, n, approvals) of at least ``support`` rows with a known outcome.

    A NULL value belongs to no subgroup. A level is stored before the next begins, which has one row per cell and supported subgroup in it.
    """
    known = df.where(F.col(outcome).isNotNull())
    table = cells(known, attributes, {"n": F.lit(1), "approvals": F.col(outcome).cast("int")})
    items = F.array(*[F.when(F.col(a).isNotNull(), F.concat(F.lit(f"{a}="), F.col(a))) for a in attributes])
    table = _stored(table.select(items.alias("items"), "n", "approvals"), "lattice-cells")
    rows = table.select("items", "n", "approvals", F.array().cast("array<string>").alias("group"), F.lit(0).alias("next"))
    result = None
    for level in range(1, (depth or len(attributes)) + 1):
        later = F.filter(
            F.transform("items", lambda item, i: F.struct(item.alias("item"), i.alias("at"))),
            lambda e: (e["at"] >= F.col("next")) & e["item"].isNotNull(),
        )
        rows = rows.withColumn("e", F.explode(later)).select(
            "items", "n", "approvals", F.array_append("group", F.col("e.item")).alias("group"), (F.col("e.at") + 1).alias("next")
        )
        found = rows.groupBy("group").agg(F.sum("n").alias("n"), F.sum("approvals").alias("approvals")).where(F.col("n") >= support)
        found = _stored(found, "lattice-level")
        if found.isEmpty():
            break
        result = found if result is None else result.unionByName(found)
        if level < len(attributes):
            rows = _stored(rows.join(found.select("group"), "group", "left_semi"), "lattice-rows")
    if result is None:
        result = found
    return result.select("group", F.size("group").alias("size"), "n", "approvals")


def with_q_values(tests: DataFrame, p: str = "p_value", ranges: int = RANGES) -> DataFrame:
    """``tests`` with q_value, the least false discovery rate at which each test counts.

    The tests are dealt in ranges of p: ranks and least quotients are found within a range, and what other ranges add comes from one row each.
    """
    dealt = _stored(tests.repartitionByRange(ranges, p).withColumn("_range", F.spark_partition_id()), "lattice-tests")
    per_range = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_held"))
    order = Window.orderBy("_range")  # one row per range
    offsets = per_range.select(
        "_range",
        F.coalesce(F.sum("_held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"),
        F.sum("_held").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    upto = Window.partitionBy("_range").orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("_inside", F.count(F.lit(1)).over(upto)).join(F.broadcast(offsets), "_range")
    ranked = ranked.withColumn("_quotient", F.col(p) * F.col("_all") / (F.col("_below") + F.col("_inside")))
    ranked = _stored(ranked, "lattice-ranks")
    least = ranked.groupBy("_range").agg(F.min("_quotient").alias("_least"))
    later = least.select("_range", F.min("_least").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    from_here = Window.partitionBy("_range").orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.min("_quotient").over(from_here)
    return (
        ranked.join(F.broadcast(later), "_range")
        .withColumn("q_value", F.least(inside, F.col("_later"), F.lit(1.0)))
        .drop("_range", "_inside", "_below", "_all", "_quotient", "_later")
    )


def subgroup_tests(
    df: DataFrame, attributes: Sequence[str], support: int = 100, alpha: float = 0.05, depth: int | None = None, outcome: str = "approved"
) -> DataFrame:
    """Every supported subgroup: subgroup, size, n, rate, gap to everyone's rate, p_value against everyone else, q_value, flagged.

    The test is the continuity-corrected chi-square; a subgroup that holds everyone, or where all decisions are alike, has p 1.
    """
    groups = supported(df, attributes, support, depth, outcome)
    known = df.where(F.col(outcome).isNotNull())
    tested = groups.withColumns(
        {"all_n": known.agg(F.count(F.lit(1))).scalar(), "all_approvals": known.agg(F.sum(F.col(outcome).cast("int"))).scalar()}
    )
    inside, outside = F.col("n") - F.col("approvals"), F.col("all_n") - F.col("n")
    chi = yates_chi_square(F.col("approvals"), inside, F.col("all_approvals") - F.col("approvals"), outside - (F.col("all_approvals") - F.col("approvals")))
    rate = ratio(F.col("approvals"), F.col("n"))
    tested = tested.select(
        F.array_join("group", " & ").alias("subgroup"),
        "size",
        "n",
        rate.alias("rate"),
        (rate - ratio(F.col("all_approvals"), F.col("all_n"))).alias("gap"),
        chi_square_p_value(chi).alias("p_value"),
    )
    return with_q_values(tested).withColumn("flagged", F.col("q_value") <= alpha)
