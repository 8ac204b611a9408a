"""Mixing sources to target weights by Pareto order sampling.

A source's ratio is its target over its size. The ratio's whole part is given to every document for certain. What is missing
then is drawn with unequal probabilities: a document's inclusion probability grows with a power of its size (by default the fourth
root), scaled so that the source's expected words are those missing, and no higher than 1. Documents are
ranked by random odds divided by inclusion odds, and the ranking's shortest prefix that comes nearest to the words
still missing is taken. So every source hits its target up to half a document, whatever the draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.joins import join_small
from evenhand.llm.common import WORD, stored

MOST = 3.0
BINS = 4096
SEED = "mixing"
#: Power of its size that a document's inclusion probability grows with.
POWER = 0.25
#: Inclusion probabilities take steps of an eighth of an octave, so that their scale follows from few sums per source.
STEPS = 8


def words(text_col: str = "text") -> Column:
    """Number of words; 0 for a missing text."""
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source_col: str) -> Column:
    """Never null: joins on it keep documents without a source together as a source of their own."""
    source = F.col(source_col).cast("string")
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = MOST, total: float | None = None) -> DataFrame:
    """``sizes`` (one row per source: _source, source_size) with target.

    Weights repeat over the sources in code-point order, the missing source last. Sources share ``total``
    (by default all words) by weight; a target stops at ``most`` times its source's size and the
    excess is shared again by weight. Only sums reach the driver. ``sizes`` must be stored.
    """
    order = Window.orderBy(F.col("_source") == "", "_source")  # one row per source, not per document
    choice = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn("_weight", choice[(F.row_number().over(order) - 1) % len(weights)])
    weighted = weighted.withColumn("_cap", F.col("source_size") * F.lit(float(most))).persist()
    wanted = float(weighted.agg(F.sum("source_size")).first()[0] or 0) if total is None else float(total)
    share, capped = 0.0, -1
    while True:
        above = F.lit(share) * F.col("_weight") > F.col("_cap")
        row = weighted.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~above, F.col("_weight")))
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped, share = row[0], (wanted - row[1]) / row[2]
    return weighted.withColumn("target", F.least("_cap", F.lit(share) * F.col("_weight"))).drop("_weight", "_cap")


def _fractions(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """``planned`` with _whole, the certain copies, and per class of documents (_class, step of the preference) their probability _p.

    The highest classes are certain where their scaled preference passes 1; the scale is that of the first class that stays below.
    One row per source and class reaches the windows.
    """
    by_class = sized.groupBy("_source", "_class").agg(F.sum("_size").alias("_words"))
    by_class = join_small(by_class, planned, ["_source"]).withColumn("_liked", F.pow(F.lit(2.0), F.col("_class") / STEPS))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    by_class = by_class.withColumn("_whole", F.floor(ratio)).withColumn("_part", ratio - F.floor(ratio))
    source = Window.partitionBy("_source")
    higher = source.orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    here_on = source.orderBy(F.desc("_class")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    missing = F.col("_part") * F.col("source_size") - F.coalesce(F.sum("_words").over(higher), F.lit(0))
    scaled = by_class.withColumn("_scale", missing / F.nullif(F.sum(F.col("_liked") * F.col("_words")).over(here_on), F.lit(0.0)))
    fits = F.col("_scale") * F.col("_liked") <= 1.0
    scale = F.max_by(F.when(fits, F.col("_scale")), F.when(fits, F.col("_class"))).over(source)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(scale, F.lit(0.0)) * F.col("_liked")))
    # Documents above the scale's class are certain; without any words nothing is drawn.
    return scaled.withColumn("_p", F.when(F.col("_part") > 0, p).otherwise(0.0)).drop("_words", "_liked", "_scale")


def _cut(groups: DataFrame, left: DataFrame, by: list[str], key: str) -> DataFrame:
    """Per source, the first ``key`` at which the words of ``groups`` (_source, ``by``, ``key``, _words) pass those left (_source, ``by``, _left).

    Gives _source, ``by``, ``key`` and the words then left.
    """
    before = Window.partitionBy("_source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    upto = join_small(groups, left, ["_source", *by]).withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    last = upto.filter(F.col("_before") < F.col("_left")).groupBy("_source")
    found = last.agg(F.max_by(F.struct(*by, key, (F.col("_left") - F.col("_before")).alias("_left")), key).alias("_c"))
    return stored(found.select("_source", "_c.*"), "mix-cuts")


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = (1, 2, 3),
    most: float = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    preference: Column | None = None,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies times size).

    ``size`` defaults to the number of words. ``preference`` (positive; by default a power of the size) is what inclusion
    probabilities are proportional to within a source, in steps of an eighth of an octave. Columns named like the results are replaced.
    Draws hash the id and the text (the size where there is no text), so reruns agree; rows alike in both tie, and as many of
    them are taken as the target needs. Null ids and repeated rows are documents like others. Empty documents cost nothing
    and may get any number of copies. An empty table gives no rows.

    No source is collected or sorted whole: counts per (source, bin of the ranking) find the bin where
    the target falls, and only that bin's ranks, about one in ``BINS``, are ordered; within one rank, input partitions
    are counted before the rows of one of them are.
    """
    names = ["size", "source_size", "target", "copies", "taken"]
    counted = docs.withColumn("_size", words(text_col) if size is None else size.cast("long"))
    told = text_col if text_col in docs.columns else "_size"
    counted = counted.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(id_col), F.col(told).cast("string")))
    liked = F.pow(F.greatest("_size", F.lit(1)).cast("double"), F.lit(POWER)) if preference is None else preference.cast("double")
    step = F.when(liked > 0, F.round(F.log2(liked) * STEPS)).otherwise(0.0)
    sized = counted.withColumn("_class", F.coalesce(step, F.lit(0.0)).cast("int")).drop(*names).withColumn("_source", _source_key(source_col))
    # A stored number tells rows apart that are alike in everything.
    sized = stored(sized.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    sizes = stored(sized.groupBy("_source").agg(F.sum("_size").alias("source_size")), "mix-sources")
    planned = targets(sizes, weights, most)
    shares = stored(_fractions(sized, planned), "mix-shares")

    draw = F.shiftrightunsigned("_draw", 11).cast("double") * F.lit(2.0**-53) + F.lit(2.0**-54)

    def odds(p: Column) -> Column:
        return p / (F.lit(1.0) - p)

    def ranked(df: DataFrame) -> DataFrame:
        df = join_small(df, shares, ["_source", "_class"])
        # Odds are taken relative to the source's own, which keeps the order and spreads ranks over (0, 1).
        q = odds(draw) * odds(F.col("_part")) / odds(F.col("_p"))
        drawn = (F.col("_p") > 0) & (F.col("_p") < 1)
        df = df.withColumn("_rank", F.when(drawn, q / (F.lit(1.0) + q)))
        df = df.withColumn("_sure", F.col("_whole") + F.when(F.col("_p") >= 1, 1).otherwise(0))
        return df.withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(F.col("_rank") * BINS)))

    part = F.shiftright("_row", 33)
    narrow = ranked(sized.select("_source", "_class", "_size", "_draw", "_row"))
    sure = narrow.groupBy("_source").agg(F.sum(F.col("_sure") * F.col("_size")).alias("_sure_words"))
    left = join_small(sure, planned, ["_source"]).select("_source", (F.col("target") - F.col("_sure_words")).alias("_left"))
    drawn = narrow.filter(F.col("_bin").isNotNull()).withColumn("_part_of", part)
    total = F.sum("_size").alias("_words")
    left = stored(left, "mix-left")
    bins = _cut(drawn.groupBy("_source", "_bin").agg(total), left, [], "_bin")
    ranks = _cut(join_small(drawn, bins.select("_source", "_bin"), ["_source", "_bin"]).groupBy("_source", "_bin", "_rank").agg(total), bins, ["_bin"], "_rank")
    parts = _cut(
        join_small(drawn, ranks.select("_source", "_rank"), ["_source", "_rank"]).groupBy("_source", "_bin", "_rank", "_part_of").agg(total),
        ranks, ["_bin", "_rank"], "_part_of",
    )
    inside = join_small(drawn, parts, ["_source", "_bin", "_rank", "_part_of"])
    order = Window.partitionBy("_source").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.coalesce(F.sum("_size").over(order), F.lit(0)) + F.col("_size") / 2 <= F.col("_left")
    last = inside.withColumn("_taken", nearest).groupBy("_source").agg(
        F.first("_bin").alias("_cut_bin"), F.first("_rank").alias("_cut_rank"), F.first("_part_of").alias("_cut_part"),
        F.max(F.when(F.col("_taken"), F.col("_row"))).alias("_cut_row"),
    )
    boundary = stored(last, "mix-boundaries")
    out = join_small(ranked(sized), boundary, ["_source"], "left")
    here = F.struct(F.col("_rank").alias("rank"), part.alias("part"), F.col("_row").alias("row"))
    cut = F.struct(F.col("_cut_rank").alias("rank"), F.col("_cut_part").alias("part"), F.coalesce("_cut_row", F.lit(-1)).cast("long").alias("row"))
    taken = (F.col("_bin") < F.col("_cut_bin")) | ((F.col("_bin") == F.col("_cut_bin")) & (here <= cut))
    copies = F.col("_sure") + F.coalesce(taken, F.lit(False)).cast("int")
    kept = [c for c in docs.columns if c not in names]
    return out.select(
        *kept, F.col("_size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("_size")).cast("long").alias("taken")
    )
