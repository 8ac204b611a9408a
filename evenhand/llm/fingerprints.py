"""Document fingerprints from closed syncmers, in built-in expressions throughout.

A text is a sequence of units: stretches of up to three characters of its words, single characters of very long words. Of all
runs of ``k`` units, those are kept whose least inner run of ``s`` units, by hash, is the first or the last one. Whether a run is
kept depends on the run alone, so equal passages have equal anchors wherever they stand, and no stretch of more than
``k - s`` runs is without one. Texts of all lengths are treated alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import stored, text_or_empty

K = 6
S = 2
#: Three characters from a word's start on; characters with 16 or more of their word before or after them are units of their own, so that
#: an insertion into text without white space moves no later unit.
UNIT = r"[^\x20\x09-\x0D](?=[^\x20\x09-\x0D]{16})|(?<=[^\x20\x09-\x0D]{16})[^\x20\x09-\x0D]|[^\x20\x09-\x0D]{1,3}"
#: Ranges of ids per shuffle partition; several even out what hashing ranges to partitions leaves uneven.
RANGES = 4


def with_anchors(df: DataFrame, text: Column, positions: str, hashes: str, k: int = K, s: int = S, unit: str = UNIT) -> DataFrame:
    """``df`` with the anchors' positions (in units, from 1) and hashes (non-negative 31 bit), both in text order.

    A text counts as if ``k - 1`` equal units stood before it: runs that begin there have positions up to 0, and its first units are in
    as many runs as others. One without units, or missing, has no anchors. A text so short that none of its runs qualifies keeps them all.
    """
    before = k - 1
    given = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(unit), F.lit(0)), lambda u: F.xxhash64(u))
    df = df.withColumn("_units", F.when(F.size(given) > 0, F.concat(F.array_repeat(F.lit(0).cast("long"), before), given)))
    run = F.col("_units")
    for i in range(1, s):
        # Runs grow by one unit a step: the hash so far joined with the unit i places on.
        rest = F.size("_units") - i
        run = F.zip_with(F.slice(run, 1, rest), F.slice("_units", i + 1, rest), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_inner", run)
    every = F.sequence(F.lit(1), F.size("_units") - before)

    def closed(i: Column) -> Column:
        inner = [F.element_at("_inner", i + F.lit(j)) for j in range(k - s + 1)]
        edge = F.least(inner[0], inner[-1]) if len(inner) > 1 else inner[0]
        return edge <= F.least(*inner[1:-1]) if len(inner) > 3 else (edge <= inner[1] if len(inner) == 3 else F.lit(True))

    df = df.withColumn("_kept", F.filter(every, closed))
    kept = F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(every)
    nothing = F.array().cast("array<int>")
    df = df.withColumn("_kept", F.when(F.col("_units").isNotNull(), kept).otherwise(nothing))
    mask = F.lit(0x7FFFFFFF)
    df = df.withColumn(hashes, F.transform("_kept", lambda i: F.hash(F.slice("_units", i, k)).bitwiseAND(mask)))
    return df.withColumn(positions, F.transform("_kept", lambda i: i - F.lit(before))).drop("_units", "_inner", "_kept")


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two anchor lists' distinct hashes; 1 where neither has any."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.hex(h)), " ")


def fingerprint(docs: DataFrame, text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """``docs`` with positions, hashes and fingerprint (the hashes in hex); columns of these names are replaced.

    Equal texts have equal fingerprints. Each row is treated on its own; see :func:`with_anchors` for null and short texts.
    """
    out = with_anchors(docs.drop("positions", "hashes", "fingerprint"), text_or_empty(text_col), "positions", "hashes", k, s)
    return out.withColumn("fingerprint", as_string(F.col("hashes")))


def _chunks(docs: DataFrame, id_col: str, parts: int) -> Column:
    """Number of the id's range, ascending; ranges hold about equally many rows. Rows without an id come lowest, by hash."""
    cuts = []
    if parts > 1:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        cuts = docs.agg(F.percentile_approx(id_col, shares, F.lit(max(10_000, 5 * parts)))).first()[0] or []
    cuts = sorted(set(cuts))
    low = F.lit(-parts) + F.floor((F.col("_hash") / 2.0**64 + 0.5) * parts).cast("int")
    if not cuts:
        return F.when(F.col(id_col).isNull(), low).otherwise(F.lit(0))
    top = 1 << (len(cuts).bit_length() - 1)
    steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])
    bounds = F.array(*[F.lit(c) for c in cuts])
    # Binary search: the number of cuts that are not above the id.
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= len(cuts)) & (F.try_element_at(bounds, at + step) <= F.col(id_col)), at + step).otherwise(at),
    )
    return F.when(F.col(id_col).isNull(), low).otherwise(found)


def with_next(
    docs: DataFrame, carried: list[str], id_col: str = "doc_id", hash_col: str = "_hash", prepare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``docs`` with next_<c> for each carried column: its value in the next row by descending id, after the last the first.

    Rows of equal id follow each other by descending hash, rows without an id come last. Nothing is sorted in one
    place: ids are cut into ranges, and each range's top row is also sent to the range above, whose last row it follows.
    Ranges follow the session's shuffle partitions; a single id should not hold a large share of rows. ``docs`` is
    read twice and must be a table or stored rows. ``prepare`` adds columns to the rows after they have moved, so
    that what it adds is not moved itself.
    """
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.withColumn("_chunk", _chunks(docs, id_col, parts))
    tops = placed.groupBy("_chunk").agg(F.max(F.struct(F.col(id_col).alias("id"), F.col(hash_col).alias("hash"))).alias("_top"))
    order = Window.orderBy("_chunk")  # one row per range
    tops = tops.select("_chunk", "_top", F.lead("_chunk").over(order).alias("_above"), F.min("_chunk").over(order).alias("_least"))
    tops = stored(tops.select("_chunk", "_top", F.coalesce("_above", "_least").alias("_to")), "next-tops")
    here = F.struct(F.col("_chunk").alias("chunk"), F.lit(False).alias("extra"))
    there = F.struct(F.col("_to").alias("chunk"), F.lit(True).alias("extra"))
    is_top = F.col(id_col).eqNullSafe(F.col("_top.id")) & (F.col(hash_col) == F.col("_top.hash"))
    sent = (
        placed.join(F.broadcast(tops), "_chunk")  # a row per range, at most twice the shuffle partitions
        .withColumn("_sent", F.explode(F.when(is_top, F.array(here, there)).otherwise(F.array(here))))
        .drop("_chunk", "_top", "_to")
        .withColumns({"_in": F.col("_sent.chunk"), "_extra": F.col("_sent.extra")})
        .drop("_sent")
    )
    if prepare is not None:
        sent = prepare(sent.repartition("_in"))
    down = Window.partitionBy("_in").orderBy("_extra", F.col(id_col).desc_nulls_last(), F.col(hash_col).desc())
    follows = F.lead(F.struct(*carried)).over(down)
    out = sent.withColumn("_next", follows).filter(~F.col("_extra"))
    return out.withColumns({f"next_{c}": F.col(f"_next.{c}") for c in carried}).drop("_in", "_extra", "_next")
