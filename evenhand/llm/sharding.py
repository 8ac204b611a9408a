"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to a cell of the ring and walk clockwise over the shards' virtual nodes until one has room. A
shard is full at its bound, so balance is guaranteed, and a key moves only when a shard on its walk
appears, goes or fills up. Keys arrive in a fixed order (a second hash gives the level, then cells run
clockwise), hence the walk can be planned on counts per (level, cell): at most LEVELS x CELLS rows,
however many keys there are. Everything that touches rows is built-in expressions and windows.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096
LEVELS = 16
VIRTUAL_NODES = 128


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For each cell, all shards in the order in which a clockwise walk from it meets them.

    A virtual node's place depends on its shard's number alone, so a further shard leaves others in place.
    """
    at: dict[int, list[tuple[int, int]]] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            h = zlib.crc32(f"{shard}/{v}".encode())
            at.setdefault(h % CELLS, []).append((h, shard))
    walk, walks = [], [[]] * CELLS
    for cell in range(2 * CELLS - 1, -1, -1):
        for _, shard in sorted(at.get(cell % CELLS, []), reverse=True):
            walk = [shard, *(s for s in walk if s != shard)]
        if cell < CELLS:
            walks[cell] = walk
    return walks


def bounds(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most keys of each shard. Without slack, bounds add up to ``total`` and differ by one at most."""
    if slack:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def fill(counts: dict[tuple[int, int], int], shards: int, slack: float = 0.0) -> list[tuple[int, int, list]]:
    """For each (level, cell) its segments [first rank, shard, first slot]; the walk of the bounded loads."""
    walks, room = ring(shards), bounds(sum(counts.values()), shards, slack)
    load, plan = [0] * shards, []
    for level, cell in sorted(counts):
        left, rank, segments = counts[level, cell], 0, []
        for shard in walks[cell]:
            many = min(left, room[shard] - load[shard])
            if many > 0:
                segments.append([rank, shard, load[shard]])
                load[shard] += many
                rank += many
                left -= many
            if not left:
                break
        plan.append((level, cell, segments))
    return plan


def shard(docs: DataFrame, shards: int = 8, slack: float = 0.0, key_col: str = "doc_id", tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with shard and slot (gapless from 0 in each shard); columns of these names are replaced.

    ``docs`` is read twice (counts, then placement), so it should be a table or :func:`stored` rows. Rows with
    equal keys share a cell and are told apart by ``tie_cols``, which also spread rows without a key;
    rows alike in all of these are interchangeable. An empty table gives no rows. Counts per (level, cell)
    are the only thing the driver sees; hashing spreads any group of copies or source evenly.
    """
    spark = docs.sparkSession
    key = F.col(key_col)
    ties = [F.col(c) for c in tie_cols]
    place = F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.lit("no key"), *ties))
    placed = (
        docs.drop("shard", "slot")
        .withColumn("_h", place)
        .withColumn("_cell", F.pmod("_h", F.lit(CELLS)).cast("int"))
        .withColumn("_level", F.pmod(F.shiftright("_h", 40), F.lit(LEVELS)).cast("int"))
    )
    counts = {(r["_level"], r["_cell"]): r["n"] for r in placed.groupBy("_level", "_cell").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        [(level, cell, json.dumps(segments)) for level, cell, segments in fill(counts, shards, slack)],
        "_level int, _cell int, segments string",
    ).select("_level", "_cell", F.from_json("segments", "array<array<long>>").alias("_segments"))
    order = Window.partitionBy("_level", "_cell").orderBy("_h", key, *ties)
    return (
        placed.withColumn("_rank", F.row_number().over(order) - 1)
        .join(F.broadcast(plan), ["_level", "_cell"])  # at most LEVELS x CELLS rows
        .withColumn("_hit", F.element_at(F.filter("_segments", lambda s: s[0] <= F.col("_rank")), -1))
        .withColumn("shard", F.col("_hit")[1].cast("int"))
        .withColumn("slot", F.col("_hit")[2] + F.col("_rank") - F.col("_hit")[0])
        .drop("_h", "_cell", "_level", "_rank", "_segments", "_hit")
    )
