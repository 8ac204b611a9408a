import collections

from pyspark.sql import functions as F

from evenhand.llm import sharding

from .conftest import with_clashes


def law_holds(got, shards):
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots[s]) == list(range(len(slots[s]))) for s in slots)


def test_shards_are_even_and_slots_have_no_gaps(spark, docs, rows, empty):
    frame = with_clashes(docs, ["shard", "slot"]).withColumn("crc", F.crc32(F.coalesce("text", F.lit(""))))
    got = sharding.shard(frame, 8, tie_cols=("crc",)).collect()
    assert len(got) == len(rows) and got[0]["more"] == "other"
    law_holds(got, 8)
    assert sharding.shard(empty, 8).count() == 0
    alike = spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).union(spark.range(100).select(F.lit(5)))
    law_holds(sharding.shard(alike, 8).collect(), 8)


def test_plan_is_the_clockwise_walk_with_bounds():
    counts = {(level, cell): (level * 7 + cell) % 5 for level in range(3) for cell in range(0, sharding.CELLS, 11)}
    for slack in (0.0, 0.25):
        room = sharding.bounds(sum(counts.values()), 8, slack)
        walks, load = sharding.ring(8), [0] * 8
        for level, cell, segments in sharding.fill(counts, 8, slack):
            expected = []
            for _ in range(counts[level, cell]):  # key by key
                shard = next(s for s in walks[cell] if load[s] < room[s])
                expected.append((shard, load[shard]))
                load[shard] += 1
            starts = [s[0] for s in segments] + [counts[level, cell]]
            got = [(s, slot + i) for (first, s, slot), stop in zip(segments, starts[1:], strict=True) for i in range(stop - first)]
            assert got == expected
        assert all(n <= r for n, r in zip(load, room, strict=True))


def test_a_further_shard_moves_few_keys(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("size", F.lit(1))
    moved = {}
    for slack in (0.0, 0.25):
        a, b = (sharding.shard(keys, n, slack).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (8, 9))
        moved[slack] = a.join(b, "doc_id").filter("s8 != s9").count() / 20_000
    assert moved[0.25] < 0.25 and moved[0.0] < 0.5, moved


def test_the_ring_leaves_other_shards_in_place():
    eight, nine = sharding.ring(8), sharding.ring(9)
    assert all(a == [s for s in b if s != 8] for a, b in zip(eight, nine, strict=True))
