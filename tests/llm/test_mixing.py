import collections

from pyspark.sql import functions as F

from evenhand.llm import mixing

from .conftest import with_clashes


def target_of(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else share * weight[s]
        open_ -= over or open_
    return target


def check(got, rows):
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    expected = target_of(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split())
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - expected[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert r["copies"] >= int(expected[r["source"]] / sizes[r["source"]] - 1e-9) if sizes[r["source"]] else True
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(1, largest[s] / 2)
    return taken, expected


def test_sources_meet_their_targets(docs, rows):
    got = mixing.mix(with_clashes(docs, ["size", "target", "copies"]), size=mixing.words()).collect()
    assert got[0]["more"] == "other"
    check(got, rows)
    again = mixing.mix(docs).collect()
    key = lambda r: repr((r["doc_id"], r["size"], r["source"]))
    assert sorted((key(r), r["taken"]) for r in got) == sorted((key(r), r["taken"]) for r in again)


def test_unique_documents_come_within_half_of_one(spark):
    rows = [(i, "w " * (1 + i % 17), None, f"s{min(i % 9, 3)}", None) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken, expected = check(mixing.mix(frame).collect(), rows)
    assert all(abs(taken[s] - expected[s]) <= 8.5 for s in taken)


def test_preference_draws_more_of_what_is_preferred(spark):
    rows = [(i, "w w w", None, "a", None, 0.5 + (i % 2)) for i in range(2000)]
    other = [(5000 + i, "w w w", None, "b", None, 1.0) for i in range(2000)]
    frame = spark.createDataFrame(rows + other, "doc_id long, text string, lang string, source string, n_chars long, liked double")
    mixed = mixing.mix(frame, preference=F.col("liked")).filter("source = 'a'")
    taken = {r["liked"]: r["n"] for r in mixed.groupBy("liked").agg(F.sum("copies").alias("n")).collect()}
    assert taken[1.5] > 2 * taken[0.5]
    assert abs(sum(taken.values()) * 3 - 4000) <= 3


def test_degenerate_tables(spark, empty):
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", None), (1, "", None, None, None)], empty.schema)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    one = spark.createDataFrame([(1, "x y", None, "a", None), (2, "z", None, "b", None)], empty.schema)
    assert {r["source"]: r["target"] for r in mixing.mix(one).collect()} == {"a": 1.0, "b": 2.0}


def test_a_column_named_size_is_replaced_by_the_words(spark, docs, rows):
    got = mixing.mix(with_clashes(docs, ["size", "source_size", "taken"])).collect()
    check(got, rows)
    check(mixing.mix(docs.withColumn("size", F.lit(7) + F.length("lang"))).collect(), rows)


def sequential_pareto(rows, ratio, probability, draw):
    """Certain copies, then rows by odds of the draw over inclusion odds until the words missing are met as nearly as can be."""
    total = sum(size for _, size in rows)
    copies = {i: int(ratio) + (probability[size] >= 1) for i, size in rows}
    left = ratio * total - sum(copies[i] * size for i, size in rows)
    order = sorted(
        ((u / (1 - u)) / (probability[size] / (1 - probability[size])), i, size) for i, size in rows if 0 < probability[size] < 1 for u in [draw[i]]
    )
    for _, i, size in order:
        if size / 2 > left:
            break
        copies[i] += 1
        left -= size
    return copies


def probabilities(rows, ratio, power=mixing.POWER, steps=mixing.STEPS):
    """Inclusion probability per size, solved by bisection instead of class by class."""
    import math

    part = ratio - int(ratio)
    liked = {size: 2 ** (round(math.log2(size**power) * steps) / steps) for _, size in rows}
    words = sum(size for _, size in rows) * part
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(size * min(1, middle * liked[size]) for _, size in rows) < words else (low, middle)
    return {size: min(1.0, high * value) for size, value in liked.items()}


def source_table(spark, count=700, seed=3):
    """Two sources; the first one's target is a fraction of its size, the second one's more than its size."""
    import random

    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([1, 2, 5, 9, 40, 200, 1500]), "a" if i % 3 else "b") for i in range(count)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_drawn_set_equals_a_sequential_pareto_sample(spark):
    rows, frame = source_table(spark)
    got = {r["doc_id"]: r for r in mixing.mix(frame).collect()}
    bits = {r["doc_id"]: r["h"] for r in frame.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h")).collect()}
    for source in "ab":
        mine = [(i, got[i]["size"]) for i, _, s in rows if s == source]
        ratio = got[mine[0][0]]["target"] / got[mine[0][0]]["source_size"]
        p = probabilities(mine, ratio)
        assert len({round(v, 6) for v in p.values()}) > 3  # really unequal
        draw = {i: ((bits[i] % 2**64) >> 11) * 2.0**-53 + 2.0**-54 for i, _ in mine}
        assert {i: got[i]["copies"] for i, _ in mine} == sequential_pareto(mine, ratio, p, draw)


def test_inclusion_frequencies_are_the_probabilities(spark):
    rows, frame = source_table(spark, 1500, 8)
    frame = frame.select("doc_id", "source", mixing.words().alias("size"), F.lit("t").alias("text"))
    runs, counts = 10, collections.Counter()
    got = []
    for seed in range(runs):
        got = mixing.mix(frame, size=F.col("size"), seed=f"run {seed}").collect()
        for r in got:
            counts[r["source"], r["size"]] += r["copies"]
    for source in "ab":
        mine = [(r["doc_id"], r["size"]) for r in got if r["source"] == source]
        ratio = next(r["target"] / r["source_size"] for r in got if r["source"] == source)
        p = probabilities(mine, ratio)
        for size, alike in collections.Counter(size for _, size in mine).items():
            n = runs * alike
            error = 3 * (max(p[size] * (1 - p[size]), 0.01) / n) ** 0.5 + 0.02
            assert abs(counts[source, size] / n - int(ratio) - p[size]) < error, (source, size, n)


def test_null_equal_and_repeated_rows_meet_the_target(spark):
    """Rows that differ in the text alone, and rows alike in everything, fill a source."""
    same = [(7, "five words are in it", "a")] * 3000 + [(None, f"text {i} of five words", "b") for i in range(3000)]
    same += [(9, f"text {i} of five words", "c") for i in range(3000)] + [(None, None, "d"), (None, "x", "d")]
    frame = spark.createDataFrame(same, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(frame, weights=(1, 1, 1, 1)).collect()
    assert len(got) == len(same)
    for source in "abcd":
        mine = [r for r in got if r["source"] == source]
        largest = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= largest / 2 + 1e-6
    uneven = mixing.mix(frame, weights=(1, 2, 3, 4)).collect()
    for source in "abcd":
        mine = [r for r in uneven if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1e-6
        assert 0 < len({r["copies"] for r in mine}) <= 2 + (source == "d")
