"""Forests grown a whole tree per task, over rows counted by their bins.

Spark's forest sends a histogram per node through a shuffle and keeps all nodes on the driver, so its time and memory follow the nodes of hundreds
of trees of unlimited depth. A tree sees nothing of a row but its bins and label, however, so rows are counted by those first: at most
2 * 32^features counts, whatever the table's size. They are sent to the tasks once, and each task grows whole trees from them, by Spark's rules: at most
32 bins a feature, bags with replacement, sqrt(features) features a node, gini, sibling leaves of one prediction joined.

Draws depend on the seed and a tree's number only. A tree cut at a depth is thus the tree that grows to this depth, and a smaller forest is the
beginning of a larger one, so settings that differ in these are read off the same trees.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.session import work_dir

# Functions go to Python workers whole, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
# Trees that a task grows, and test rows whose votes travel together.
TREES_A_TASK = 10
BLOCK = 65_536
# Values by which a task sums up a feature.
POINTS = 1024
# Histogram cells that are looked through at once; as many stay in a core's cache.
CELLS_AT_ONCE = 32_768
# The distribution of how often a row comes into a bag: the chances of at most 0, 1, ... times, as far as they differ from 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
# Rows that are led down a tree at once.
ROWS_AT_ONCE = 16_384


@dataclass(frozen=True)
class Growth:
    """What a tree depends on besides its number: the settings that share it differ in depth and number of trees only."""

    least: int
    per_node: int
    seed: int

    @staticmethod
    def of(forest: RandomForestClassifier, features: int) -> Growth:
        per_node = features if forest.getNumTrees() == 1 else math.ceil(math.sqrt(features))
        return Growth(forest.getMinInstancesPerNode(), per_node, forest.getSeed())


@dataclass(frozen=True)
class Tree:
    """Nodes by level, the root first; ``left`` is -1 at a leaf, the right child comes after the left one.

    total and ones count the bagged rows of a node and those among them with label 1; starts has each level's first node, and the number of nodes.
    """

    total: np.ndarray
    ones: np.ndarray
    left: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    starts: list[int]


# Rows counted by bins: a row of bins per feature, a row of counts per label.
Counts = tuple[np.ndarray, np.ndarray]


def drawn(counts: np.ndarray, seed: int, number: int) -> tuple[np.ndarray, np.random.Generator]:
    """The bag of a tree, as counts by label, and the generator of its further draws.

    A row comes Poisson(1) times, as in Spark's bags, so n equal rows come Poisson(n) times.
    """
    rng = np.random.default_rng([seed, number])
    bag = counts.reshape(-1).astype(np.int64)
    once, more = np.flatnonzero(bag == 1), np.flatnonzero(bag > 1)
    bag[once] = np.searchsorted(POISSON, rng.random(len(once)), side="right")
    bag[more] = rng.poisson(bag[more])
    return bag.reshape(counts.shape), rng


def _gini(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    zeros, positive = (total - ones) / total, ones / total
    return 1.0 - zeros * zeros - positive * positive


def _best_cuts(total: np.ndarray, ones: np.ndarray, all_total: np.ndarray, all_ones: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of histograms added up from the left, a row per node: the gain of the best cut, its bin, and what lies left of it.

    The gain is -inf where a side holds fewer than ``least``.
    """
    all_total, all_ones = all_total[:, None], all_ones[:, None]
    total, ones = total[:, :-1], ones[:, :-1]
    rest = all_total - total
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _gini(all_ones, all_total) - total / all_total * _gini(ones, total) - rest / all_total * _gini(all_ones - ones, rest)
    gain[(total < least) | (rest < least)] = -np.inf
    at, node = gain.argmax(1), np.arange(len(gain))
    return gain[node, at], at, total[node, at], ones[node, at]


def grow(bins: np.ndarray, bag: np.ndarray, growth: Growth, depth: int, rng: np.random.Generator) -> Tree:
    """One tree, a level at a time. A node whose drawn features have no cut with a gain is a leaf, as are pure nodes."""
    features, count = bins.shape
    flat = bins.reshape(-1)
    total = bag.sum(0)
    row = np.flatnonzero(total)
    total, ones = total[row].astype(float), bag[1, row].astype(float)
    # Both counts add up in one number where it holds them exactly: rows of label 1 times unit, and all rows, fewer than unit.
    unit = float(1 << int(total.sum()).bit_length())
    packed = unit * unit <= 2.0**53
    weights = [ones * unit + total] if packed else [total, ones]
    node = np.zeros(len(row), dtype=np.int64)
    parts = [(np.array([total.sum()]), np.array([ones.sum()]))]
    splits: list[tuple[np.ndarray, ...]] = []
    ids, starts = np.zeros(1, dtype=np.int64), [0, 1]
    for _ in range(depth):
        if not len(ids) or not len(row):
            break
        open_nodes, step = len(ids), CELLS_AT_ONCE // BINS
        if growth.per_node < features:
            chosen = np.sort(np.argpartition(rng.random((open_nodes, features)), growth.per_node - 1, axis=1)[:, : growth.per_node], axis=1)
        else:
            chosen = np.broadcast_to(np.arange(features), (open_nodes, features))
        own_total, own_ones = (part[ids - starts[-2]] for part in parts[-1])
        best, feature, cut, left_total, left_ones = (np.full(open_nodes, v) for v in (-np.inf, 0, 0, 0.0, 0.0))
        for j in range(growth.per_node):
            tried = chosen[:, j]
            # Rows that have come to an end are in one more node, the last.
            cell = np.append(tried * count, 0)[node]
            cell += row
            cell = node * BINS + flat[cell]
            found = [np.bincount(cell, w, (open_nodes + 1) * BINS).reshape(-1, BINS) for w in weights]
            for low in range(0, open_nodes, step):
                part = slice(low, min(low + step, open_nodes))
                added = [np.cumsum(f[part], axis=1) for f in found]
                if packed:
                    by_ones = np.floor(added[0] / unit)
                    added = [added[0] - by_ones * unit, by_ones]
                gain, at, lt, lo = _best_cuts(*added, own_total[part], own_ones[part], growth.least)
                better = gain > best[part]
                for kept, new in ((best, gain), (feature, tried[part]), (cut, at), (left_total, lt), (left_ones, lo)):
                    kept[part][better] = new[better]
        split = np.flatnonzero(best > 0)
        if not len(split):
            break
        splits.append((ids[split], starts[-1] + 2 * np.arange(len(split)), feature[split], cut[split], best[split]))
        both = lambda part, whole: np.stack([part[split], (whole - part)[split]], axis=1).reshape(-1)  # noqa: B023, E731
        parts.append((both(left_total, own_total), both(left_ones, own_ones)))
        below_total, below_ones = parts[-1]
        # A child that is pure or too small for any cut ends here.
        goes_on = (below_ones > 0) & (below_ones < below_total) & (below_total >= 2 * growth.least)
        ids = starts[-1] + np.flatnonzero(goes_on)
        starts.append(starts[-1] + 2 * len(split))
        place = np.full((open_nodes + 1, 2), len(ids))
        place[split] = np.where(goes_on, np.cumsum(goes_on) - 1, len(ids)).reshape(-1, 2)
        cell = np.append(feature * count, 0)[node]
        cell += row
        node = place.reshape(-1)[2 * node + (flat[cell] > np.append(cut, 0)[node])]
        stay = node < len(ids)
        if np.count_nonzero(stay) < 0.8 * len(stay):
            row, node, *weights = (v[stay] for v in (row, node, *weights))
    left, feature, cut, gain = (np.full(starts[-1], v) for v in (-1, -1, -1, -1.0))
    for at, *values in splits:
        for kept, new in zip((left, feature, cut, gain), values, strict=True):
            kept[at] = new
    return Tree(*(np.concatenate(x) for x in zip(*parts, strict=True)), left, feature, cut, gain, starts)


def reached(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node without children that each column of ``bins`` falls into."""
    count = bins.shape[1]
    flat, node = bins.reshape(-1), np.empty(count, dtype=np.int64)
    # A leaf leads to itself; rows there are taken out when they are many.
    leaf = tree.left < 0
    below, first, cut = np.where(leaf, np.arange(len(leaf)), tree.left), np.where(leaf, 0, tree.feature * count), np.where(leaf, BINS, tree.cut)
    for low in range(0, count, ROWS_AT_ONCE):
        row = np.arange(low, min(low + ROWS_AT_ONCE, count))
        at = np.zeros(len(row), dtype=np.int64)
        for _ in range(len(tree.starts) - 2):
            cell = first[at]
            cell += row
            at = below[at] + (flat[cell] > cut[at])
            on = ~leaf[at]
            if np.count_nonzero(on) < 0.7 * len(on):
                node[row] = at
                row, at = row[on], at[on]
        node[row] = at
    return node


def settled(tree: Tree, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut at ``depth``: whether a node ends paths, and the node in which the paths through each node end.

    As in Spark, two leaves of one parent that predict the same are joined, from the bottom up.
    """
    leaf, says = tree.left < 0, 2 * tree.ones > tree.total
    levels = [np.arange(a, b) for a, b in zip(tree.starts, tree.starts[1:], strict=False)]
    if depth < len(levels):
        leaf[levels[depth]] = True
    for nodes in levels[:depth][::-1]:
        inner = nodes[~leaf[nodes]]
        l, r = tree.left[inner], tree.left[inner] + 1  # noqa: E741
        leaf[inner] = leaf[l] & leaf[r] & (says[l] == says[r])
    end = np.arange(len(leaf))
    for nodes in levels:
        inner = nodes[tree.left[nodes] >= 0]
        over = leaf[inner] | (end[inner] != inner)
        for child in (tree.left[inner], tree.left[inner] + 1):
            end[child] = np.where(over, end[inner], child)
    return leaf, end


def votes(tree: Tree, depth: int, at: np.ndarray) -> np.ndarray:
    """What the tree, cut at ``depth``, says of rows that reached the nodes ``at``: the share of label 1."""
    _, end = settled(tree, depth)
    return (tree.ones / np.maximum(tree.total, 1.0))[end][at]


def node_rows(tree: Tree, depth: int, cuts: Sequence[np.ndarray]) -> pa.StructArray:
    """The nodes of the tree, cut at ``depth``, as Spark stores them: ids in preorder, -1 for what a leaf lacks."""
    leaf, end = settled(tree, depth)
    levels = [np.arange(a, b) for a, b in zip(tree.starts, tree.starts[1:], strict=False)]
    size, place = np.ones(len(leaf), dtype=np.int64), np.zeros(len(leaf), dtype=np.int64)
    for nodes in levels[::-1]:
        inner = nodes[~leaf[nodes]]
        size[inner] += size[tree.left[inner]] + size[tree.left[inner] + 1]
    for nodes in levels:
        inner = nodes[~leaf[nodes] & (end[nodes] == nodes)]
        place[tree.left[inner]] = place[inner] + 1
        place[tree.left[inner] + 1] = place[inner] + 1 + size[tree.left[inner]]
    kept = np.flatnonzero(end == np.arange(len(end)))
    kept = kept[np.argsort(place[kept])]
    inner, child = ~leaf[kept], tree.left[kept]
    number = lambda values: pa.array(np.where(inner, values, -1), pa.int32())
    limits = np.zeros((len(cuts), BINS))
    for f, points in enumerate(cuts):
        limits[f, : len(points)] = points
    at = kept[inner]
    threshold = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inner)]), pa.int32()), pa.array(limits[tree.feature[at], tree.cut[at]]))
    split = {"featureIndex": number(tree.feature[kept]), "leftCategoriesOrThreshold": threshold, "numCategories": pa.array(np.full(len(kept), -1), pa.int32())}
    ones, total = tree.ones[kept], tree.total[kept]
    stats = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(kept) + 1, 2), pa.int32()), pa.array(np.stack([total - ones, ones], axis=1).reshape(-1)))
    values = {
        "id": pa.array(np.arange(len(kept)), pa.int32()),
        "prediction": pa.array((2 * ones > total).astype(float)),
        "impurity": pa.array(_gini(ones, np.maximum(total, 1.0))),
        "impurityStats": stats,
        "rawCount": pa.array(total.astype(np.int64)),
        "gain": pa.array(np.where(inner, tree.gain[kept], -1.0)),
        "leftChild": number(place[child]),
        "rightChild": number(place[child + 1]),
        "split": pa.StructArray.from_arrays([*split.values()], [*split]),
    }
    return pa.StructArray.from_arrays([*values.values()], [*values])


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length, a row per array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cut_points(rows: DataFrame, features: int) -> list[np.ndarray]:
    """Per feature of ``x``, where its bins end: midway between all its values if they are few, else where its quantiles are nearest.

    All rows count. A task with many values of a feature sums them up as ``POINTS`` stretches of equally many rows, so a cut is at most
    that share of the rows off its quantile; Spark takes quantiles of a sample of 10,000 rows.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_matrix(batch.column(0)) for batch in batches if len(batch)]
        for f, x in enumerate(np.concatenate(found).T if found else ()):
            values, counts = np.unique(x, return_counts=True)
            if len(values) > POINTS:
                # The last value of each stretch stands for it.
                ends = np.unique(np.searchsorted(np.cumsum(counts), np.arange(1, POINTS + 1) * len(x) / POINTS).clip(0, len(values) - 1))
                values, counts = values[ends], np.diff(np.cumsum(counts)[ends], prepend=0)
            lists = [pa.array([v.tolist()]) for v in (values, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), *lists], ["f", "v", "n"])

    parts: list[list[tuple]] = [[] for _ in range(features)]
    for f, v, n in rows.select("x").mapInArrow(summed, "f int, v array<double>, n array<bigint>").collect():
        parts[f].append((v, n))
    return [_cuts(*(np.concatenate(x) for x in zip(*p, strict=True))) for p in parts]


def _cuts(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    values, place = np.unique(values, return_inverse=True)
    if len(values) > BINS:
        below = np.cumsum(np.bincount(place, counts))
        goals = np.arange(1, BINS) * below[-1] / BINS
        at = np.searchsorted(below, goals).clip(1)
        at -= goals - below[at - 1] < below[at] - goals
        at = np.unique(at[at < len(values) - 1])
    else:
        at = np.arange(len(values) - 1)
    return (values[at] + values[at + 1]) / 2


def counted(rows: DataFrame, cuts: Sequence[np.ndarray]) -> tuple[Counts, Counts]:
    """The rows of ``x``, ``label`` (0 or 1) and ``test`` by their bins: those to learn from and those to test on.

    Bins are sorted, so that draws do not depend on the table's layout.
    """

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
                ends = pa.array(np.arange(0, bins.size + 1, len(cuts)), pa.int32())
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, ends.buffers()[1], pa.py_buffer(bins.tobytes())])
                yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], ["bins", "label", "test"])

    placed = rows.select("x", "label", "test").mapInArrow(binned, "bins binary, label double, test boolean")
    table = placed.groupBy("bins", "test").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).toArrow()

    def sorted_by_bins(part: pa.Table) -> Counts:
        packed = part["bins"].cast(pa.binary(len(cuts))).combine_chunks()
        bins = np.frombuffer(packed.buffers()[1] or b"", dtype=np.uint8)[packed.offset * len(cuts) :][: len(packed) * len(cuts)].reshape(-1, len(cuts))
        order = np.lexsort(bins.T)
        n, ones = (part[c].to_numpy().astype(np.int64)[order] for c in ("n", "ones"))
        return np.ascontiguousarray(bins[order].T), np.stack([n - ones, ones])

    return sorted_by_bins(table.filter(pc.invert(table["test"]))), sorted_by_bins(table.filter(table["test"]))


def as_arrays(ready: DataFrame) -> DataFrame:
    """Rows of (features, label, ...) with the features as the array ``x``."""
    return ready.withColumn("x", vector_to_array("features")).drop("features")


def areas(rows: DataFrame, features: int, forests: Sequence[RandomForestClassifier]) -> list[float]:
    """The exact area under the ROC curve on the rows to ``test`` on, of each of the ``forests`` grown on the others.

    Test rows are counted by bins too. A row's score is the sum of the trees' shares of label 1, as in Spark.
    """
    spark = rows.sparkSession
    cuts = cut_points(rows.where(~F.col("test")), features)
    held = spark.sparkContext.broadcast(counted(rows, cuts))
    by_growth: dict[Growth, list[tuple[int, int, int]]] = {}
    for i, forest in enumerate(forests):
        by_growth.setdefault(Growth.of(forest, features), []).append((forest.getMaxDepth(), forest.getNumTrees(), i))
    growths, wanted = list(by_growth), list(by_growth.values())
    chunks = [
        (g, first, min(first + TREES_A_TASK, high), max(d for d, n, _ in settings if n > first))
        for g, settings in enumerate(wanted)
        for low, high in _stretches([n for _, n, _ in settings])
        for first in range(low, high, TREES_A_TASK)
    ]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bins, counts), (test_bins, _) = held.value
        schema = pa.schema([*[(c, pa.int32()) for c in ("g", "depth", "block", "first")], ("votes", pa.binary())])
        for batch in batches:
            for chunk in batch.to_pylist():
                g, first = chunk["g"], chunk["first"]
                sums = {d: np.zeros(test_bins.shape[1]) for d, n, _ in wanted[g] if n > first}
                for number in range(first, chunk["last"]):
                    bag, rng = drawn(counts, growths[g].seed, number)
                    tree = grow(bins, bag, growths[g], chunk["depth"], rng)
                    at = reached(tree, test_bins)
                    for d in sums:
                        sums[d] += votes(tree, d, at)
                for d, total in sums.items():
                    for low in range(0, len(total), BLOCK):
                        one = {"g": g, "depth": d, "block": low, "first": first, "votes": total[low : low + BLOCK].tobytes()}
                        yield pa.RecordBatch.from_pylist([one], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        g, depth, block = (table[c][0].as_py() for c in ("g", "depth", "block"))
        parts = sorted(zip(table["first"].to_pylist(), table["votes"].to_pylist(), strict=True))
        out = []
        for d, trees, setting in wanted[g]:
            if d == depth:
                score = np.sum([np.frombuffer(v) for first, v in parts if first < trees], axis=0)
                out.append({"setting": setting, "block": block, "score": score.tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("setting", pa.int32()), ("block", pa.int32()), ("score", pa.binary())]))

    def area(table: pa.Table) -> pa.Table:
        _, (_, (zeros, ones)) = held.value
        score = np.concatenate([np.frombuffer(s) for _, s in sorted(zip(table["block"].to_pylist(), table["score"].to_pylist(), strict=True))])
        return pa.table({"setting": table["setting"][:1], "area": pa.array([_area(score, zeros, ones)])})

    # The longest first; a task takes one chunk, whatever order they come in.
    longest = sorted(chunks, key=lambda c: (-c[3], c))
    tasks = spark.sparkContext.parallelize(longest, len(longest)).toDF("g int, first int, last int, depth int")
    voted = tasks.mapInArrow(vote, "g int, depth int, block int, first int, votes binary")
    summed = voted.groupBy("g", "depth", "block").applyInArrow(add, "setting int, block int, score binary")
    found = dict(map(tuple, summed.groupBy("setting").applyInArrow(area, "setting int, area double").collect()))
    held.unpersist()
    return [found.get(i, 0.0) for i in range(len(forests))]


def _area(score: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> float:
    """The share of pairs of labels 0 and 1 that the scores put in order, ties as halves."""
    _, place = np.unique(score, return_inverse=True)
    zeros, ones = np.bincount(place, zeros), np.bincount(place, ones)
    return float((ones * (np.cumsum(zeros) - zeros / 2)).sum() / max(zeros.sum() * ones.sum(), 1.0))


def _stretches(numbers: Sequence[int]) -> list[tuple[int, int]]:
    """Of forests that begin alike, the stretches of trees between one's end and the next one's."""
    ends = sorted(set(numbers))
    return list(zip([0, *ends], ends, strict=False))


def grown_forest(rows: DataFrame, features: int, forest: RandomForestClassifier) -> RandomForestClassificationModel:
    """The forest grown on ``rows`` (x, label) as a model of Spark's, by way of its stored form."""
    spark = rows.sparkSession
    cuts = cut_points(rows, features)
    growth, depth = Growth.of(forest, features), forest.getMaxDepth()
    held = spark.sparkContext.broadcast(counted(rows.withColumn("test", F.lit(False)), cuts)[0])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, counts = held.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                bag, rng = drawn(counts, growth.seed, number)
                found = node_rows(grow(bins, bag, growth, depth, rng), depth, cuts)
                for low in range(0, len(found), BLOCK):
                    part = found[low : low + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number), pa.int32()), part], ["treeID", "nodeData"])

    # Everything but the nodes is what Spark stores of a forest of this setting on two rows.
    path = work_dir(spark, "forest")
    two = spark.range(0, 2, numPartitions=1).select(F.col("id").cast("double").alias("label"))
    forest.fit(two.withColumn("features", array_to_vector(F.array_repeat("label", features)))).write().save(f"{path}/two")
    spark.read.text(f"{path}/two/metadata").coalesce(1).write.text(f"{path}/model/metadata")
    spark.read.parquet(f"{path}/two/treesMetadata").write.parquet(f"{path}/model/treesMetadata")
    trees = spark.range(0, forest.getNumTrees(), numPartitions=-(-forest.getNumTrees() // TREES_A_TASK))
    trees.mapInArrow(nodes, spark.read.parquet(f"{path}/two/data").schema).write.parquet(f"{path}/model/data")
    return RandomForestClassificationModel.load(f"{path}/model")

