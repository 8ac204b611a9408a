"""N-gram Jaccard join by a prefix tree.

Documents whose sets of word n-grams overlap enough are linked. Equal sets are one class from the start.
Classes that cannot have a partner are set aside by counting how many of their n-grams anyone else has; the
rest are grouped so that linked classes always meet, and each group is joined in a prefix tree of
globally ordered n-grams: paths share the overlaps counted so far, and a subtree is left as soon as
its remaining lengths cannot make up what is missing.

Why no link is lost: if |A and B| >= t |A or B|, at most n - ceil(t n) n-grams of a set of size n are not in
its partner. That bounds the n-grams nobody else has, in the whole set or in any fixed part of all possible n-grams,
and it makes the first n - ceil(t n) + 1 n-grams in any global order share one with the partner's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.joins import join_small
from evenhand.llm.common import WordHashes, lower_words_of, small_batches, stored, text_or_empty, window_hashes
from evenhand.llm.graph import components

#: The first test looks at so many times the share of n-grams that a partner may lack, so that a set passes only if others
#: have over a quarter of what is looked at. Sets up to SHORT are looked at whole.
LOOK = 4 / 3
SHORT = 128
#: N-grams in a group; one with more is cut along the sizes of its classes into blocks, which meet where their sizes allow links.
GROUP = 500_000
LEVELS = 8
SURVIVORS = 1_000_000


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words make one shingle, none make none."""
    words = hashes.of(lower_words_of(text))
    if not len(words):
        return np.zeros(0, np.int64)
    grams = window_hashes(words, n) if len(words) >= n else window_hashes(words, len(words)) + np.uint64(len(words))
    return np.unique(grams.view(np.int64))


def _ceil_share(n, num: int, den: int):
    return -(-n * num // den)


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), text_or_empty(text_col))


def _other_key(id_col: str, text_col: str):
    """A second hash of the same, so that rows are told apart by 128 bits where one of them goes."""
    return F.xxhash64(F.lit("other"), text_or_empty(text_col), F.col(id_col))


class PrefixTree:
    """Sets over local n-gram numbers as paths of ``LEVELS`` edges, each edge the set's n-grams of one stretch of the order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, vocabulary: int):
        count = len(sets)
        lengths = np.array([len(s) for s in sets])
        mass = np.bincount(np.concatenate(sets), minlength=vocabulary).cumsum() if lengths.sum() else np.zeros(vocabulary)
        stops = np.searchsorted(mass, mass[-1] * np.arange(1, LEVELS) / LEVELS) if vocabulary else np.zeros(LEVELS - 1, int)
        self.stops = np.concatenate([[0], stops, [vocabulary]])
        cuts = np.array([np.searchsorted(s, self.stops) for s in sets]).reshape(count, LEVELS + 1)
        self.rest = lengths[:, None] - cuts[:, 1:]  # n-grams left of each set after each level
        parent = np.zeros(count, np.int64)
        self.levels = []
        for level in range(LEVELS):
            seen: dict[tuple[int, bytes], int] = {}
            node, edges, up = np.zeros(count, np.int64), [], []
            for d in range(count):
                edge = sets[d][cuts[d, level] : cuts[d, level + 1]]
                at = seen.setdefault((parent[d], edge.tobytes()), len(seen))
                if at == len(edges):
                    edges.append(edge)
                    up.append(parent[d])
                node[d] = at
            up = np.array(up)
            long = np.array([len(e) for e in edges])
            most_rest, least, most, first = (np.zeros(len(edges), np.int64) for _ in range(4))
            least += 1 << 60
            first += 1 << 60
            np.maximum.at(most_rest, node, self.rest[:, level])
            np.minimum.at(least, node, sizes)
            np.maximum.at(most, node, sizes)
            np.minimum.at(first, node, np.arange(count))
            order = np.argsort(up, kind="stable")
            begin = np.searchsorted(up[order], np.arange(parent.max() + 2))
            self.levels.append(
                (np.concatenate(edges), np.concatenate([[0], long.cumsum()]), order, begin, most_rest, least, most, first)
            )
            parent = node
        self.sets, self.sizes = sets, sizes
        order = np.argsort(parent, kind="stable")
        self.leaves = order, np.searchsorted(parent[order], np.arange(parent.max() + 2))
        self.mark = np.zeros(vocabulary, np.int64)

    def partners(self, d: int, num: int, den: int) -> np.ndarray:
        """Sets before ``d`` (no larger than it) that link with it."""
        size = self.sizes[d]
        self.mark[self.sets[d]] = 1
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level, (grams, at, order, begin, most_rest, least, most, first) in enumerate(self.levels):
            children, overlap = _below(nodes, overlap, order, begin)
            ok = (first[children] < d) & (den * most[children] >= num * size)
            children, overlap = children[ok], overlap[ok]
            if not len(children):
                break
            long = at[children + 1] - at[children]
            where = np.repeat(at[children] - (long.cumsum() - long), long) + np.arange(long.sum())
            total = np.concatenate([[0], self.mark[grams[where]].cumsum()])
            ends = long.cumsum()
            overlap = overlap + total[ends] - total[ends - long]
            bound = overlap + np.minimum(self.rest[d, level], most_rest[children])
            ok = bound * (num + den) >= num * (size + np.maximum(least[children], _ceil_share(size, num, den)))
            nodes, overlap = children[ok], overlap[ok]
            if not len(nodes):
                break
        else:
            found, overlap = _below(nodes, overlap, *self.leaves)
            ok = (found < d) & (overlap * (num + den) >= num * (size + self.sizes[found]))
            self.mark[self.sets[d]] = 0
            return found[ok]
        self.mark[self.sets[d]] = 0
        return np.zeros(0, np.int64)


def _below(nodes: np.ndarray, carried: np.ndarray, order: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    many = begin[nodes + 1] - begin[nodes]
    where = np.repeat(begin[nodes] - (many.cumsum() - many), many) + np.arange(many.sum())
    return order[where], np.repeat(carried, many)


def link_group(ids: np.ndarray, sets: list[np.ndarray], marks: np.ndarray, own, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a group its least linked id, transitively, and its number of links.

    ``own(mark, mark)`` says whether a pair of classes with these marks is this group's to count.
    """
    sizes = np.array([len(s) for s in sets])
    by_size = np.lexsort((ids, sizes))
    flat = np.concatenate(sets)
    _, local, seen = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(-seen, kind="stable")] = np.arange(len(seen))
    shared = int((seen > 1).sum())
    parts = np.split(rank[local], sizes.cumsum()[:-1])
    parts = [np.sort(parts[d][parts[d] < shared]) for d in by_size]
    able = np.array([den * len(p) >= num * sizes[d] for p, d in zip(parts, by_size, strict=True)])
    chosen = by_size[able]
    root, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if len(chosen) > 1:
        tree = PrefixTree([p for p, a in zip(parts, able, strict=True) if a], sizes[chosen], shared)
        for d in range(1, len(chosen)):
            for e in tree.partners(d, num, den):
                x, y = chosen[d], chosen[e]
                if own is not None and not own(marks[x], marks[y]):
                    continue
                links[x] += 1
                links[y] += 1
                x, y = find(x), find(y)
                if ids[x] > ids[y]:
                    x, y = y, x
                root[y] = x
    return np.array([ids[find(x)] for x in range(len(ids))]), links


def _join_groups(num: int, den: int):
    """Joins the groups of a partition, whose rows come sorted by group; a group may span batches."""

    def one(rows: list[pd.DataFrame]) -> pd.DataFrame:
        group = pd.concat(rows).drop_duplicates("cid")
        kind, pair = group["kind"].iloc[0], (group["low"].iloc[0], group["high"].iloc[0])
        own = None if kind == 0 else (lambda a, b: (min(a, b), max(a, b)) == pair)
        ids = group["cid"].to_numpy()
        root, links = link_group(ids, [np.asarray(s) for s in group["grams"]], group["block"].to_numpy(), own, num, den)
        return pd.DataFrame({"cid": ids, "root": root, "links": links, "kind": kind})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, rows = None, []
        for batch in batches:
            keys = list(zip(batch["comp"], batch["low"], batch["high"], strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != open_key and rows:
                        yield one(rows)
                        rows = []
                    open_key = keys[start]
                    rows.append(batch.iloc[start:i])
                    start = i
        if rows:
            yield one(rows)

    return join


def _in_blocks(met: DataFrame, group: int) -> DataFrame:
    """``met`` (comp, cid, n) with block: about ``group`` n-grams of a component each, in the order of set sizes.

    Counts per component and size place the blocks; a size with too many sets is dealt over several blocks by hash.
    """
    sizes = met.groupBy("comp", "n").agg(F.count("*").alias("_sets"))
    before = Window.partitionBy("comp").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.floor(F.coalesce(F.sum(F.col("_sets") * F.col("n")).over(before), F.lit(0)) / F.lit(group)).cast("long")
    many = F.ceil(F.col("_sets") * F.col("n") / F.lit(group)).cast("long")
    placed = sizes.select("comp", "n", start.alias("_start"), many.alias("_many"))
    spread = F.col("_start") + F.pmod(F.xxhash64("cid"), F.col("_many"))
    return join_small(met, placed, ["comp", "n"]).withColumn("block", spread).drop("_start", "_many", "_grams")


def similar(
    docs: DataFrame,
    n: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
    keys: bool = False,
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, class_id, n_links, component_id.

    Two documents link when ``den * intersection >= num * union`` of their sets of ``n``-word shingles. class_id is
    the least id with the same set, n_links the number of other classes its class links with, component_id the
    least id reachable by links. A null or empty text has an empty set, links with nothing and is its
    own class and component. Repeated rows share a class; a null id is never the least unless all are null.
    ``docs`` is read twice and must be a table or stored rows. Other columns are left out.
    An empty table gives no rows. With ``keys`` three columns follow: _key and _key2, equal for rows equal in id and text, and
    _root, equal within a component and null for empty sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("_id"), _key(id_col, text_col).alias("_key"), _other_key(id_col, text_col).alias("_key2"), text_or_empty(text_col).alias("_text"))
    limit = min(int(LOOK * (1 - num / den) * 2**64 - 2**63), 2**63 - 1)

    @F.pandas_udf("n long, d1 long, d2 long, part array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in batches:
            rows = []
            for text in texts:
                grams = shingles(text, n, hashes)
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                d1, d2 = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
                rows.append((len(grams), d1, d2, grams if len(grams) <= SHORT else grams[: np.searchsorted(grams, limit)]))
            yield pd.DataFrame(rows, columns=["n", "d1", "d2", "part"])

    signed = stored(base.select("_id", "_key", "_key2", sign("_text").alias("_s")).select("_id", "_key", "_key2", "_s.*"), "jaccard-signatures")
    classes = stored(
        signed.groupBy("n", "d1", "d2").agg(
            F.min("_key").alias("cid"), F.min("_id").alias("class_id"), F.count("*").alias("copies")
        ),
        "jaccard-classes",
    )

    # First test: how many of a class's n-grams, within the looked-at part, has any other class?
    whole_to = num * SHORT // den  # partners of these are looked at whole as well
    looked = F.when(F.col("n") <= whole_to, F.col("part")).otherwise(F.filter("part", lambda g: g < limit))
    miss = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)).cast("long")
    grams = signed.filter("n > 0").select("d1", F.explode("part").alias("gram"))
    common = (
        grams.groupBy("gram").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).filter(F.col("a") != F.col("b")).select("gram")
    )
    tested = signed.filter("n > 0").select("d1", F.explode(looked).alias("gram"))
    have = tested.join(common, "gram").groupBy("d1").agg(F.count("*").alias("have"))
    wanted = signed.filter("n > 0").groupBy("n", "d1", "d2").agg(F.sum(F.size(looked) - miss).alias("want"))
    able = (
        wanted.join(have, "d1", "left")
        .filter(F.coalesce("have", F.lit(0)) >= F.col("want"))
        .join(classes, ["n", "d1", "d2"])
        .select("cid", "n", "d1")
    )
    able = stored(able, "jaccard-able")

    # Whole sets of those classes only, each from one of its documents.
    @F.pandas_udf("array<long>")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([shingles(text, n, hashes) for text in texts])

    picked = join_small(base, able.withColumnRenamed("cid", "_key"), ["_key"], max_rows=SURVIVORS)
    sets = picked.select(F.col("_key").alias("cid"), "n", whole("_text").alias("grams"))
    # Filtered only when stored: a filter beside the function would have it run twice.
    sets = stored(sets, "jaccard-sets").filter(F.size("grams") == F.col("n"))

    # Prefixes in the order of (number of classes, hash); the same test again, now on whole sets.
    rows = sets.select("cid", "n", F.explode("grams").alias("gram"))
    seen = rows.groupBy("gram").agg(F.count("*").alias("seen")).filter("seen > 1")
    placed = rows.join(seen, "gram")
    per = Window.partitionBy("cid")
    placed = placed.withColumn("_have", F.count("*").over(per)).withColumn(
        "_at", F.row_number().over(per.orderBy("seen", "gram")) + F.col("n") - F.col("_have")
    )
    prefix = placed.filter((F.col("_have") >= F.col("n") - miss) & (F.col("_at") <= miss + 1)).select("cid", "gram")
    prefix = stored(prefix, "jaccard-prefixes")
    heads = prefix.groupBy("gram").agg(F.min("cid").alias("head"), F.max("cid").alias("_tail")).filter("head != _tail")
    comps = components(prefix.join(heads, "gram").select(F.col("cid").alias("a"), F.col("head").alias("b")))

    # Groups: candidate components, large ones in blocks. Which class goes where is settled on narrow rows; the sets move once.
    met = sets.select("cid", "n").join(comps.select(F.col("node").alias("cid"), F.col("root").alias("comp")), "cid")
    met = stored(met, "jaccard-met")
    counts = stored(met.groupBy("comp").agg(F.sum("n").alias("_grams")), "jaccard-groups")
    met = join_small(met, counts, ["comp"])
    nothing = F.lit(0).cast("long")
    goes = met.filter(F.col("_grams") <= group).select(
        "cid", "comp", F.lit(0).alias("kind"), nothing.alias("low"), nothing.alias("high"), nothing.alias("block")
    )
    has_large = bool(counts.filter(F.col("_grams") > group).limit(1).count())
    if has_large:
        cut = _in_blocks(met.filter(F.col("_grams") > group), group)
        blocks = stored(cut.groupBy("comp", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")), "jaccard-blocks")
        low = blocks.select("comp", F.col("block").alias("low"), F.col("most").alias("_most"))
        high = blocks.select("comp", F.col("block").alias("high"), F.col("least").alias("_least"))
        # Higher blocks hold larger sets: two meet if the largest of the lower may link with the smallest of the higher.
        pairs = low.join(high, "comp").filter(
            (F.col("low") == F.col("high")) | ((F.col("low") < F.col("high")) & (den * F.col("_most") >= num * F.col("_least")))
        )
        pairs = pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high")))).select("comp", "block", "low", "high")
        large = join_small(cut, pairs, ["comp", "block"]).select("cid", "comp", F.lit(1).alias("kind"), "low", "high", "block")
        goes = goes.unionByName(large)
    goes = stored(goes, "jaccard-goes")
    groups = join_small(sets.select("cid", "grams"), goes, ["cid"], max_rows=SURVIVORS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = (
        groups.repartition(parts, "comp", "low", "high")
        .sortWithinPartitions("comp", "low", "high")
        .mapInPandas(_join_groups(num, den), "cid long, root long, links long, kind int")
    )
    found = stored(found, "jaccard-links")
    roots = found.filter("kind = 0").select("cid", "root", "links")
    if has_large:
        over = found.filter("kind = 1")
        merged = components(over.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        counted = over.groupBy("cid").agg(F.sum("links").alias("links"))
        roots = roots.unionByName(
            counted.join(merged.withColumnRenamed("node", "cid"), "cid", "left").select(
                "cid", F.coalesce("root", "cid").alias("root"), "links"
            )
        )
    linked = classes.filter("n > 0").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    linked = stored(linked.select("n", "d1", "d2", "class_id", "root", F.coalesce("links", F.lit(0)).alias("n_links")), "jaccard-roots")
    least = linked.groupBy("root").agg(F.min("class_id").alias("component_id"))
    by_class = linked.join(least, "root")
    narrow = signed.select("_id", "_key", "_key2", "n", "d1", "d2")
    with_text = narrow.filter("n > 0").join(by_class, ["n", "d1", "d2"])
    without = narrow.filter("n = 0").select("*", F.col("_id").alias("class_id"), F.lit(None).cast("long").alias("root"), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    more = ["_key", "_key2", F.col("root").alias("_root")] if keys else []
    return with_text.unionByName(without).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "n_links", "component_id", *more
    )


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of :func:`similar`: the least id, of equal ids one text, of equal rows one.

    Rows with an empty set are all kept. All columns are kept. ``docs`` must be a table or stored rows. The keys of rows
    that go are broadcast where they are few, else joined; texts move in the second case only.
    """
    marked = stored(similar(docs, n, num, den, id_col, text_col, keys=True).filter(F.col("_root").isNotNull()), "jaccard-marked")
    both = ["_key", "_key2"]
    # One row per document and task first, so that a component of copies does not meet in one task.
    rows = marked.groupBy("_root", F.col(id_col).alias("_id"), *both).agg(F.count("*").alias("_n"))
    rows = stored(rows, "jaccard-documents")
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), *both)
    first = rows.groupBy("_root").agg(F.min(order).alias("_first")).select(F.struct("_root", "_first._key", "_first._key2").alias("_kept"))
    # Whether a row is its component's first is asked by root and keys together, which spreads a large component.
    asked = rows.withColumn("_kept", F.struct("_root", *both))
    gone = stored(asked.join(first, "_kept", "left_anti").select(*both).distinct(), "jaccard-gone")
    again = stored(rows.filter("_n > 1").select(*both), "jaccard-repeats")
    keyed = docs.withColumns({"_key": _key(id_col, text_col), "_key2": _other_key(id_col, text_col)})
    left = join_small(keyed, gone, both, "left_anti", SURVIVORS)
    if not again.limit(1).count():
        return left.drop(*both)
    once = join_small(left, again, both, "left_anti", SURVIVORS)
    many = join_small(left, again, both, "left_semi", SURVIVORS).dropDuplicates(both)
    return once.unionByName(many).drop(*both)
