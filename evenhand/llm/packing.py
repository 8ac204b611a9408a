"""Packing: best-fit decreasing over remaining capacities, planned on a histogram of lengths.

Documents become token ids. An overlong one is first cut into full windows and a rest. Which
sequence a piece joins depends on its length alone, so the plan is made on counts per length (at
most one row per possible length, whatever the corpus), and pieces find their place by their rank
among the pieces of their length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import small_batches, stored, text_or_empty
from evenhand.llm.tokens import encoder_of

WINDOW = 4096
END = 2
#: Pieces of one length that are ranked in one window; the number of windows per length follows from its count.
PER_SALT = 1_000


def tokenise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end: int = END,
    tokenizer: str | None = None,
    digest: bool = False,
) -> DataFrame:
    """Pieces of at most ``window`` ids: ``id_col``, start, length, doc_tokens, ids (binary, little-endian 32 bit).

    Every row of ``docs`` is a document of its own, also when ids repeat or are null. A null or empty
    text has the end id alone. Cuts fall after each full window. Other columns are left out. With ``digest``
    a piece brings ids_crc32, the checksum of its ids, in their place.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(f"doc_tokens long, pieces array<{'long' if digest else 'binary'}>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer)
        for texts in batches:
            totals, pieces = [], []
            for text in texts:
                two = encoder.encode(text)
                ids = np.empty(len(two) // 2 + 1, "<u4")
                ids[:-1] = np.frombuffer(two, "<u2")
                ids[-1] = end
                cuts = [ids[s : s + window] for s in range(0, len(ids), window)]
                totals.append(len(ids))
                pieces.append([crc32(c) for c in cuts] if digest else [c.tobytes() for c in cuts])
            yield pd.DataFrame({"doc_tokens": totals, "pieces": pieces})

    whole = docs.select(F.col(id_col), cut(text_or_empty(text_col)).alias("_doc"))
    start = (F.col("_at") * window).cast("long")
    return whole.select(id_col, "_doc.doc_tokens", F.posexplode("_doc.pieces").alias("_at", "_piece")).select(
        id_col,
        start.alias("start"),
        F.least(F.lit(window).cast("long"), F.col("doc_tokens") - start).alias("length"),
        "doc_tokens",
        F.col("_piece").alias("ids_crc32" if digest else "ids"),
    )


class Capacities:
    """Segment tree over remaining capacities: which of them have open sequences, and the least that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def least(self, capacity: int) -> int | None:
        """The smallest open capacity of at least ``capacity``."""
        i = capacity + self.size
        if self.open[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank + 1, first sequence, offset) of best-fit decreasing.

    Pieces of one length are alike and so are sequences with one remaining capacity; whole runs of
    them move at a time. Piece ``first + i`` of a run lies in sequence ``first sequence + i``.
    """
    tree, ranges = Capacities(window), {}
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.least(length)
            fresh = capacity is None
            if fresh:
                first, size, capacity = opened, 0, window
            else:
                first, size = ranges[capacity].pop()
                if not ranges[capacity]:
                    tree.set(capacity, False)
            # A sequence with the room takes further pieces of this length before the next one is touched.
            if capacity >= 2 * length and left > 1:
                per, used = capacity // length, window - capacity
                if fresh:
                    size = -(-left // per)
                    opened = first + size
                    many = left
                else:
                    many = min(left, size * per)
                full, rest = divmod(many, per)
                touched = full + (rest > 0)
                if size > touched:
                    ranges.setdefault(capacity, []).append((first + touched, size - touched))
                    tree.set(capacity, True)
                at = rank
                for k in range(per):
                    n = full + (k < rest)
                    if n:
                        runs.append((length, at, at + n, first, used + k * length))
                        at += n
                if full and capacity - per * length:
                    ranges.setdefault(capacity - per * length, []).append((first, full))
                    tree.set(capacity - per * length, True)
                if rest:
                    ranges.setdefault(capacity - rest * length, []).append((first + full, 1))
                    tree.set(capacity - rest * length, True)
            else:
                if fresh:
                    many = left
                    opened += many
                else:
                    many = min(size, left)
                    if size > many:
                        ranges[capacity].append((first + many, size - many))
                        tree.set(capacity, True)
                runs.append((length, rank, rank + many, first, window - capacity))
                if capacity > length:
                    ranges.setdefault(capacity - length, []).append((first, many))
                    tree.set(capacity - length, True)
            rank += many
            left -= many
    return runs


def place(pieces: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``pieces`` with sequence_id and offset; the columns they bring are carried along.

    ``pieces`` must be stored rows (:func:`stored`), as they are read three times. Only counts per length
    reach the driver. Ranks come from windows over (length, salt), so that a length that a third of
    all pieces share is spread; pieces that agree in id, start and length share a salt and are ranked by
    chance among themselves, as they are interchangeable. Columns named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    # At most a row per possible length reaches the driver, and goes back to the tasks.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = spark.createDataFrame([(length, -(-n // PER_SALT)) for length, n in counts.items()], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), "start", "doc_tokens"), F.col("_salts"))).drop("_salts")
    counted = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    per_length = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "_salt", "n", F.coalesce(F.sum("n").over(per_length), F.lit(0)).alias("_base"))
    base = stored(base, "pack-bases")
    by_length: dict[int, list] = {}
    for length, first, last, sequence, offset in best_fit(counts, window):
        by_length.setdefault(length, []).append((first, last, sequence, offset))
    plan = spark.createDataFrame(
        [(length, json.dumps(runs)) for length, runs in by_length.items()], "length long, runs string"
    ).select("length", F.from_json("runs", "array<array<long>>").alias("_runs"))
    within = Window.partitionBy("length", "_salt").orderBy(F.col(id_col), "start", "doc_tokens")
    # Pieces are partitioned by (length, salt) already, so joining the bases does not move them again.
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(base.drop("n"), ["length", "_salt"])
    # The plan has a row per length, whatever the corpus, and its runs follow from the lengths alone.
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).join(F.broadcast(plan), "length")
    hit = F.filter("_runs", lambda r: (r[0] <= F.col("_rank")) & (F.col("_rank") < r[1]))[0]
    return (
        ranked.withColumn("_hit", hit)
        .withColumn("sequence_id", F.col("_hit")[2] + F.col("_rank") - F.col("_hit")[0])
        .withColumn("offset", F.col("_hit")[3])
        .drop("_salt", "_rank", "_base", "_runs", "_hit")
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end: int = END,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece with its ids, sequence_id and offset. See :func:`tokenise` and :func:`place`.

    An empty table gives no rows. Repeated documents are packed as often as they occur.
    """
    return place(stored(tokenise(docs, id_col, text_col, window, end, tokenizer), "pack-pieces"), id_col, window)


def sequences(packed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """Packed pieces as training rows: sequence_id, length, ids (binary).

    Shorter sequences are padded with ``pad`` to ``window``, except where their length is a power of two.
    """
    rows = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"),
    )
    body = F.aggregate("_parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    power = F.pow(F.lit(2), F.round(F.log2(F.col("length")))) == F.col("length")
    missing = F.when(power, 0).otherwise(F.lit(window) - F.col("length")).cast("int")
    filler = F.unhex(F.repeat(F.lit(np.uint32(pad).tobytes().hex()), missing))
    return rows.select("sequence_id", "length", F.concat(body, filler).alias("ids"))
