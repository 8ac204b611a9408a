"""Language-model scores from a log-frequency Bloom filter.

Bigram and word counts of the training documents are quantised to logarithmic levels; an n-gram at level q is
entered q times, once with each level up to q. A count is read back by probing levels upwards until
one is missing, and smoothed probabilities follow. The filter is built in segments, one for each
range of hashes, wherever those n-grams meet, and goes to the workers as a broadcast of at most ``most_mb``.
A larger filter is broadcast range by range, in as many passes over the documents as that takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import WordHashes, lower_words_of, mix, slices, small_batches, stored, text_or_empty

BASE = 1.5
BITS = 12
PROBES = 4
#: Share of a token's probability that comes from bigrams where the history has been seen; the rest is the word model's.
SHARE = 0.3
#: Largest filter broadcast at once; and words whose exact counts are broadcast, the most frequent ones.
MOST_MB = 128
HEAD = 1 << 20
#: Characters scored at a time, beside which a worker holds the filter.
SCORED = 3_000_000

END = np.uint64(xxhash.xxh64_intdigest(b""))
START = np.uint64(xxhash.xxh64_intdigest(b"", seed=1))
WORDS, PAIRS = 0, 1


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def typical_counts(levels: int = 128) -> np.ndarray:
    """Mean count of each level; level 0 stands for 0."""
    low = np.ceil(BASE ** np.arange(levels) - 1e-9)
    high = np.maximum(np.ceil(BASE ** np.arange(1, levels + 1) - 1e-9) - 1, low)
    return np.concatenate([[0.0], (low + high) / 2])


def tokens_of(texts: pd.Series, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts one after the other, their predecessors, and each text's number of tokens."""
    parts = [np.append(hashes.of(lower_words_of(text)), END) for text in texts]
    many = np.array([len(p) for p in parts], np.int64)
    tokens = np.concatenate(parts)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[many.cumsum() - many] = START
    return tokens, before, many


def pairs_of(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _places(keys: np.ndarray, level: int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    """Bit of a key at a level, for one of the probes. Keys are mixed again, as their upper half chose the segment."""
    salt = np.array([64 * level + probe + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mix(keys ^ salt) >> np.uint64(16)) % np.asarray(bits, np.uint64)


def segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Filter segment with every key at its level and all below."""
    levels = level_of(counts)
    size = max(64, -(-int(levels.sum()) * BITS // 64) * 64)
    flags = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        here = keys[levels >= level]
        for probe in range(PROBES):
            flags[_places(here, level, probe, size)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


class Filter:
    """Segments of one pass; n-grams of other segments read as level 0."""

    def __init__(self, buckets: int, lengths: dict[tuple[int, int], int], kinds: dict | None = None):
        """Room for segments of ``lengths`` bytes by (kind, bucket); :meth:`put` fills it, one at a time."""
        self.buckets, self.kinds = buckets, kinds or {}
        if kinds:
            return
        for kind in (WORDS, PAIRS):
            sizes = np.array([8 * lengths.get((kind, b), 0) for b in range(buckets)], np.int64)
            self.kinds[kind] = sizes, sizes.cumsum() - sizes, np.zeros(sizes.sum() // 8, np.uint8)

    def put(self, kind: int, bucket: int, bits: bytes) -> None:
        _, starts, data = self.kinds[kind]
        at = starts[bucket] // 8
        data[at : at + len(bits)] = np.frombuffer(bits, np.uint8)

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        sizes, starts, data = self.kinds[kind]
        bucket = _bucket(keys, self.buckets)
        out = np.zeros(len(keys), np.uint8)
        left = np.flatnonzero(sizes[bucket])
        level = 1
        while len(left) and level < 127:
            for probe in range(PROBES):
                b = bucket[left]
                at = starts[b] + _places(keys[left], level, probe, sizes[b]).astype(np.int64)
                left = left[(data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[left] = level
            level += 1
        return out


def _count(buckets: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in (part for whole in batches for part in slices(whole, "_text")):
            tokens, before, _ = tokens_of(batch["_text"], hashes)
            for kind, grams in ((WORDS, tokens), (PAIRS, pairs_of(tokens, before))):
                keys, counts = np.unique(grams, return_counts=True)
                cuts = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                yield pd.DataFrame(
                    [
                        (kind, b, keys[s:e].tobytes(), counts[s:e].astype(np.uint32).tobytes())
                        for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                        if e > s
                    ],
                    columns=["kind", "bucket", "keys", "counts"],
                )

    return count


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    kind, bucket = int(group["kind"].iloc[0]), int(group["bucket"].iloc[0])
    keys = np.frombuffer(b"".join(group["keys"]), np.uint64)
    counts = np.frombuffer(b"".join(group["counts"]), np.uint32).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    exact = (keys.tobytes(), counts.tobytes()) if kind == WORDS else (b"", b"")
    row = (kind, bucket, len(keys), int(counts.sum()), segment(keys, counts), *exact)
    return pd.DataFrame([row], columns=["kind", "bucket", "grams", "total", "bits", "keys", "counts"])


def train(docs: DataFrame, text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """The model of ``docs``, stored: per kind and range of hashes the filter's segment, and words' exact counts.

    Each task counts what it reads before anything moves, and the number of ranges follows the session's shuffle partitions.
    A null or empty text contributes the end token alone. An empty table gives an empty model.
    """
    small_batches(docs.sparkSession, 3000)
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select(text_or_empty(text_col).alias("_text")).mapInPandas(
        _count(buckets), "kind int, bucket int, keys binary, counts binary"
    )
    schema = "kind int, bucket int, grams long, total long, bits binary, keys binary, counts binary"
    merged = parts.groupBy("kind", "bucket").applyInPandas(_merge, schema)
    return stored(merged.withColumn("buckets", F.lit(buckets)), "lm-model")


def word_counts(model: DataFrame) -> DataFrame:
    """Exact counts of the training words: word (hash), n."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"], strict=True):
                yield pd.DataFrame({"word": np.frombuffer(keys, np.int64), "n": np.frombuffer(counts, np.int64)})

    return model.filter(F.col("kind") == WORDS).select("keys", "counts").mapInPandas(rows, "word long, n long")


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``most`` of the most frequent words with their counts, and the count from which words belong to them."""
    fine = F.floor(F.log2("n") * 16).cast("int")
    bins = {r["b"]: (r["words"], r["least"]) for r in counts.groupBy(fine.alias("b")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()}
    total, least = 0, 1 << 62
    for b in sorted(bins, reverse=True):
        total += bins[b][0]
        if total > most:
            break
        least = bins[b][1]
    head = counts.filter(F.col("n") >= least).toArrow()  # two flat columns; rows as objects would take far more
    words, many = (head.column(c).to_numpy() for c in ("word", "n"))
    order = np.argsort(words)
    return words[order], many[order], least


def is_held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Whether the id's checksum falls into the held-out fold; a missing id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == fold


def score(
    docs: DataFrame,
    model: DataFrame,
    text_col: str = "text",
    share: float = SHARE,
    most_mb: int = MOST_MB,
    head: int = HEAD,
) -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score; columns of these names are replaced.

    base_score is the add-half word model on exact counts; score is the bigram model read from the filter, both
    log10 of the whole text with its end token. A null or empty text is scored by its end token. Exact counts of
    the ``head`` most frequent words go to the workers; all rarer words are looked up by a join on the word, whose
    rows are pre-summed per document. With an empty model every text has the same base score per token.
    """
    spark = docs.sparkSession
    small_batches(spark, 3000)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in names and c != text_col]
    facts = model.groupBy("kind").agg(F.sum("grams").alias("grams"), F.sum("total").alias("total")).collect()
    distinct = {r["kind"]: r["grams"] for r in facts}.get(WORDS, 0)
    total = {r["kind"]: r["total"] for r in facts}.get(WORDS, 0)
    first = model.select("buckets").first()
    buckets = first[0] if first else 1
    counts = word_counts(model)
    head_words, head_counts, least = _head(counts, head)
    ends = counts.filter(F.col("word") == int(END.view(np.int64))).first()
    trained = ends["n"] if ends else 0

    lengths = {(r["kind"], r["bucket"]): r["size"] for r in model.select("kind", "bucket", F.length("bits").alias("size")).collect()}
    passes, room = [], 0
    for b in range(buckets):
        size = lengths.get((WORDS, b), 0) + lengths.get((PAIRS, b), 0)
        if not passes or room + size > most_mb * 2**20:
            passes.append([b, b])
            room = 0
        passes[-1][1] = b + 1
        room += size

    def broadcast(low: int, high: int):
        part = model.filter((F.col("bucket") >= low) & (F.col("bucket") < high)).select("kind", "bucket", "bits")
        filter_ = Filter(buckets, {k: v for k, v in lengths.items() if low <= k[1] < high})
        for row in part.toLocalIterator():
            filter_.put(*row)
        return spark.sparkContext.broadcast((buckets, {}, filter_.kinds))

    exact = spark.sparkContext.broadcast((head_words, head_counts))
    typical = typical_counts()
    denominator = total + 0.5 * (distinct + 1)

    def levels_of(texts: pd.Series, hashes: WordHashes, filter_: Filter):
        tokens, before, many = tokens_of(texts, hashes)
        words, at = np.unique(tokens, return_inverse=True)
        pairs, pair_at = np.unique(pairs_of(tokens, before), return_inverse=True)
        return tokens, before, many, words, at, filter_.levels(WORDS, words)[at], filter_.levels(PAIRS, pairs)[pair_at]

    def probe(bits):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes, filter_ = WordHashes(), Filter(*bits.value)
            for batch in (part for whole in batches for part in slices(whole, "_text", SCORED)):
                _, _, many, _, _, word_levels, pair_levels = levels_of(batch["_text"], hashes, filter_)
                stops = many.cumsum()
                batch = batch.copy()
                for column, levels in (("_words", word_levels), ("_pairs", pair_levels)):
                    new = np.maximum(levels, np.frombuffer(b"".join(batch[column]), np.uint8)) if batch[column].iloc[0] is not None else levels
                    batch[column] = [new[s - m : s].tobytes() for s, m in zip(stops, many, strict=True)]
                yield batch

        return run

    def finish(bits):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes, filter_ = WordHashes(), Filter(*bits.value)
            known_words, known_counts = exact.value
            for batch in (part for whole in batches for part in slices(whole, "_text", SCORED)):
                tokens, before, many, words, at, word_levels, pair_levels = levels_of(batch["_text"], hashes, filter_)
                if batch["_words"].iloc[0] is not None:
                    word_levels = np.maximum(word_levels, np.frombuffer(b"".join(batch["_words"]), np.uint8))
                    pair_levels = np.maximum(pair_levels, np.frombuffer(b"".join(batch["_pairs"]), np.uint8))
                starts = many.cumsum() - many
                seen = typical[word_levels]
                history = np.empty_like(seen)
                history[1:] = seen[:-1]
                history[starts] = trained
                pair = np.minimum(typical[pair_levels], history)
                unigram = (seen + 0.5) / denominator
                mixed = np.where(history > 0, share * pair / np.maximum(history, 1) + (1 - share) * unigram, unigram)
                scores = np.add.reduceat(np.log10(mixed), starts)
                # Exact word counts where they are at hand; the other words go out to be joined.
                signed = words.view(np.int64)
                where = np.searchsorted(known_words, signed)
                where = np.minimum(where, max(len(known_words) - 1, 0))
                have = known_words[where] == signed if len(known_words) else np.zeros(len(words), bool)
                count = np.where(have, known_counts[where], 0) if len(known_words) else np.zeros(len(words), np.int64)
                logs = np.where(have, np.log10((count + 0.5) / denominator), 0.0)
                base = np.add.reduceat(logs[at], starts)
                known = np.add.reduceat(have[at].astype(np.int64), starts)
                rare = ~have[at]
                rare_words = tokens.view(np.int64)[rare]
                rare_many = np.add.reduceat(rare.astype(np.int64), starts)
                stops = rare_many.cumsum()
                lists = [rare_words[s - m : s] for s, m in zip(stops, rare_many, strict=True)]
                out = batch.drop(columns=["_text", "_words", "_pairs"])
                yield out.assign(_n=many, _known=known, _base=base, _score=scores, _rare=lists)

        return run

    text = [F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)]
    void = F.lit(None).cast("binary")
    rows = docs.select(*text, text_or_empty(text_col).alias("_text"), void.alias("_words"), void.alias("_pairs"))
    for low, high in passes[:-1]:
        rows = stored(rows.mapInPandas(probe(broadcast(low, high)), rows.schema), "lm-levels")
    own = rows.drop("_text", "_words", "_pairs").schema
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in own] + ["_n long, _known long, _base double, _score double, _rare array<long>"])
    done = rows.mapInPandas(finish(broadcast(*(passes[-1] if passes else (0, 1)))), schema)
    done = stored(done.withColumn("_row", F.monotonically_increasing_id()), "lm-scores")

    rare = done.select("_row", F.explode("_rare").alias("word"))
    tail = counts.filter(F.col("n") < least)
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(denominator)))
    rest = (
        rare.join(tail, "word", "left")
        .groupBy("_row")
        .agg(F.sum(log).alias("_rest"), F.count("n").alias("_rest_known"))
    )
    out = done.drop("_rare").join(rest, "_row", "left")
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)],
        F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_rest_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_rest", F.lit(0.0))).alias("base_score"),
        F.col("_score").alias("score"),
    )
