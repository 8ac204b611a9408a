"""Quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Two multinomials over hashed byte n-grams are counted: one over documents labelled good, one over the
whole corpus. A document's score is the mean log ratio of its n-grams, so it does not depend on length;
documents below a fixed threshold, or failing the plain base rules, are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import WordHashes, small_batches, text_or_empty, window_hashes, words_of

BUCKETS = 1 << 16
N = 3
#: Mean log ratio per n-gram, in nats, below which a document is unlike the target. Fixed, not fitted.
THRESHOLD = -0.5
#: Most labelled documents the target is fitted on; chosen by a hash of the id.
MOST_TRUSTED = 20_000
#: Weight, in n-grams, of the prior belief that a document is like the corpus; it steadies short texts.
PRIOR = 16

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def buckets_of(text: str, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every byte n-gram of a text; a text shorter than ``n`` bytes has none."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    count = len(data) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    gram = np.zeros(count, np.uint64)
    for i in range(n):
        gram = (gram << np.uint64(8)) | data[i : i + count]
    gram *= np.uint64(0x9E3779B97F4A7C15)
    return ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int = MOST_TRUSTED) -> DataFrame:
    """At most ``most`` ids labelled good and not toxic, the same ones every time."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col(id_col).isNotNull())
    return good.select(F.col(id_col)).distinct().orderBy(F.xxhash64(id_col), id_col).limit(most)


def model(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, n: int = N
) -> np.ndarray:
    """Log ratio per bucket, add-one smoothed. ``trusted`` holds at most :data:`MOST_TRUSTED` ids.

    Every document counts towards the corpus, each task sending a row per bucket at most; ``buckets``
    sums reach the driver. Without trusted documents all ratios are 0 and no document is below a threshold.
    """
    small_batches(docs.sparkSession)
    good = trusted.select(F.col(id_col).alias("_good")).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, is_good in zip(batch["_text"], batch["_is_good"], strict=True):
                got = buckets_of(text, n, buckets)
                if len(got) < buckets // 8:
                    np.add.at(raw, got, 1)
                    if is_good:
                        np.add.at(target, got, 1)
                else:
                    dense = np.bincount(got, minlength=buckets)
                    raw += dense
                    if is_good:
                        target += dense
        used = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": used, "raw": raw[used], "target": target[used]})

    marked = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(
        F.broadcast(good), F.col("_id") == F.col("_good"), "left"
    )
    parts = marked.select("_text", F.col("_good").isNotNull().alias("_is_good")).mapInPandas(
        count, "bucket long, raw long, target long"
    )
    sums = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def base_rules(text: str, hashes: WordHashes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a text."""
    words = words_of(text)
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(_SPACE):
            seen.add(line)
    repeat_words = 0
    windows = window_hashes(hashes.of(words), 5)
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            again = np.zeros(len(windows), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            edge = np.zeros(n_words + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeat_words = int((np.cumsum(edge)[:n_words] > 0).sum())
    failed = n_words < 10 or 100 * repeat_words > 20 * n_words
    return n_words, word_chars, symbols, dup_lines, repeat_words, failed


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def assess(
    docs: DataFrame, ratios: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD, n: int = N, prior: float = PRIOR
) -> DataFrame:
    """``docs`` with the base counts, score and verdict; columns named like these are replaced.

    Every row is judged on its own whole text, so repeated rows get equal results. A null or empty text has no
    words and fails the base rules; its score is 0. ``ratios`` has a fixed size and goes to the workers with the code.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        names = [f.split()[0] for f in RESULT.split(", ")]
        for texts in batches:
            rows = []
            for text in texts:
                base = base_rules(text, hashes)
                got = buckets_of(text, n, len(ratios))
                score = float(ratios[got].sum() / (len(got) + prior))
                rows.append((*base, score, not base[-1] and score >= threshold))
            yield pd.DataFrame(rows, columns=names)

    names = [f.split()[0] for f in RESULT.split(", ")]
    kept: list[Column] = [F.col(c) for c in docs.columns if c not in names]
    judge = judge.asNondeterministic()  # it is not, but a filter on the verdict would have it run twice
    return docs.select(*kept, judge(text_or_empty(text_col)).alias("_q")).select(*kept, "_q.*")
