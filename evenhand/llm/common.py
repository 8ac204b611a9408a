"""Helpers shared by the operators: stored intermediate tables, word hashing, numeric hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.session import work_dir

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read again.

    Cuts the lineage: what follows rereads these files when an executor is lost, and every use of
    the result sees the same rows and the same partitioning of work.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands texts to Python workers in batches of at most ``rows``; Spark's own bound on bytes holds as well."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def slices(batch: pd.DataFrame, column: str, most: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Consecutive rows of a batch whose texts have at most ``most`` characters together, or a single longer one."""
    group = (batch[column].str.len().cumsum() // most).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
    for start, stop in zip(starts, [*starts[1:], len(batch)], strict=True):
        yield batch.iloc[start:stop]


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes; ``bytes.split`` separates at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased, other letters kept."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound so that a worker's memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each window of ``n`` consecutive words, in text order."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for i in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + count]
    return mix(out)
