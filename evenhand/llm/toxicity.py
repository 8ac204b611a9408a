"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their first letters, hashed to buckets. A factorization machine scores them: a weight per
term, and for each pair of terms the product of their factors, so that an insult may weigh more beside a group's name than
both weigh alone. Terms that labelled documents show to be independent of the label (likelihood ratio) are left out before the
fit, so long texts do not gather noise from thousands of words. Labels, language, source and ids are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import small_batches, stored, text_or_empty
from evenhand.llm.lm import is_held_out

BUCKETS = 1 << 24
#: Lengths of the beginnings of words that are terms besides the words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Most labelled documents that the classifier is fitted on, chosen by a hash of the id.
MOST_LABELLED = 50_000
#: Least likelihood ratio (twice the gain in nats) between a term and the label, least documents with a term, most terms.
LEAST_RATIO, LEAST_DOCUMENTS, MOST_TERMS = 25.0, 3, 1 << 15
FACTORS, ROUNDS, RATE, PENALTY = 8, 60, 0.1, 1e-4

_WORD = re.compile(r"[^\W\d_]+")


def _bucket(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "replace")) % BUCKETS


class Beginnings(dict):
    """Buckets of the beginnings of words, by as many letters as decide them; remembered up to a bound."""

    def __init__(self, numbers: dict[int, int] | None, most: int):
        super().__init__()
        self.numbers, self.most = numbers, most

    def __missing__(self, letters: str) -> tuple[int, ...]:
        found = [_bucket("^" + letters[:n]) for n in BEGINNINGS if len(letters) > n]
        out = tuple(found) if self.numbers is None else tuple(self.numbers[b] for b in found if b in self.numbers)
        if len(self) < self.most:
            self[letters] = out
        return out


class Terms(dict):
    """Buckets of each word's terms, remembered up to a bound; with ``numbers``, only those that have one, as that number."""

    def __init__(self, numbers: dict[int, int] | None = None, most: int = 300_000):
        super().__init__()
        self.numbers, self.most = numbers, most
        self.beginnings = Beginnings(numbers, most)

    def __missing__(self, word: str) -> tuple[int, ...]:
        own = _bucket("=" + word)
        if self.numbers is not None:
            own = self.numbers.get(own)
        begun = self.beginnings[word[: BEGINNINGS[-1] + 1]]
        out = begun if own is None else (own, *begun)
        if len(self) < self.most:
            self[word] = out
        return out

    def of(self, text: str) -> set[int]:
        return set().union(*map(self.__getitem__, set(_WORD.findall(text.lower()))))


@dataclass
class Machine:
    """A fitted machine: bucket of each term, its weight and factors, and the constant."""

    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    constant: float

    def value(self, terms: list[int]) -> float:
        """Log odds of a set of terms, given by their numbers."""
        if not terms:
            return self.constant
        rows = self.factors[terms]
        pairs = ((rows.sum(0) ** 2).sum() - (rows**2).sum()) / 2
        return float(self.constant + self.weights[terms].sum() + pairs)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> DataFrame:
    """Texts and labels (text, label) of at most ``most`` labelled ids outside the held-out fold, stored.

    Ids are chosen by hash, the same ones every time. An id with several labels has the highest, null ids and labels are left out.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(id_col, fold=0))
    given = usable.groupBy(F.col(id_col).alias("_labelled")).agg(F.max((F.col(label_col) > 0).cast("double")).alias("label"))
    given = given.withColumn("_place", F.xxhash64(F.lit("toxicity"), "_labelled"))
    count = given.count()
    if count > most:  # spares the sort below most of the rows, and leaves more than enough
        share = min(1.0, 1.1 * most / count + 0.001)
        given = given.filter(F.col("_place") < int((share - 0.5) * 2**64))
    chosen = given.orderBy("_place", "_labelled").limit(most).drop("_place")
    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return stored(texts.join(F.broadcast(chosen), F.col(id_col) == F.col("_labelled")).select("text", "label"), "toxicity-labelled")


def _bucketed(rows: DataFrame) -> DataFrame:
    """Labelled texts as the buckets of their terms (label, buckets), stored: texts are read once for the choice of terms and the fit."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for batch in batches:
            found = [np.fromiter(terms.of(t), np.int32) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "buckets": found})

    return stored(rows.mapInPandas(read, "label double, buckets array<int>"), "toxicity-buckets")


def select_terms(rows: DataFrame, least: float = LEAST_RATIO, most: int = MOST_TERMS) -> list[int]:
    """Buckets of the terms that tell toxic from other labelled texts (text, label), best first; at most ``most`` reach the driver."""
    return _select(_bucketed(rows), least, most)


def _select(rows: DataFrame, least: float = LEAST_RATIO, most: int = MOST_TERMS) -> list[int]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            lengths = batch["buckets"].str.len().to_numpy()
            buckets, at = np.unique(np.concatenate(batch["buckets"].to_list()), return_inverse=True)
            labels = np.repeat(batch["label"].to_numpy(), lengths)
            toxic = np.bincount(at, labels, len(buckets)).astype(np.int64)
            yield pd.DataFrame({"bucket": buckets, "n": np.bincount(at, minlength=len(buckets)), "toxic": toxic})

    counts = rows.mapInPandas(count, "bucket int, n long, toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < toxic < total:
        return []

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    n, t = F.col("n").cast("double"), F.col("toxic").cast("double")
    ratio = sum(
        (
            part(t, n * (toxic / total)),
            part(n - t, n * (1 - toxic / total)),
            part(F.lit(toxic) - t, (F.lit(float(total)) - n) * (toxic / total)),
            part(F.lit(total - toxic) - (n - t), (F.lit(float(total)) - n) * (1 - toxic / total)),
        ),
        F.lit(0.0),
    )
    told = counts.filter(F.col("n") >= LEAST_DOCUMENTS).select("bucket", ratio.alias("ratio")).filter(F.col("ratio") >= least)
    return [r["bucket"] for r in told.orderBy(F.desc("ratio"), "bucket").limit(most).collect()]


def fit(rows: DataFrame, seed: int = 7) -> Machine:
    """The machine of labelled texts (text, label), fitted by Spark over their selected terms.

    Without documents of both labels, or without a term that tells them apart, every text scores the share of
    toxic ones (counted with one more of each).
    """
    small_batches(rows.sparkSession)
    read = _bucketed(rows)
    buckets = _select(read)
    total, toxic = read.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not buckets:
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), float(np.log((toxic + 1) / (total - toxic + 1))))
    order = np.argsort(buckets)
    in_order = np.array(buckets)[order]

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = []
            for found in batch["buckets"]:
                at = np.minimum(np.searchsorted(in_order, found), len(in_order) - 1)
                numbers.append([str(i) for i in np.sort(order[at[in_order[at] == found]])])
            yield pd.DataFrame({"label": batch["label"], "terms": numbers})

    found = stored(read.mapInPandas(terms_of, "label double, terms array<string>"), "toxicity-terms")
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(buckets))], "terms", "features").setBinary(True)
    machine = FMClassifier(
        factorSize=FACTORS, maxIter=ROUNDS, stepSize=RATE, regParam=PENALTY, initStd=0.05, solver="adamW", seed=seed
    ).fit(vectors.transform(found))
    return Machine(np.array(buckets), machine.linear.toArray(), machine.factors.toArray(), float(machine.intercept))


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5 on) and n_terms (selected terms in the text); columns of these names are replaced.

    Every row is scored on its own, over its whole text; a null or empty one has no terms and the score of that.
    """
    small_batches(docs.sparkSession)
    names = ["score", "predicted", "n_terms"]
    parts = docs.sparkSession.sparkContext.broadcast((machine.buckets, machine.weights, machine.factors, machine.constant))

    @F.pandas_udf("score double, predicted int, n_terms long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = Machine(*parts.value)
        terms = Terms({int(b): i for i, b in enumerate(fitted.buckets)})
        for texts in batches:
            found = [sorted(terms.of(t)) for t in texts]
            odds = np.array([fitted.value(f) for f in found], np.float64)
            scores = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            yield pd.DataFrame({"score": scores, "predicted": (scores >= 0.5).astype(np.int32), "n_terms": [len(f) for f in found]})

    kept = [F.col(c) for c in docs.columns if c not in names]
    return docs.select(*kept, judge(text_or_empty(text_col)).alias("_toxicity")).select(*kept, "_toxicity.*")
