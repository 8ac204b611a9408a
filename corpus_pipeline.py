"""From raw documents to packed training sequences, in stages that are each stored before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm import jaccard, mixing, packing, pii, quality
from evenhand.llm.common import documents, stored


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with columns beyond id, text and source under names that no operator uses, and how to get each column back."""
    names = {c: c if c in ("doc_id", "text", "source") else f"_given{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), {c: F.col(name).alias(c) for c, name in names.items()}


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like the trusted ones (log-likelihood ratio)."""
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    seen, given = set_aside(docs)
    judged = quality.assess(seen, quality.model(docs.select("doc_id", "text"), trusted))
    return judged.filter("kept").select(*given.values())


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more."""
    seen, given = set_aside(docs)
    return jaccard.keep_one(seen, n=5, num=80, den=100).select(*given.values())


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers, plain or disguised, replaced by their kind; n_chars follows the text."""
    seen, given = set_aside(docs)
    found = pii.find(seen, redact=True)
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("redacted").cast(dict(docs.dtypes)["n_chars"])
    return found.select(*[changed[c].alias(c) if c in changed else column for c, column in given.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them (Pareto order sampling)."""
    seen, given = set_aside(docs)
    mixed = mixing.mix(seen).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*given.values())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences (best-fit decreasing)."""
    return packing.place(stored(packing.tokenise(docs, digest=True), "pack-digests"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("PII", hide_personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Shingle hashes and token ids cannot be had in SQL; tests compare each stage and the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
