"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm import edits, fingerprints, jaccard, lm, mixing, packing, phrases, pii, quality, revisits, sharding, toxicity, turns
from evenhand.llm.common import documents, stored, text_or_empty


def op1_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.assess(docs, quality.model(docs, trusted)).drop("text")


def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = revisits.resolve(revisits.captures(pages))
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return found.select(
        F.shiftright("record_id", 1).alias("page_id"),
        "url_key",
        F.unix_timestamp("at").alias("at_s"),
        F.shiftright("refers_to", 1).alias("refers_to_page"),
        "verdict",
        F.array_join(lines, "\n").alias("headers"),
        "payload_digest",
    )


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text_or_empty("text")) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty("text")).alias("text_crc32"),
    )
    return sharding.shard(stored(docs, "shard-keys"), shards=8, tie_cols=("text_crc32", "size")).select(
        "*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_mapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    docs = documents(spark, sf_dir).select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash"))

    def anchored(rows: DataFrame) -> DataFrame:
        return fingerprints.with_anchors(rows, F.col("text"), "_at", "_anchors").drop("_at")

    chained = fingerprints.with_next(docs, ["text", "_anchors"], prepare=anchored)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    edits = chained.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        edited.alias("_edited"),
        "_anchors",
        fingerprints.likeness(F.col("_anchors"), F.col("next__anchors")).alias("near_next"),
    )
    both = fingerprints.with_anchors(edits, F.col("_edited"), "_edited_at", "_edited_anchors")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprints.as_string(F.col("_anchors")).alias("fingerprint"),
        fingerprints.as_string(F.col("_edited_anchors")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("_anchors"), F.col("_edited_anchors")).alias("near_edited"),
        "near_next",
    )


def op6_trie_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(documents(spark, sf_dir), n=4, num=85, den=100)


def op7_pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.xxhash64("text").alias("text")  # stands for the text in draws
    sized = documents(spark, sf_dir).select("doc_id", "source", text, mixing.words().alias("size"))
    return mixing.mix(sized, size=F.col("size")).drop("source", "text")


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", lm.is_held_out())
    model = lm.train(docs.filter(~F.col("held_out")))
    return lm.score(docs, model)


def op10_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return edits.count(docs, edits.sample_edits()).drop("text")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(documents(spark, sf_dir), digest=True)
    return packing.place(stored(pieces, "pack-digests"))


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.repair(turns.damaged(conversations), present=F.col("present"))


def op13_factorised_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs.withColumn("held_out", lm.is_held_out(fold=0)), machine).drop("text")


QUERIES = {
    "op1_llr_quality": op1_llr_quality,
    "op2_revisit_resolution": op2_revisit_resolution,
    "op3_bounded_ring": op3_bounded_ring,
    "op4_mapped_pii": op4_mapped_pii,
    "op5_closed_syncmers": op5_closed_syncmers,
    "op6_trie_jaccard": op6_trie_jaccard,
    "op7_pareto_mixture": op7_pareto_mixture,
    "op8_bloom_lm": op8_bloom_lm,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_edited_counts": op10_edited_counts,
    "op11_toivonen_phrases": op11_toivonen_phrases,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_factorised_toxicity": op13_factorised_toxicity,
}
