"""Registered queries of the training-data operators: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import (
    bpe, centroids, decontaminate, licenses, lmscore, mixing, pii, quality, simhash, suffixes, tokenfiles, toxicity, whitening,
)
from driftline.llm.shared import remainder, table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[function.__name__] = function
    return function


@registered
def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@registered
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "expected_toxic", "toxic_spans",
    )


@registered
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@registered
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@registered
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_records(table(spark, sf_dir, "documents"))


@registered
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), lmscore.HELD_OUT_DIVISOR) == 1, F.lit(False))
    model, words = lmscore.fit(docs, ~held_out)
    return lmscore.score(docs, model, words).withColumn("held_out", held_out)


@registered
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@registered
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [
        F.aggregate("base", F.lit(0).cast("long"), lambda n, s: n + (s["kind"] == F.lit(kind)).cast("long")).alias(f"n_{name}")
        for kind, name in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined_spans("base"), 256).alias("base_sha256"),
        pii.joined_spans(F.array_sort(F.concat("base", "found"))).alias("spans"),
    )


@registered
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_unknown",
    )


@registered
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


@registered
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


@registered
def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@registered
def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
