"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import ann, bpe, fim, laesa, minhash, mixing, oracles, pii, quality, rules, suffix, tokengroups, tokens, toxicity
from airgrid.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.read_model(model or public_tokenizers.path("piece_bpe_32k.model")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.read_ranks(ranks), public_tokenizers.PATTERN)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.array_join("passes.shard", ",").alias("shards"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op11_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokengroups.classes(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_nearest": op5_nearest,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op9_quality_rules": op9_quality_rules,
    "op8_pii": op8_pii,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_token_groups": op11_token_groups,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_centroids": op13_centroids,
}
ORACLES: dict[str, str] = {"op9_quality_rules": oracles.OP9, "op10_minhash_near_dedup": oracles.OP10,
                           "op11_token_groups": oracles.OP11, "op12_fill_in_middle": oracles.OP12, "op13_centroids": oracles.OP13}
