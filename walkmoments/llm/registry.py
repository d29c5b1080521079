"""Queries of the training-data operators: opN_<name> -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, html, lexical, mixing, negatives, ngram_join, pii, quality, secrets, shards, sql, urls
from .common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op1_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.digests(rows.unionByName(extra))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), 4, 85, 100)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shards.write_shards(docs, shards.shard_folder(docs), shards.default_vocabulary())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = materialize(quality.with_stats(docs).select("doc_id", "__q_stats"), "op9-stats")
    rules = quality.fit(stats, table(spark, sf_dir, "labels"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(stats, rules).select("doc_id", *[F.col("__q_stats")[c].alias(c) for c in shown], "base_failed", "rule", "kept")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op12_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, changed)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_curve_neighbours": op1_curve_neighbours,
        "op2_chat_windows": op2_chat_windows,
        "op3_main_text": op3_main_text,
        "op4_secret_scan": op4_secret_scan,
        "op5_url_verdicts": op5_url_verdicts,
        "op6_mix_to_targets": op6_mix_to_targets,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_token_shards": op8_token_shards,
        "op9_quality_rules": op9_quality_rules,
        "op10_bpe_round_trip": op10_bpe_round_trip,
        "op11_personal_data": op11_personal_data,
        "op12_wand_search": op12_wand_search,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    """The others learn, sample by hash, join all pairs or run a tokenizer: tests hold them against brute force."""
    return sql.oracle_sql()
