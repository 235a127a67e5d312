"""Registered queries of the training-data operators, on the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscope.llm import chat, common, divergence, exact_dedup, language, maxent_lm, merkle, mixing, near_dedup, phrase_index, sharding, token_files, toxicity, warc

SHARDS = 24


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file: in the folder ``TOKENIZER_DIR`` if that variable is
    set, else where the installed package of public tokenizers keeps it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = common.fold_is(F.col("doc_id"), 3, 1)
    training = docs.filter(~held_out)
    chars = toxicity.train_char_model(training)
    model = toxicity.train_toxicity(training, table(spark, sf_dir, "labels"), chars)
    scored = toxicity.score_toxicity(docs, model, ["doc_id", held_out.alias("held_out")])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_phrase_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.with_row_key(table(spark, sf_dir, "documents").select("doc_id", "source"), "_row")
    return mixing.mix_sources(docs, order=["_row"])


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(table(spark, sf_dir, "documents"), common.fold_is(F.col("doc_id"), 7, 2))


def op5_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_conversations(rows.withColumn("parts", chat.text_parts(F.col("text"))))
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss"))
    read = made.withColumn("read", turns).withColumn("masked", loss)
    said_all = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS, seed=2024)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = common.fold_is(F.col("doc_id"), 4, 2)
    profiles = language.train_profiles(docs.filter(~held_out))
    return language.identify(docs, profiles, ["doc_id", held_out.alias("held_out")])


def op9_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.run_path(spark, "tokens")
    tokens = token_files.write_tokens(
        table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_files.token_digest(tokens)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.run_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    cut = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.audit(table(spark, sf_dir, "documents"), cut)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
    "op2_phrase_decontamination": op2_phrase_decontamination,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_maxent_lm": op4_maxent_lm,
    "op5_chat_parts": op5_chat_parts,
    "op6_feistel_shards": op6_feistel_shards,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_hyperdimensional_language": op8_hyperdimensional_language,
    "op9_content_sort_dedup": op9_content_sort_dedup,
    "op10_token_parquet": op10_token_parquet,
    "op11_source_divergence": op11_source_divergence,
    "op12_warc": op12_warc,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op2_phrase_decontamination": phrase_index.ORACLE_SQL,
    "op7_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op5_chat_parts": chat.ORACLE_SQL,
    "op9_content_sort_dedup": exact_dedup.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op12_warc": warc.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
