"""Queries of the training-data operators, each applied to its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, hamming, html, langid, packing, quality, secrets, setsketch, token_files, toxicity
from .common import held_out, table
from .sql import ORACLES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _learnable(spark: SparkSession, sf_dir: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Documents and labels (doc_id, label) that may be learned from."""
    docs = table(spark, sf_dir, "documents").filter(~held_out()).select("doc_id", "text")
    return docs, table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col(label).alias("label"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_windows(turns.unionByName(extra)))


def op3_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.train(*_learnable(spark, sf_dir, "toxic"))
    out = toxicity.predict(table(spark, sf_dir, "documents"), model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op8_itq_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.train(*_learnable(spark, sf_dir, "quality"))
    out = quality.predict(table(spark, sf_dir, "documents"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "lines", "bad_lines")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), VOCABULARY))


def op11_tag_path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OPERATORS = (op1_language_id, op2_chat_windows, op3_setsketch_dedup, op4_toxic_spans, op5_spaced_seed_decontamination, op6_hilbert_packing, op7_secret_ownership, op8_itq_vectors, op9_line_quality, op10_token_files, op11_tag_path_extraction, op12_source_divergence)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
