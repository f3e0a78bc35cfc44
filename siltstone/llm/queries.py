"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, editprint, packing, radixdup, sanitise, secrets, sharding, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.linked_secrets(_table(spark, sf_dir, "documents"))


def op3_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op5_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations")
    return chat.parse(chat.transcripts(talks), chat.fit(talks))


def op6_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.sanitised(_table(spark, sf_dir, "documents"))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radixdup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.edit_near_duplicates(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_linked_secrets, op2_simhash_near_duplicates, op3_related_packing, op4_lpt_sharding, op5_chat_transcripts, op6_pii_sanitisation, op7_exact_duplicates, op8_edit_fingerprints, op9_byte_bpe, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op4_lpt_sharding": sharding.ORACLE, "op7_exact_duplicates": radixdup.ORACLE}
