"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, shared_dir, table
from .decontaminate import find_contamination
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .oracles import oracle_sql as oracle_sql
from .quality_classifier import GOOD, score_quality
from .quality_rules import quality_rules
from .restaurants import score_marked
from .secret_scan import Ledger
from .token_count import count_tokens
from .token_store import read_store, write_store
from .toxicity import score_toxicity


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(), carry=["doc_id"])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    n_items, digest = F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = Ledger(spark, shared_dir(spark)).scan(versions)
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_store(table(spark, sf_dir, "documents"), vocabulary(), path)
    return read_store(spark, path)


def held_out(n: int, rest: int):
    return (crc_mod(F.col("doc_id"), n) == rest).alias("held_out")


def learnt_from(spark: SparkSession, sf_dir: str, label: str, n: int, rest: int) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out(n, rest)).select("doc_id", F.col(label).alias("label"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), learnt_from(spark, sf_dir, "toxic", 5, 0))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), learnt_from(spark, sf_dir, "quality", 4, 2))
    return scored.select("doc_id", held_out(4, 2), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_marked(docs.select("doc_id", "text", F.lit(True).alias("scored"), (~held_out(7, 2)).alias("learnt")))
    return scored.select("doc_id", held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_count, op2_decontaminate, op3_secret_scan, op4_toxicity, op5_quality_rules, op6_token_store, op7_quality_classifier, op8_pitman_yor, op9_near_duplicates, op10_mixing)}
