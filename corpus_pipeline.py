"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import relieve_driver, shared_dir, small, table, words_of
from strandlake.llm.decontaminate import NEW, find_contamination
from strandlake.llm.mixing import mix_sources
from strandlake.llm.near_duplicates import near_duplicates
from strandlake.llm.quality_classifier import GOOD, score_quality
from strandlake.llm.queries import learnt_from, vocabulary
from strandlake.llm.token_store import read_store, write_store

#: Rows up to which ids that a stage drops are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000

ORACLE_SQL = None


def renamed(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that would clash under other names, and the way back."""
    own = {c: f"_own_{c}" for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(own), {v: k for k, v in own.items()}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (empty ones by the score of an empty text)."""
    relieve_driver(spark)
    safe, back = renamed(docs, ("_quality",))
    scored = score_quality(safe, learnt_from(spark, sf_dir, "quality", 4, 2), carry=safe.columns, name="_quality")
    return scored.where(F.col("_quality") >= GOOD).drop("_quality").withColumnsRenamed(back)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id; rows with one id are one document, of which the row of the
    least hash stays; rows without an id stay."""
    relieve_driver(spark)
    classes = near_duplicates(docs.select("doc_id", "text"))
    dropped = classes.where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(small(dropped, BROADCAST_IDS), "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        repeated = small(repeated, BROADCAST_IDS)
        mark = F.struct(F.xxhash64(*docs.columns), F.xxhash64("text"))
        once = kept.join(repeated, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*docs.columns), mark).alias("_row"))
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("_row.*"))
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    relieve_driver(spark)
    safe, back = renamed(docs, NEW)
    found = find_contamination(safe, table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*safe.columns).withColumnsRenamed(back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, to the nearest whole number (equal rows share what they are given)."""
    relieve_driver(spark)
    safe, back = renamed(docs, ("_size", "_doc", "_source", "_words", "_times", "_copy"))
    taken = mix_sources(docs.select("doc_id", "source", "text"))
    times = taken.where("size > 0").groupBy("doc_id", "source", "size").agg(F.round(F.sum("taken") / F.count("*") / F.col("size")).cast("int").alias("_times"))
    times = times.where("_times > 0").select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_words"), "_times")
    sized = safe.withColumn("_size", F.size(words_of(F.col("text"))).cast("long"))
    same = sized["doc_id"].eqNullSafe(times["_doc"]) & sized["source"].eqNullSafe(times["_source"]) & (sized["_size"] == times["_words"])
    out = sized.join(times.hint("shuffle_hash"), same)
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*safe.columns).withColumnsRenamed(back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and reads it back: doc_id, start, n_tokens, ids_crc32, intact."""
    relieve_driver(spark)
    path = shared_dir(spark)
    write_store(docs.select("doc_id", "text"), vocabulary(), path)
    return read_store(spark, path)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("mix", mix), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), shared_dir(spark)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
