"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks of words, then a seeded choice of blocks.

1. Each source's target: a share of the whole by weight, at most `epochs` times its own size, the excess shared again (closed form:
   sources ordered by cap per weight fill up in that order, so one running sum finds those that stop at their cap).
2. The mix has round(total target / block) blocks. Blocks go to sources, then to groups of shards, then to shards, each time to the
   highest quotients weight / (2 k + 1). A shard holds about DOCS_PER_SHARD documents of one source, by the hash of the row, so a
   large source is many shards, equal rows and rows without an id too; a group holds SHARDS_PER_GROUP shards, so no window holds more than a bounded number of rows.
   Only quotients near the seat boundary are ranked: a divisor argument bounds how far a quota can lie from its exact share.
3. Within a shard, documents in seeded hash order form a stream of words that is cut into blocks. A quota of q blocks of n takes
   the whole stream q div n times, and q mod n further blocks from a seeded start, around the end. What a document gives is the
   overlap of its interval with them, at most `epochs` times its size.

Built-in functions only. The text is read once; (id, source, size) rows are written to the shared folder and reread.

Defined results: null text has size 0; a null source is a source of its own, last; null ids and repeated rows are documents
like others (equal rows are interchangeable); an empty table or one without words takes nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, words_of, written

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS = 1.5, 2
DOCS_PER_SHARD, SHARDS_PER_GROUP = 512, 1000
#: Blocks are as large as this many words, or smaller where a source is small (BLOCKS_LEAST for the smallest source).
BLOCK_WORDS, BLOCKS_LEAST = 1024, 256
#: Rows up to which per-source and per-shard tables are broadcast.
BROADCAST_ROWS = 50_000
SEED = 17


def apportion(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """children with `quota`: the parent's `seats` dealt among its children by Sainte-Laguë, none above `limit`.

    The bounds (a row for each child) are written out, as both what is dealt and what is returned read them: else the plan doubles with each level.
    children: parent columns, key, weight (double), limit (long), seats (long, the same within a parent). Keys are not null; ties go to the lower key.
    """
    over = Window.partitionBy(*parent)
    # Exact shares: children whose limit is low for their weight fill up first, the others share the rest by weight.
    by_fill = over.orderBy(F.when(F.col("weight") > 0, F.col("limit") / F.col("weight")), F.col(key))
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    some_weight = F.col("weight") > 0
    counts = F.when(some_weight, F.col("limit")).otherwise(F.lit(0))
    level = (F.col("seats") - F.coalesce(F.sum(counts).over(before), F.lit(0))) / F.sum("weight").over(after)
    full = some_weight & (F.col("limit") <= F.col("_level") * F.col("weight"))
    rest = F.col("seats") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("limit"))).over(over), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(over)
    exact = F.when(F.col("_full"), F.col("limit").cast("double")).otherwise(F.when(some_weight & (F.col("_open") > 0), F.col("_left") * F.col("weight") / F.col("_open")).otherwise(F.lit(0.0)))
    slack = F.when(F.col("_left") > 0, F.col("_t") * F.col("_n") / (2 * F.col("_left"))).otherwise(F.lit(0.0)) + 2
    bounds = (
        children.withColumn("_level", level)
        .withColumn("_full", F.coalesce(full, F.lit(False)))
        .withColumns({"_left": rest, "_open": open_weight, "_n": F.count("*").over(over)})
        .withColumn("_t", exact)
        .withColumns({"_low": F.least(F.greatest(F.floor(F.col("_t") - slack), F.lit(0)).cast("long"), "limit"), "_high": F.least(F.ceil(F.col("_t") + slack).cast("long"), "limit")})
        .withColumn("_rest", F.col("seats") - F.sum("_low").over(over))
    )
    bounds = written(bounds.select(*children.columns, "_low", "_high", "_rest"))
    some = bounds.where((F.col("_high") > F.col("_low")) & (F.col("weight") > 0))
    order = Window.partitionBy(*parent).orderBy(F.col("_q").desc(), F.col(key))
    won = (
        some.withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
        .withColumn("_q", F.col("weight") / (2 * F.col("_k") + 1))
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= F.col("_rest"))
        .groupBy(*parent, key)
        .agg(F.count("*").alias("_won"))
    )
    out = bounds.join(won, [*parent, key], "left")
    return out.select(*children.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def targets(sources: DataFrame, share: float, epochs: int, weights: tuple) -> DataFrame:
    """sources (source, words, docs) with rank (0-based by code point, null last), weight, target and total (of all targets)."""
    every = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    ranked = ranked.withColumns({"_cap": (epochs * F.col("words")).cast("double"), "total": share * F.sum("words").over(every)})
    by_fill = every.orderBy(F.col("_cap") / F.col("weight"), "rank")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    full = ranked.withColumn("_full", F.col("_cap") <= level * F.col("weight"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every)
    return full.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(rest * F.col("weight") / open_weight)).drop("_cap", "_full")


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0))


def mix_sources(docs: DataFrame, *, share: float = SHARE, epochs: int = EPOCHS, weights: tuple = WEIGHTS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target (its source's) and taken (words the mix takes of it)."""
    sized = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("_text"))
    # Equal rows are told apart by a number, so that each is dealt by itself, however many there are.
    sized = written(sized.groupBy("doc_id", "source", "size", "_text").agg(F.count("*").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n"))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), share, epochs, weights)
    smallest = F.min(F.when(F.col("words") > 0, F.col("words"))).over(Window.partitionBy(F.lit(0)))
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.coalesce(smallest, F.lit(1)) / BLOCKS_LEAST))).cast("long"))
    sources = written(sources.withColumn("shards", F.ceil(F.col("docs") / DOCS_PER_SHARD)))

    near = small(sources.select(F.col("source").alias("_source"), "rank", "shards", "block", "target", F.col("words").alias("source_size")), BROADCAST_ROWS)
    placed = sized.join(near, sized["source"].eqNullSafe(near["_source"]), "left").drop("_source")
    row = (F.col("doc_id"), F.col("size"), F.col("_text"), F.col("_copy"))
    placed = placed.withColumns({"_mark": F.xxhash64(F.lit(seed), *row), "shard": F.pmod(F.xxhash64(F.lit(seed + 1), *row), F.col("shards"))})

    shards = placed.groupBy("rank", "shard", "block").agg(F.sum("size").alias("words"))
    shards = shards.withColumns({"group": F.floor(F.col("shard") / SHARDS_PER_GROUP), "blocks": F.ceil(F.col("words") / F.col("block"))})
    shards = written(shards)
    groups = shards.groupBy("rank", "group").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"))
    limits = groups.groupBy("rank").agg((epochs * F.sum("blocks")).alias("limit"))
    by_source = sources.join(limits, "rank").select(F.lit(0).alias("root"), "rank", F.col("target").alias("weight"), "limit", F.round(F.col("total") / F.col("block")).cast("long").alias("seats"))
    by_source = apportion(by_source, ["root"], "rank").select("rank", F.col("quota").alias("seats"))
    by_group = apportion(groups.join(by_source, "rank").select("rank", "group", F.col("words").cast("double").alias("weight"), (epochs * F.col("blocks")).alias("limit"), "seats"), ["rank"], "group")
    by_group = by_group.select("rank", "group", F.col("quota").alias("seats"))
    by_shard = shards.join(by_group, ["rank", "group"]).select("rank", "group", "shard", "blocks", F.col("words").cast("double").alias("weight"), (epochs * F.col("blocks")).alias("limit"), "seats")
    quotas = apportion(by_shard, ["rank", "group"], "shard").where("blocks > 0").select(
        "rank", "shard", F.floor(F.col("quota") / F.col("blocks")).alias("_whole"), (F.col("quota") % F.col("blocks")).alias("_more"), "blocks", F.pmod(F.xxhash64(F.lit(seed), "rank", "shard"), F.col("blocks")).alias("_from")
    )

    in_shard = Window.partitionBy("rank", "shard").orderBy("_mark", "doc_id", "size", "_text", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("_a", F.coalesce(F.sum("size").over(in_shard), F.lit(0))).join(quotas, ["rank", "shard"], "left")
    a, b, block = F.col("_a"), F.col("_a") + F.col("size"), F.col("block")
    first, last, ring = F.col("_from") * block, (F.col("_from") + F.col("_more")) * block, F.col("blocks") * block
    taken = F.col("_whole") * F.col("size") + overlap(a, b, first, last) + overlap(a, b, first - ring, last - ring)
    return laid.select("doc_id", "source", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))
