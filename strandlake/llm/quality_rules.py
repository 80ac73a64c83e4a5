"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over hash buckets are estimated from n-gram counts: of the trusted documents, and of all documents.
A document's verdict is the mean over its n-grams of log(p_target / p_raw), compared with a fixed threshold. n-grams:
single words, and pairs of neighbouring word endings (two characters each, with whether the two words are equal),
so that a manner of writing which trusted text lacks shows even where each single word is new.

Built-in functions only. Counts are partial sums on the map side, `buckets` rows at most per task; the weights reach the
tasks as one array of `buckets` floats. Every trusted row counts. Texts are not collected, and shuffled (once, by doc_id) only
where there are more than BROADCAST_IDS trusted ids.

Defined results: null or blank text has no words, all counts 0, base_failed; ids may be null or repeat, each row is judged
by itself; without any trusted document every ratio is 0, so only the base rules decide; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, small, words_of

BUCKETS = 1 << 16
#: Trusted ids up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Added to each bucket's count.
SMOOTHING = 0.5
#: Least mean log ratio of a kept document.
THRESHOLD = -0.25
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


def shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values), F.lit(1)))


def window_hashes(hashes: Column) -> Column:
    """Hash of each window of WINDOW = 8 neighbours, by doubling."""

    def doubled(h: Column, by: int) -> Column:
        return F.zip_with(h, shifted(h, by), lambda a, b: F.xxhash64(a, b))

    full = let(hashes, lambda h: let(doubled(h, 1), lambda h: let(doubled(h, 2), lambda h: doubled(h, 4))))
    return F.slice(full, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))


def repeat_words(hashes: Column) -> Column:
    """Number of words that lie in windows which occur twice or more in the text. hashes: of its words."""

    def covered(at: Column) -> Column:  # at: sorted starts of repeated windows
        return F.aggregate(F.transform(at, lambda p, j: F.coalesce(F.least(F.lit(WINDOW), F.get(at, j + 1) - p), F.lit(WINDOW)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, j: F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False)) | F.coalesce((j > 0) & (F.get(ordered, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]), F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def counted(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, j: F.struct(h.alias("h"), j.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(ordered, repeated))

    return F.when(F.size(hashes) <= WINDOW, F.lit(0).cast("long")).otherwise(let(window_hashes(hashes), counted))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(key, F.lit(buckets)).cast("int")


def pair_key(a: Column, b: Column) -> Column:
    """Of a word and the next one (null after the last)."""
    return F.xxhash64(F.substring(a, -2, 2), F.substring(b, -2, 2), a == b)


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, `w`: array of log(p_target / p_raw) by bucket. docs: doc_id, text. trusted: doc_id."""
    trusted = small(trusted.select("doc_id", F.lit(1).alias("t")).distinct(), BROADCAST_IDS)
    words = docs.select("doc_id", "text").join(trusted, "doc_id", "left").select("t", words_of(F.col("text")).alias("w"))
    pairs = words.select(F.coalesce("t", F.lit(0)).alias("t"), F.explode(F.arrays_zip(F.col("w").alias("a"), shifted(F.col("w"), 1).alias("b"))).alias("z"))
    keys = pairs.select("t", F.explode(F.array(bucket(F.xxhash64("z.a"), buckets), bucket(pair_key(F.col("z.a"), F.col("z.b")), buckets))).alias("b"))
    counts = keys.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good"))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    rows = full.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("c"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))

    def share(n: Column, total: str) -> Column:
        return (n + SMOOTHING) / (F.col(total) + SMOOTHING * buckets)

    return rows.select(F.when(F.col("good") == 0, F.array_repeat(F.lit(0.0), buckets)).otherwise(F.transform("c", lambda x: F.log(share(x["good"], "good") / share(x["raw"], "raw")))).alias("w"))


def quality_rules(docs: DataFrame, trusted: DataFrame, *, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """A row for each document: doc_id, the base counts, llr (double; null without words), base_failed and kept."""
    docs = docs.select("doc_id", "text")
    weights = bucket_weights(docs, trusted.select("doc_id").where("doc_id is not null"), buckets)
    # Folded into one literal array by the optimizer; four decimals keep it short. Its length is `buckets`, whatever the corpus.
    weight = F.split(F.lit(",".join(f"{x:.4f}" for x in weights.first()["w"])), ",").cast("array<float>")

    def added(keys: Column) -> Column:
        return F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.get(weight, bucket(k, buckets)))

    def of_words(words: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            ratio = (added(hashes) + added(F.zip_with(words, shifted(words, 1), pair_key))) / (2 * F.size(words))
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                repeat_words(hashes).alias("n_repeat_words"),
                F.when(F.size(words) > 0, ratio).alias("llr"),
            )

        return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)

    text = F.coalesce("text", F.lit(""))
    out = docs.select(
        "doc_id",
        let(words_of(text), of_words).alias("r"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
    ).select("doc_id", "r.n_words", "r.word_chars", "n_symbols", "n_dup_lines", "r.n_repeat_words", "r.llr")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
