"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. Only pairs of a blob and a rule version that the ledger
lacks are scanned, each blob once however many paths hold it; findings then join back to all paths. Of the table of
(path, blob) rows, one path for each new blob is chosen by a partial minimum. The first scan of a corpus, to which every blob is new, joins
texts to them by a shuffle on path and blob; later ones broadcast the new blobs, up to BROADCAST_BLOBS, and no text moves. A blob held by a third of
all paths is one scan; findings join back by a broadcast, or where there are too many by a join that AQE can split.

Built-in functions only: the places of a rule's matches come from the lengths of the pieces between them and of the matches.

Defined results: a null text is the empty text; a null path is a path like others; equal rows give equal result rows;
an empty table gives an empty result; extra columns are ignored. Spans take time in proportion to a text's matches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small, written


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    #: The group whose length counts, and the least length.
    group: int
    least: int
    base: bool

    @property
    def id(self) -> str:
        return f"{self.kind}:{self.version}"


#: In the order in which spans with one start are listed. Patterns with + match whole runs, and short matches are dropped afterwards,
#: so that a short match still consumes its characters; for access and hex the run can be asked for at once, to the same result.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18, True),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
    Rule("forge", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40, False),
)
SPANS = "array<struct<start:int,end:int>>"
#: Rows (of new blobs, of blobs with findings) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BLOBS = 50_000


#: Elements that are summed one by one; an array has so many blocks of as many, or more blocks.
BLOCK = 128


def sums_before(values: Column) -> Column:
    """For each element the sum of those before it. Appending copies what is there, so it goes by blocks: BLOCK copies an element."""

    def one_by_one(x: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(x, none, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums")))["sums"]

    def by_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda t, v: t + v))
        return let(one_by_one(totals, F.lit(0)), lambda before: F.flatten(F.transform(blocks, lambda x, i: one_by_one(x, F.get(before, i)))))

    return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK)), by_blocks)


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches, in code points, end exclusive."""
    pattern = F.lit(rule.pattern)

    def placed(gaps: Column, hits: Column, sizes: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: g + h)
        starts = F.zip_with(sums_before(steps), gaps, lambda b, g: b + g)
        found = F.transform(F.slice(starts, 1, F.size(hits)), lambda s, i: F.struct(s.alias("start"), (s + F.get(hits, i)).alias("end"), F.get(sizes, i).alias("n")))
        return F.transform(F.filter(found, lambda x: x["n"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    gaps, hits, sizes = (lengths(F.split(text, rule.pattern, -1)), lengths(F.regexp_extract_all(text, pattern, F.lit(0))), lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))))
    found = let(gaps, lambda g: let(hits, lambda h: let(sizes, lambda n: placed(g, h, n))))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


LEDGER = f"blob string, rule string, spans {SPANS}"


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


class Ledger:
    """The ledger as Parquet files in a folder that all machines share: a row for each blob and rule version that was scanned."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty_ledger(self.spark)

    def scan(self, versions: DataFrame, rules: tuple = RULES) -> DataFrame:
        """findings() of all versions; what the ledger lacked is scanned and appended to it."""
        known = self.rows()
        new, paths = scan_versions(versions, None if known.isEmpty() else known, rules)
        new.write.mode("append").parquet(self.path)
        return findings(self.rows(), paths, rules)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES) -> tuple[DataFrame, DataFrame]:
    """versions: path, text. Returns the ledger's new rows (blob, rule, spans), and (path, blob) of every version."""
    text = F.coalesce(versions["text"], F.lit(""))
    name = F.coalesce(versions["path"].cast("string"), F.lit(""))
    paths = written(versions.select(versions["path"], name.alias("name"), F.sha2(text.cast("binary"), 256).alias("blob")))
    chosen = paths.groupBy("blob").agg(F.min("name").alias("name"))
    ids = F.array(*[F.lit(r.id) for r in rules])
    if ledger is None:
        lacking = chosen.withColumn("lacks", ids)
    else:
        known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("known"))  # as many as there are rule versions
        lacking = chosen.join(known, "blob", "left").withColumn("lacks", F.array_except(ids, F.coalesce("known", F.array().cast("array<string>")))).where(F.size("lacks") > 0).drop("known")
        lacking = small(written(lacking), BROADCAST_BLOBS)
    texts = versions.select(name.alias("name"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    picked = texts.join(lacking.hint("shuffle_hash") if ledger is None else lacking, ["name", "blob"])
    each = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.when(F.array_contains("lacks", r.id), spans_of(F.col("text"), r)).alias("spans")) for r in rules])
    scanned = picked.select("blob", F.explode(each).alias("x")).where("x.spans is not null").select("blob", "x.rule", "x.spans")
    return scanned.dropDuplicates(["blob", "rule"]), paths.select("path", "blob")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kind(kind: str) -> Column:
    return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def findings(ledger: DataFrame, paths: DataFrame, rules: tuple = RULES) -> DataFrame:
    """A row for each path: path, n_<kind> for the base rules, base_spans and spans (kind:start:end by start, then rule, comma-joined)."""
    rule_of = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.id), F.struct(F.lit(i).alias("order"), F.lit(r.kind).alias("kind"), F.lit(r.base).alias("base")))])
    rows = ledger.where(F.size("spans") > 0).withColumn("r", rule_of[F.col("rule")]).where("r is not null")
    rows = rows.select("blob", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.col("r.order").alias("order"), F.col("r.kind").alias("kind"), x["end"].alias("end"), F.col("r.base").alias("base"))).alias("s"))
    by_blob = rows.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))  # a row for each rule version
    base = F.filter("s", lambda x: x["base"])
    by_blob = by_blob.select("blob", *[of_kind(r.kind) for r in rules if r.base], joined(base).alias("base_spans"), joined(F.col("s")).alias("spans"))
    # Written, so that no aggregate stands below the join and a blob of very many paths can be split.
    out = paths.join(small(written(by_blob), BROADCAST_BLOBS), "blob", "left")
    return out.select("path", *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules if r.base], F.coalesce("base_spans", F.lit("")).alias("base_spans"), F.coalesce("spans", F.lit("")).alias("spans"))


def secret_scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """findings() of all versions, given a ledger of earlier scans; Ledger.scan() also carries the ledger on."""
    new, paths = scan_versions(versions, ledger, rules)
    return findings(new if ledger is None else ledger.unionByName(new), paths, rules)
