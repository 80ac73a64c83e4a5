"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled texts, give a word's probability after the one before it, backing off to the word
by itself, which is the product of its first bytes, more of them, and the whole given those. Each order has discounted counts
of its class, interpolated with continuation counts that both share (in how many different pairs of neighbours something stands). What
neither class knows well has the same backed-off probability in both and says nothing; a new form of a known stem says what the stem says. A text is compared by length-normalised
log-likelihood ratios: the mean over its words, the roots of the means of what exceeds each of STEPS, and the greatest; a logistic map, fitted on labelled rows that the counts leave out, turns them into a probability.

Labels are learnt from a bounded sample (SAMPLE ids of each class at most, chosen by hash, and one text of each). Its words and pairs are counted in Spark,
and each distinct one is kept, those that stand once too; the driver gets their counts and no texts. Every document is scored whole, in
one map over Arrow batches, with no shuffle of texts. The models are sorted tables of the sample's words and pairs.

Defined results: null or wordless texts get the score of a mean ratio of 0; ids may be null or repeat, each row is scored by itself;
without labels of both classes every score is the prior (0.5 without labels); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import labelled_sample, written
from .decontaminate import chunks, mixed, text_bytes, word_hashes

#: Bound on the labelled rows of each class.
SAMPLE = 4000
#: Parts that the sample is dealt to.
SPREAD = 16
#: Bytes of a word's first parts, to which its own counts back off.
PREFIXES = (3, 4, 5, 6)
#: Log ratios beyond which a word counts as evidence.
STEPS = (1.0, 2.5, 4.0)
#: Added to shared probabilities, for what no class has seen.
UNSEEN = 1e-5


class Level:
    """One interpolated order: p(x | context) of both classes, from discounted counts and shared continuation counts."""

    def __init__(self, keys: np.ndarray, contexts: np.ndarray, counts: tuple[np.ndarray, np.ndarray], kinds: np.ndarray | None = None):
        """A row for each key or part of one. counts: of both classes. kinds: in how many different pairs of neighbours it stands; without, nothing is shared."""
        self.keys, at = np.unique(keys, return_inverse=True)
        self.contexts, of = np.unique(contexts, return_inverse=True)
        n, m = len(self.keys), len(self.contexts)
        own = np.zeros(n, np.int64)
        own[at] = of
        self.shared = None
        if kinds is not None:
            below = np.bincount(of, kinds, m)
            self.shared = np.append(np.bincount(at, kinds, n) / np.maximum(below[own], 1) + UNSEEN, UNSEEN).astype(np.float32)
        self.held, self.back = [], []
        for mine in counts:
            c, total = np.bincount(at, mine, n), np.bincount(of, mine, m)
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = max(once / (once + 2 * twice), 0.3) if once else 0.5
            self.held.append(np.append(np.maximum(c - discount, 0) / np.maximum(total[own], 1), 0.0).astype(np.float32))
            rest = np.bincount(own, np.minimum(c, discount), m)
            self.back.append(np.append(np.where(total > 0, rest / np.maximum(total, 1), 1.0), 1.0).astype(np.float32))

    def p(self, keys: np.ndarray, contexts: np.ndarray, lower: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """lower: the two probabilities that the back-off interpolates; else the shared one."""
        at, of = found_at(self.keys, keys), found_at(self.contexts, contexts)
        low = lower or (self.shared[at],) * 2
        return tuple(h[at] + b[of] * p for h, b, p in zip(self.held, self.back, low, strict=True))


def found_at(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, or the number of known ones."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    at[known[at] != keys] = len(known)
    return at


def pair_keys(contexts: np.ndarray, own: np.ndarray) -> np.ndarray:
    return mixed(contexts * np.uint64(3) + own)


def words_before(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before each in its text; 0 for the first."""
    out = np.zeros(len(words), np.uint64)
    out[1:] = words[:-1]
    out[bounds[:-1][bounds[:-1] < len(words)]] = 0
    return out


class Model:
    """A word is its first bytes, then more of it, then the whole given those; and the word given the one before it."""

    def __init__(self, words: dict[str, np.ndarray], pairs: dict[str, np.ndarray]):
        """What `counted` gives, as columns."""
        parts = (words["word"], np.zeros(1, np.int64), *(words[f"p{n}"] for n in PREFIXES))
        own = (words["toxic"], words["plain"])
        self.levels = [Level(*self.keys(parts, i), own, words["kinds"]) for i in range(len(PREFIXES) + 1)]
        self.levels.append(Level(pair_keys(pairs["before"], pairs["word"]), pairs["before"], (pairs["toxic"], pairs["plain"])))

    @staticmethod
    def keys(parts: tuple[np.ndarray, ...], level: int) -> tuple[np.ndarray, np.ndarray]:
        """Key and context of each word at a level: of the chain of a word's parts, and at last of the pair."""
        words, bounds, *prefixes = parts
        if level == len(prefixes) + 1:
            context, own = words_before(words, bounds), words
        else:
            context = prefixes[level - 1] if level else np.zeros(len(words), np.uint64)
            own = prefixes[level] if level < len(prefixes) else words
        return pair_keys(context, own), context

    def ratios(self, parts: tuple[np.ndarray, ...]) -> np.ndarray:
        """log p_toxic - log p_ordinary of each word."""
        toxic, plain = np.ones(len(parts[0])), np.ones(len(parts[0]))
        *chain, pair = self.levels
        for i, level in enumerate(chain):
            t, p = level.p(*self.keys(parts, i))
            toxic, plain = toxic * t, plain * p
        toxic, plain = pair.p(*self.keys(parts, len(chain)), (toxic, plain))
        return np.log(toxic) - np.log(plain)

    def features(self, texts: list[str | None]) -> np.ndarray:
        parts = word_hashes(*text_bytes(texts), prefixes=PREFIXES)
        r, bounds = self.ratios(parts), parts[1]
        n = np.diff(bounds)
        out = np.zeros((len(n), 2 + len(STEPS)))
        some = np.flatnonzero(n)
        if len(some):
            a = bounds[some]
            out[some, 0] = np.add.reduceat(r, a) / n[some]
            for i, step in enumerate(STEPS, 1):
                out[some, i] = np.sqrt(np.add.reduceat(np.maximum(r - step, 0), a) / n[some])
            out[some, -1] = np.maximum.reduceat(r, a)
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression on standardised inputs, by damped Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, hold, weight = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-9), weight / weight.sum()

    def loss(w: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, z @ w) - y * (z @ w)) + hold @ w**2 / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (weight * (y - p)) - hold * w)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def text_sample(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, label and text of a bounded sample of documents. A quarter of each class is set aside: it calibrates, and gives no counts."""
    ids = ids.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    # Of several texts with one id, one: so the sample has no more texts than ids.
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    turn = F.row_number().over(Window.partitionBy("label").orderBy("doc_id", F.xxhash64("text")))
    return written(rows.withColumn("aside", turn % 4 == 0).repartition(SPREAD, "doc_id"))


def counted(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each word: word, hashes of its first bytes, counts of both classes, in how many different pairs; and for each pair: before, word, counts."""
    firsts = [f"p{n}" for n in PREFIXES]
    pair_schema = StructType.fromDDL("before long, word long, toxic long, plain long")
    word_schema = StructType.fromDDL("word long, " + ", ".join(f"{p} long" for p in firsts))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label = batch.column("text").to_pylist(), batch.column("label").to_numpy()
            for a, b in chunks(texts):
                words, bounds = word_hashes(*text_bytes(texts[a:b]))
                before, toxic = words_before(words, bounds), np.repeat(label[a:b] == 1, np.diff(bounds))
                order = np.lexsort((words, before))
                before, words, toxic = before[order], words[order], toxic[order].astype(np.int64)
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (before[1:] != before[:-1])
                first = np.flatnonzero(new)
                sums = np.diff(np.append(0, np.cumsum(toxic))[np.append(first, len(words))])
                n = np.diff(np.append(first, len(words)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (before[first].view(np.int64), words[first].view(np.int64), sums, n - sums)], schema=to_arrow_schema(pair_schema))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                words, _, *prefixes = word_hashes(*text_bytes(texts[a:b]), prefixes=PREFIXES)
                own, first = np.unique(words, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (own, *(p[first] for p in prefixes))], schema=to_arrow_schema(word_schema))

    both = [F.sum(c).alias(c) for c in ("toxic", "plain")]
    found = written(sample.select("text", "label").mapInArrow(pairs, pair_schema).groupBy("before", "word").agg(*both))
    known = sample.select("text").mapInArrow(parts, word_schema).groupBy("word").agg(*(F.min(p).alias(p) for p in firsts))
    return found.groupBy("word").agg(*both, F.count("*").alias("kinds")).join(known, "word"), found


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """On the driver; hashes unsigned."""
    numbers = ("toxic", "plain", "kinds")
    rows = df.select(*(F.col(c).cast("int") if c in numbers else c for c in df.columns)).toArrow()
    return {c: x if c in numbers else x.view(np.uint64) for c in rows.column_names for x in [rows[c].to_numpy()]}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Broadcast | None, np.ndarray]:
    """labels: doc_id, label (0 or 1). The model and the logistic weights (prior only without a model)."""
    labels = labels.where("doc_id is not null and label in (0, 1)")
    totals = {int(r[0]): r[1] for r in labels.groupBy("label").count().collect()}
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    rows = text_sample(docs, labelled_sample(labels.where("label = 1"), sample).unionByName(labelled_sample(labels.where("label = 0"), sample)))
    if rows.select("label", "aside").distinct().count() < 4:
        return None, np.append(np.zeros(2 + len(STEPS)), np.log(prior / (1 - prior)))

    words, pairs = counted(rows.where("not aside"))
    shared = docs.sparkSession.sparkContext.broadcast(Model(columns(words), columns(pairs)))
    schema = StructType.fromDDL("doc_id long, label int, x array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(texts := batch.column("text").to_pylist()):
                x = shared.value.features(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array(x.tolist(), pa.list_(pa.float64()))], schema=to_arrow_schema(schema))

    known = sorted(tuple(r) for r in rows.where("aside").select("doc_id", "label", "text").mapInArrow(run, schema).collect())
    x, target = np.array([r[2] for r in known]), np.array([r[1] for r in known])
    share = target.mean()
    return shared, logistic(x, target, np.where(target == 1, prior / share, (1 - prior) / (1 - share)))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row for each document: doc_id, score (probability of label 1). docs: doc_id, text. labels: doc_id, label."""
    docs = docs.select("doc_id", "text")
    shared, w = fit(docs, labels, sample)
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, model = to_arrow_schema(schema), shared and shared.value
        for batch in batches:
            for a, b in chunks(texts := batch.column("text").to_pylist()):
                x = np.zeros((b - a, len(w) - 1)) if model is None else model.features(texts[a:b])
                z = np.clip(x @ w[:-1] + w[-1], -30, 30)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(1 / (1 + np.exp(-z)))], schema=arrow)

    return docs.mapInArrow(run, schema)
