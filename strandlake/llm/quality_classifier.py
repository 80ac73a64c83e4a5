"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each word has a sparse ternary index vector, drawn from its hash. A term's context vector is the sum of the index vectors of the
words within SPAN places of its occurrences. There are two kinds of terms: the word, and the ending of the word with that of the
one before it (two bytes each, and whether both words are equal). A document's vector is the mean of its terms' unit-length context
vectors of each kind, with the logarithm of its length. A network with one hidden layer of tanh units is trained on it in numpy, and its
logits are divided by a temperature fitted on labelled rows that training leaves out.

Every term has a vector of its own; none is shared. All terms of all documents are counted. The vocabulary is of the most frequent ones, as
many as VOCABULARY and all of one count or none: their vectors sum up all occurrences in all documents. Any other term's vector sums up its
occurrences in the document that is scored, which for a term that stands in one document is the same. Sums are of whole numbers, so they do
not depend on how the rows are dealt. The vocabulary's vectors are broadcast (VOCABULARY x DIMENSIONS floats at most); no text moves.

Labels are learnt from a bounded sample: SAMPLE ids at most, by hash, and one row of each; only their vectors reach the driver.

Defined results: null or wordless texts have a zero vector and get its score; ids may be null or repeat, each row is scored by
itself; without labels of both classes every score is the smoothed prior; an empty table gives an empty result; extra columns are
ignored by score_quality, but for those in carry, which come through unchanged unless one has the score's name: the score takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import labelled_sample, relieve, written
from .decontaminate import chunks, mixed, text_bytes, word_hashes

#: Bound on the labelled rows.
SAMPLE = 8000
DIMENSIONS, NONZERO, SPAN = 32, 4, 2
#: Terms whose vectors are of the whole corpus, and how many of them share a row on their way.
VOCABULARY, BLOCK = 1 << 17, 64
#: Words that a task counts at once, bytes of text whose words are looked at together, and rows whose texts are Python's at once.
GATHER, CHUNK_BYTES, SLICE = 2_000_000, 1 << 18, 512
HIDDEN, EPOCHS, RATE = 32, 60, 3e-3
#: Least score of a document that counts as good.
GOOD = 0.7
#: Every byte but the six white-space ones belongs to a word.
_WORD = np.arange(256, dtype=np.uint8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
_WORD[0] = 255  # a zero byte is part of a word too


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, terms of words, terms of endings, and the words before each text."""
    data, offsets = text_bytes(texts)
    words, bounds, ends = word_hashes(data, offsets, _WORD, with_ends=True)
    last = data[ends - 1].astype(np.uint64) << np.uint64(8) | data[np.maximum(ends - 2, 0)].astype(np.uint64)
    before, same = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    before[1:], same[1:] = last[:-1], words[1:] == words[:-1]
    first = bounds[:-1][bounds[:-1] < len(words)]
    before[first], same[first] = 0, 0
    endings = mixed(last << np.uint64(17) | before << np.uint64(1) | same)
    return words, words, mixed(endings + np.uint64(1)), bounds


def neighbours(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each place, the sum of the index vectors of the words within SPAN places in its text: DIMENSIONS whole numbers."""
    index, at = np.zeros((len(words), DIMENSIONS), np.int8), np.arange(len(words))
    h = mixed(words)
    for i in range(NONZERO):
        part = h >> np.uint64(12 * i)
        index[at, (part % np.uint64(DIMENSIONS)).astype(np.int64)] += np.where(part >> np.uint64(10) & np.uint64(1), 1, -1).astype(np.int8)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.zeros_like(index)  # at most 2 SPAN NONZERO
    for d in range(1, SPAN + 1):
        near = (doc[d:] == doc[:-d]).astype(np.int8)[:, None]
        out[:-d] += index[d:] * near
        out[d:] += index[:-d] * near
    return out


def summed(keys: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, how often each stands, and the sums of their vectors."""
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    sums = np.add.reduceat(vectors[order], first, axis=0, dtype=np.int64) if len(own) else np.zeros((0, DIMENSIONS), np.int64)
    return own, np.diff(np.append(first, len(keys))), sums


def unit(sums: np.ndarray) -> np.ndarray:
    x = sums.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def places_in(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in sorted known ones, or their number."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return np.where(known[at] == keys, at, len(known))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches' rows, few at a time, with their texts."""
    relieve()
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.slice(at, SLICE)
            for a, b in chunks(texts := part.column("text").to_pylist(), CHUNK_BYTES):
                yield part.slice(a, b - a), texts[a:b]


def vocabulary_of(docs: DataFrame, most: int) -> np.ndarray:
    """Sorted hashes of the terms that stand n times or more, for the least n from 2 on that at most `most` terms reach."""
    schema = StructType.fromDDL("term long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0

        def counted() -> pa.RecordBatch:
            own, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], schema=to_arrow_schema(schema))

        for _, texts in pieces(batches):
            _, *kinds, _ = terms(texts)
            parts += kinds
            waiting += len(kinds[0])
            if waiting >= GATHER:
                yield counted()
                parts, waiting = [], 0
        if parts:
            yield counted()

    counts = written(docs.select("text").mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n")).where("n >= 2"))
    least, total = None, 0
    for n, terms_of in counts.groupBy("n").count().orderBy(F.col("n").desc()).limit(most).collect():  # a row for each count
        if total + terms_of > most:
            break
        least, total = n, total + terms_of
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(counts.where(F.col("n") >= least).select("term").toArrow()["term"].to_numpy().view(np.uint64))  # at most `most` rows


def narrowed(block: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them; the length tells how many."""
    widest = np.abs(block).max(initial=0)
    return block.astype(np.int8 if widest < 1 << 7 else np.int16 if widest < 1 << 15 else np.int64).tobytes()


def widened(data: bytes) -> np.ndarray:
    size = len(data) // (BLOCK * DIMENSIONS)
    return np.frombuffer(data, {1: np.int8, 2: np.int16, 8: np.int64}[size]).astype(np.int64).reshape(BLOCK, DIMENSIONS)


def context_vectors(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """The context vector of each term of the vocabulary, from all documents, on the driver."""
    schema = StructType.fromDDL("block int, v binary")
    size = -(-len(vocabulary) // BLOCK) * BLOCK
    if not size:
        return np.zeros((0, DIMENSIONS), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([narrowed(x) for _, x in found], pa.binary())], schema=to_arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, DIMENSIONS), np.int64)
        for _, texts in pieces(batches):
            words, *kinds, bounds = terms(texts)
            near = neighbours(words, bounds)
            for kind in kinds:
                own, _, sums = summed(places_in(shared.value, kind), near)
                total[own[own < len(shared.value)]] += sums[own < len(shared.value)]
        blocks = total.reshape(-1, BLOCK, DIMENSIONS)
        some = np.flatnonzero(blocks.any(axis=(1, 2)))
        for at in range(0, len(some), 256):
            yield rows([(int(i), blocks[i]) for i in some[at : at + 256]])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In order of blocks: the last one of a batch may go on in the next.
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            done = []
            for i, v in zip(batch.column("block").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if held is not None and held[0] == i:
                    held = i, held[1] + widened(v)
                else:
                    done += [held] if held is not None else []
                    held = i, widened(v)
            if done:
                yield rows(done)
        if held is not None:
            yield rows([held])

    found = docs.select("text").mapInArrow(run, schema).repartition("block").sortWithinPartitions("block").mapInArrow(added, schema).collect()  # a row for each block
    out = np.zeros((size, DIMENSIONS), np.int64)
    for r in found:
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = widened(bytes(r["v"]))
    return out[: len(vocabulary)]


class Pooling:
    """Document vectors, from the vocabulary's units."""

    def __init__(self, vocabulary: np.ndarray, vectors: np.ndarray):
        self.vocabulary, self.units = vocabulary, np.vstack([unit(vectors), np.zeros((1, DIMENSIONS), np.float32)])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """2 DIMENSIONS + 1 numbers for each text."""
        words, *kinds, bounds = terms(texts)
        n = np.diff(bounds)
        out, some, doc = np.zeros((len(n), 2 * DIMENSIONS + 1)), np.flatnonzero(n), np.repeat(np.arange(len(n)), n)
        out[:, -1] = np.log1p(n)
        if not len(some):
            return out
        near = neighbours(words, bounds)
        for i, kind in enumerate(kinds):
            at = places_in(self.vocabulary, kind)
            x = np.add.reduceat(self.units[at], bounds[some], axis=0, dtype=np.float64)
            # The other terms, once for each document.
            rest = np.flatnonzero(at == len(self.vocabulary))
            rest = rest[np.lexsort((kind[rest], doc[rest]))]
            if len(rest):
                new = np.ones(len(rest), bool)
                new[1:] = (kind[rest[1:]] != kind[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]])
                first = np.flatnonzero(new)
                sums = unit(np.add.reduceat(near[rest], first, axis=0, dtype=np.int64)) * np.diff(np.append(first, len(rest)))[:, None]
                of = doc[rest[first]]
                to, start = np.unique(of, return_index=True)
                x[np.searchsorted(some, to)] += np.add.reduceat(sums, start, axis=0, dtype=np.float64)
            out[some, i * DIMENSIONS : (i + 1) * DIMENSIONS] = x / n[some, None]
        return out


class Network:
    """Standardised inputs, a tanh layer, one logit over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        aside = rng.random(len(y)) < 0.2
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = self.standard(x)
        size = x.shape[1]
        p = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(0.0)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        own = np.flatnonzero(~aside)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(own), max(1, len(own) // 64)):
                a, b = x[part], y[part]
                hidden = np.tanh(a @ p[0] + p[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - b) / max(len(part), 1)
                back = np.outer(error, p[2]) * (1 - hidden**2)
                t += 1
                for i, g in enumerate((a.T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], error.sum())):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.layers, self.temperature = p, 1.0
        if aside.any():
            z, b = self.logits(x[aside]), y[aside]
            heat = np.exp(np.linspace(-1.0, 2.5, 71))
            loss = [np.mean(np.logaddexp(0, z / h) - b * z / h) for h in heat]
            self.temperature = float(heat[int(np.argmin(loss))])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.standard(x)) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, pooling: Broadcast, sample: int = SAMPLE) -> Network | float:
    """labels: doc_id, label (0 or 1). A network, or the prior where labels don't hold both classes."""
    ids = labelled_sample(labels.where("doc_id is not null and label in (0, 1)"), sample).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    schema = StructType.fromDDL("doc_id long, label int, x binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            x = [r.tobytes() for r in pooling.value(texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(x, pa.binary())], schema=to_arrow_schema(schema))

    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text").mapInArrow(run, schema)
    # Of several texts with one id, one: that of the least vector.
    rows = sorted(known.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x")).collect())
    y = np.array([r["label"] for r in rows], float)
    if len(set(y)) < 2:
        return (y.sum() + 0.5) / (len(y) + 1)
    return Network(np.array([np.frombuffer(r["x"]) for r in rows]), y)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: list[str] | None = None, name: str = "score", vocabulary: int = VOCABULARY) -> DataFrame:
    """docs' doc_id (or the columns in carry) with the probability of label 1 in the column `name`."""
    carry = [c for c in carry or ["doc_id"] if c != name]
    known = vocabulary_of(docs, vocabulary)
    context = docs.sparkSession.sparkContext
    pooling = context.broadcast(Pooling(known, context_vectors(docs, known)))
    shared = context.broadcast(fit(docs, labels, pooling, sample))
    schema = StructType([*(docs.schema[c] for c in carry), *StructType.fromDDL(f"`{name}` double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, arrow = shared.value, to_arrow_schema(schema)
        for part, texts in pieces(batches):
            scores = np.full(len(texts), model) if isinstance(model, float) else model(pooling.value(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(c).cast(arrow.field(c).type) for c in carry), pa.array(np.asarray(scores, float))], schema=arrow)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)
