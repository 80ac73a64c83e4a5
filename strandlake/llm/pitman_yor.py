"""Language-model scores by a hierarchical Pitman-Yor model.

Every context has a Chinese restaurant whose dishes are words; all share one parent restaurant over words, whose base is uniform over the
known words and one unknown. Tables are seated by Gibbs sweeps: given the parent's probability of a word, and the restaurants' totals of the
sweep before, the customers of each word in each context are seated anew, and its tables sit down in the parent. Probabilities are averaged over the last KEPT sweeps.

score_by_histories has a restaurant for each preceding word (and one for the start of a text), however many there are; op8 uses the same model by messages (restaurants). The
pairs of a word and the one before it stand in a table; the state of words and contexts meets them by joins in each sweep, where only pairs that occur twice or more
are seated, as a single customer always has one table. Frequent pairs (fewer than 2 HEAD_PAIRS) are scored in the map from a broadcast; all
others by a join on the pair, and pairs that training does not hold by joins of word and context.

score_documents is the bounded form: a token's context is the last of the CONTEXTS - 1 most frequent words that precedes it in its text (or
none), so there are few restaurants whatever the corpus. A word's restaurants only need the word's own counts and the totals, so a sweep is one map
over the table of words, with one row of totals from each task.

Seating draws each of a dish's first EXACT customers; further ones come in blocks of half as many as sit already, whose number of new tables
is drawn from its Poisson or normal limit (tests compare mean and spread with drawing one by one). All draws are hashes of word, context, sweep and place, so reruns agree.

The bounded form reads text three times: for word counts, for counts by word and context, for scores. Frequent words (a share of more than one
in 2 HEAD of all tokens, so fewer than 2 HEAD) are scored in the map itself, from a broadcast table of
bounded size; all others are joined by word, where no word has more than that share. What is scored per word and
document is summed before the shuffle by document. Counts and draws do not depend on how the rows are dealt, so scores don't but for rounding.

Defined results: null or blank text is the end token alone; rows with equal doc_id are scored by themselves (equal rows give equal rows);
a null doc_id is trained on or held out by the hash of the empty text; without training text all probabilities are the base's; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import relieve_driver, small, unwritten, written
from .decontaminate import chunks, mixed, text_bytes, word_hashes

CONTEXTS, HEAD = 64, 1 << 17
SWEEPS, KEPT, EXACT = 5, 2, 64
#: Discount and strength of the contexts and of their parent.
D1, S1, D0, S0 = 0.75, 1.0, 0.6, 10.0
#: Words that are counted together before the shuffle.
GATHER = 1_500_000
#: Pairs of a word and the one before it that are scored in the map itself: fewer than 2 HEAD_PAIRS. Rows up to which words or contexts are broadcast.
HEAD_PAIRS, BROADCAST_ROWS = 1 << 17, 500_000
END, START = np.uint64(0x5EED), np.uint64(0x57A7)

#: Lower case of A-Z; 0 for white space.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[[9, 10, 11, 12, 13, 32]] = 0
_LETTERS[0] = 255


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, then END; and the number of tokens before each text."""
    words, bounds = word_hashes(*text_bytes(texts), _LETTERS)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def contexts(words: np.ndarray, bounds: np.ndarray, frequent: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each token's context: 1 + the rank of the last frequent word before it in its text; 0 for none. frequent: sorted; order: their ranks."""
    out = np.zeros(len(words), np.uint8)
    if not len(frequent) or not len(words):
        return out
    at = np.searchsorted(frequent, words)
    at[at == len(frequent)] = 0
    places = np.where(frequent[at] == words, np.arange(len(words)) + 1, 0)
    last = np.concatenate([[0], np.maximum.accumulate(places)[:-1]])  # the place after the last frequent word before
    inside = last > np.repeat(bounds[:-1], np.diff(bounds))
    out[inside] = order[at[last[inside] - 1]] + 1
    return out


def preceding(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each one in its text; START for the first."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[bounds[:-1]] = START
    return out


def grouped(words: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with their counts, in order."""
    order = np.lexsort((other, words))
    words, other = words[order], other[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (other[1:] != other[:-1])
    first = np.flatnonzero(new)
    return words[first], other[first], np.diff(np.append(first, len(words)))


def batch_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in chunks(texts):
            yield texts[a:b]


def frequent_words(training: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the head words (fewer than 2 HEAD), of the CONTEXTS - 1 most frequent, and those words' ranks. By counts of all words in all texts, so
    the result does not depend on how the rows are dealt."""
    schema = StructType.fromDDL("w long, c long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0

        def flush() -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], schema=to_arrow_schema(schema))

        for texts in batch_texts(batches):
            words, _ = tokens(texts)
            parts.append(words)
            waiting += len(words)
            if waiting >= GATHER:
                yield flush()
                parts, waiting = [], 0
        if parts:
            yield flush()

    sums = written(training.select("text").mapInArrow(run, schema).groupBy("w").agg(F.sum("c").alias("c")))
    total = sums.agg(F.sum("c")).first()[0] or 0
    rows = sums.where(F.col("c") > total // (2 * HEAD)).orderBy(F.col("c").desc(), "w").collect()  # fewer than 2 HEAD
    ranked = np.array([r["w"] for r in rows], np.int64).view(np.uint64)
    ranked = ranked[ranked != END]
    top = ranked[: CONTEXTS - 1]
    order = np.argsort(top)
    return np.sort(np.append(ranked, END)), top[order], order.astype(np.uint8)


def pair_sums(training: DataFrame, context_of: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """A row for each word and context of the training texts: w, u (of the type `kind`), c."""
    schema = StructType.fromDDL(f"w long, u {kind}, c long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, where, waiting = [], [], 0

        def flush() -> pa.RecordBatch:
            w, u, c = grouped(np.concatenate(words), np.concatenate(where))
            u = u.view(np.int64) if u.dtype == np.uint64 else u.astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(u), pa.array(c.astype(np.int64))], schema=to_arrow_schema(schema))

        for texts in batch_texts(batches):
            w, bounds = tokens(texts)
            words.append(w)
            where.append(context_of(w, bounds))
            waiting += len(w)
            if waiting >= GATHER:
                yield flush()
                words, where, waiting = [], [], 0
        if words:
            yield flush()

    return training.select("text").mapInArrow(run, schema).groupBy("w", "u").agg(F.sum("c").alias("c"))


def counted(training: DataFrame, top: np.ndarray, order: np.ndarray) -> DataFrame:
    """A row for each word of the training texts: w, us and cs (its contexts and its counts there)."""
    shared = training.sparkSession.sparkContext.broadcast((top, order))
    # A frequent word's rows, up to CONTEXTS from each task, are first summed by context; a list has at most CONTEXTS entries.
    sums = pair_sums(training, lambda w, bounds: contexts(w, bounds, *shared.value), "int")
    lists = sums.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("u", "c"))).alias("x"))
    return lists.select("w", F.col("x.u").alias("us"), F.col("x.c").alias("cs"))


class Totals(NamedTuple):
    """Of one state: tables in each context, customers and tables of the parent."""

    tables: np.ndarray
    customers: float
    parent: float


class Sizes(NamedTuple):
    words: int
    tokens: int
    #: Customers of each context.
    contexts: np.ndarray


def uniform(keys: np.ndarray, place: int) -> np.ndarray:
    return ((mixed(keys + np.uint64(place * 0xA24BAED4963EE407 % (1 << 64))) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def seated(customers: np.ndarray, new: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Number of tables of each dish, for its customers and the mass of a new table."""
    tables = (customers > 0).astype(float)
    for j in range(2, EXACT + 1):
        on = np.flatnonzero(customers >= j)
        if not len(on):
            return tables
        p = new[on] / (new[on] + j - 1 - discount * tables[on])
        tables[on] += uniform(keys[on], j) < p
    done, j = EXACT, EXACT
    while len(on := np.flatnonzero(customers > done)):
        block = np.minimum(customers[on] - done, done // 2)
        p = new[on] / (new[on] + done + block / 2 - discount * tables[on])
        j += 2
        tables[on] += np.minimum(drawn(block * p, block * p * (1 - p), uniform(keys[on], j), uniform(keys[on], j + 1)), block)
        done += done // 2
    return tables


def drawn(mean: np.ndarray, variance: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole numbers of a mean and variance: by the Poisson distribution where they are few, else by the normal one. u, v: uniform."""
    normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    out = np.maximum(np.rint(mean + np.sqrt(variance) * normal), 0)
    few = np.flatnonzero(mean < 8)
    k, term = np.zeros(len(few)), np.exp(-mean[few])
    below = term.copy()
    for i in range(1, 40):
        k += u[few] > below
        term *= mean[few] / i
        below += term
    out[few] = k
    return out


def sweeps(w: np.ndarray, of: np.ndarray, u: np.ndarray, c: np.ndarray, states: list[Totals], sizes: Sizes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each state: the parent's probability of each word before the sweep it opens, and after it the tables of each (word, context), the word's customers and tables in the parent."""
    n, m, base = np.bincount(of, minlength=len(w)).astype(float), np.ones(len(w)), 1 / (sizes.words + 1)
    for i, s in enumerate(states):
        root = parent_share(n, m, s, base)
        t = seated(c, (S1 + D1 * s.tables[u]) * root[of], D1, mixed(w[of] + mixed(u.astype(np.uint64) + np.uint64(1 + 1000 * i))))
        n = np.bincount(of, t, minlength=len(w))
        m = seated(n, np.full(len(w), (S0 + D0 * s.parent) * base), D0, mixed(w + np.uint64(77 + i)))
        yield root, t, n, m


def parent_share(n: np.ndarray, m: np.ndarray, s: Totals, base: float) -> np.ndarray:
    return (np.maximum(n - D0 * m, 0) + (S0 + D0 * s.parent) * base) / (S0 + s.customers)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    us, cs = batch.column("us"), batch.column("cs")
    sizes = np.diff(us.offsets.to_numpy())
    a = us.offsets[0].as_py()
    return batch.column("w").to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes)), sizes), us.values.to_numpy()[a : a + sizes.sum()], cs.values.to_numpy()[a : a + sizes.sum()].astype(float)


def gibbs(table: DataFrame) -> tuple[list[Totals], Sizes]:
    """The totals before each sweep and after the last one."""
    tops = {r["u"]: r for r in table.select(F.explode(F.arrays_zip("us", "cs")).alias("x")).groupBy(F.col("x.us").alias("u")).agg(F.sum("x.cs").alias("c"), F.count("*").alias("n")).collect()}  # CONTEXTS rows
    of = lambda k: np.array([float(tops[u][k]) if u in tops else 0.0 for u in range(CONTEXTS)])
    sizes = Sizes(table.count(), int(of("c").sum()), of("c"))
    states = [Totals(of("n"), of("n").sum(), float(sizes.words))]
    schema = StructType.fromDDL("x array<double>")
    for _ in range(SWEEPS):
        known = list(states)

        def run(batches: Iterator[pa.RecordBatch], known: list[Totals] = known) -> Iterator[pa.RecordBatch]:
            total = np.zeros(CONTEXTS + 2)
            for batch in batches:
                w, of, u, c = flat(batch)
                for _, t, n, m in sweeps(w, of, u, c, known, sizes):
                    pass
                total[:CONTEXTS] += np.bincount(u, t, CONTEXTS)
                total[CONTEXTS:] += n.sum(), m.sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], schema=to_arrow_schema(schema))

        sums = dict(table.mapInArrow(run, schema).select(F.posexplode("x")).groupBy("pos").agg(F.sum("col")).collect())  # CONTEXTS + 2 rows
        x = np.array([sums.get(i, 0.0) for i in range(CONTEXTS + 2)])
        states.append(Totals(x[:CONTEXTS], x[CONTEXTS], x[CONTEXTS + 1]))
    return states, sizes


def backs(states: list[Totals], sizes: Sizes) -> np.ndarray:
    """Mass that each kept sample leaves to the parent in each context."""
    return np.array([(S1 + D1 * s.tables) / (S1 + sizes.contexts) for s in states[-KEPT:]])


def probabilities(table: DataFrame, head: np.ndarray, states: list[Totals], sizes: Sizes) -> DataFrame:
    """A row for each word: w, c, roots (the parent's probability in each kept sample), us and ps (averaged probabilities in its own contexts), head."""
    schema = StructType.fromDDL("w long, c long, roots array<double>, us array<int>, ps array<double>, head boolean")
    shared = table.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, back = 1 / (sizes.words + 1), backs(states, sizes)
        for batch in batches:
            w, of, u, c = flat(batch)
            roots, ps = [], np.zeros(len(u))
            for i, (_, t, n, m) in enumerate(sweeps(w, of, u, c, states[:-1], sizes)):
                k = i - (SWEEPS - KEPT)
                if k >= 0:
                    roots.append(parent_share(n, m, states[i + 1], base))
                    ps += (np.maximum(c - D1 * t, 0) / (S1 + sizes.contexts[u]) + back[k][u] * roots[-1][of]) / KEPT
            at = np.searchsorted(shared.value, w)
            at[at == len(shared.value)] = 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(w)))]).astype(np.int32)
            roots = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * KEPT), pa.array(np.array(roots).T.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("w"), pa.array(np.bincount(of, c, len(w)).astype(np.int64)), roots, pa.ListArray.from_arrays(pa.array(ends), pa.array(u.astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(ps)), pa.array(shared.value[at] == w)],
                names=schema.fieldNames(),
            )

    return table.mapInArrow(run, schema)


class Head:
    """The head words' counts and, for each context, log10 probabilities (one row more, for a word without training counts)."""

    def __init__(self, rows: list, back: np.ndarray, unknown: np.ndarray):
        rows = sorted(rows, key=lambda r: np.uint64(r["w"] % (1 << 64)))
        self.words = np.array([r["w"] % (1 << 64) for r in rows], np.uint64)
        self.counts = np.array([r["c"] for r in rows], np.int64)
        p = np.zeros((len(rows) + 1, CONTEXTS))
        for i, r in enumerate(rows):
            p[i] = (np.array(r["roots"])[:, None] * back).mean(0)
            p[i, r["us"]] = r["ps"]
        p[-1] = (unknown[:, None] * back).mean(0)
        self.logs = np.log10(p).astype(np.float32)


PARTS = "doc_id long, key long, w long, u int, n int, rows int, n_tokens long, n_known long, base double, score double"


def text_keys(words: np.ndarray, bounds: np.ndarray, doc: np.ndarray) -> np.ndarray:
    keys = np.zeros(len(bounds) - 1, np.uint64)
    np.add.at(keys, doc, mixed(words + (np.arange(len(words)) - bounds[doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return keys


def part_rows(ids: pa.Array, keys: np.ndarray, n: np.ndarray, sums: list[np.ndarray], whose: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, arrow: pa.Schema) -> pa.RecordBatch:
    """A row for each text with what its head gives (sums: known tokens, base, score), and one for each other word and context (of the text `whose`)."""
    index, zero = np.concatenate([np.arange(len(ids)), whose]), np.zeros(len(w))
    columns = [
        ids.take(pa.array(index)),
        keys[index].view(np.int64),
        np.concatenate([keys.view(np.int64), w.view(np.int64)]),  # head rows meet no word: their u is -1
        np.concatenate([np.full(len(ids), -1, u.dtype), u]),
        np.concatenate([np.zeros(len(ids)), c]).astype(np.int32),
        np.concatenate([np.ones(len(ids)), zero]).astype(np.int32),
        np.concatenate([n, zero]).astype(np.int64),
        np.concatenate([sums[0], zero]).astype(np.int64),
        np.concatenate([sums[1], zero]),
        np.concatenate([sums[2], zero]),
    ]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=arrow)


def scored(docs: DataFrame, model: Head, top: np.ndarray, order: np.ndarray) -> DataFrame:
    """For each document, one row of what its head words give (rows = 1), and a row for each other word and context (n occurrences)."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(PARTS).fields[1:]])
    shared = docs.sparkSession.sparkContext.broadcast((model, top, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top, order = shared.value
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for a, b in chunks(texts := batch.column("text").to_pylist()):
                words, bounds = tokens(texts[a:b])
                u = contexts(words, bounds, top, order)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(b - a), n)
                keys = text_keys(words, bounds, doc)
                at = np.searchsorted(model.words, words)
                at[at == len(model.words)] = 0
                known = model.words[at] == words if len(model.words) else np.zeros(len(words), bool)
                own, base = doc[known], np.log10(model.counts[at[known]] + 1)
                sums = [np.bincount(own, x, b - a) for x in (None, base, model.logs[at[known], u[known]])]
                # The rest, once for each document, word and context.
                rest = np.flatnonzero(~known)
                w, where, c = grouped(words[rest], doc[rest].astype(np.int64) << 8 | u[rest])
                yield part_rows(batch.column("doc_id").slice(a, b - a), keys, n, sums, where >> 8, w, (where & 255).astype(np.int32), c, arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def numbers(x: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_tokens, n_known, train_tokens, base_score, score. training: the texts to learn from (text)."""
    head, top, order = frequent_words(training)
    table = written(counted(training, top, order))
    states, sizes = gibbs(table)
    back, base = backs(states, sizes), 1 / (sizes.words + 1)
    unknown = np.array([parent_share(np.zeros(1), np.zeros(1), s, base)[0] for s in states[-KEPT:]])
    words = written(probabilities(table, head, states, sizes))
    model = Head(words.where("head").drop("head").collect(), back, unknown)  # at most 2 HEAD rows

    rows = scored(docs, model, top, order)
    tail = words.where("not head").select("w", "c", "roots", "us", "ps")
    met = rows.join(tail, "w", "left")
    u, here = F.col("u"), F.array_position("us", F.col("u"))
    lower = sum(F.coalesce(F.get("roots", i), F.lit(float(unknown[i]))) * F.get(numbers(back[i]), u) for i in range(KEPT)) / KEPT
    p = F.when(here > 0, F.get("ps", (here - 1).cast("int"))).otherwise(lower)
    ours = F.col("n") > 0
    sums = met.groupBy("doc_id", "key").agg(
        F.sum("rows").alias("rows"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(ours & (F.col("c") > 0), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(ours, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(ours, F.col("n") * F.log10(p)).otherwise(0.0)).alias("score"),
    )
    return finished(sums, sizes.words, sizes.tokens)


def finished(sums: DataFrame, n_words: int, n_tokens: int) -> DataFrame:
    """Scores of the texts from the sums over them: doc_id, rows (equal ones), n_tokens, n_known, base, score."""
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))  # equal rows were summed together
    share = lambda c: F.col(c) / F.col("rows")
    base_score = share("base") - share("n_tokens") * float(np.log10(n_tokens + n_words + 1))
    return each.select("doc_id", share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), base_score.alias("base_score"), share("score").alias("score"))


class Histories(NamedTuple):
    """The model with a restaurant for each preceding word. pairs: w, u, c, of_word (the word's count), p; contexts: u, backs; words: w, size, roots."""

    pairs: DataFrame
    contexts: DataFrame
    words: DataFrame
    n_words: int
    n_tokens: int
    #: The parent's probability of an unknown word in each kept sample.
    unknown: list[float]


def histories(training: DataFrame) -> Histories:
    """Gibbs sweeps over the restaurants of all preceding words. A dish of one customer always has one table, so only
    the others are seated; the state of words and contexts meets them by joins."""
    pairs = written(pair_sums(training, preceding, "long"))
    sums = (F.sum("c").alias("size"), F.sum((F.col("c") == 1).cast("double")).alias("ones"), F.count("*").cast("double").alias("tables"))
    none = F.array().cast("array<double>")
    contexts = written(pairs.groupBy("u").agg(*sums).withColumn("backs", none))
    words = written(pairs.groupBy("w").agg(*sums).withColumn("m", F.lit(1.0)).withColumn("roots", none))
    n_words, n_tokens, customers = (x or 0 for x in words.agg(F.count("*"), F.sum("size"), F.sum("tables")).first())
    base, state, unknown = 1 / (n_words + 1), Totals(np.zeros(0), float(customers), float(n_words)), []
    many = pairs.where("c > 1").withColumn("kept", F.lit(0.0))
    for i in range(SWEEPS):
        keep, before = i >= SWEEPS - KEPT, [contexts, words, *[many] * (i > 0)]  # the first many are read from the pairs
        more = (S0 + D0 * state.parent) * base

        def seat(batches: Iterator[pa.RecordBatch], i: int = i, keep: bool = keep) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w, u, c, kept, root, tables = (b.column(x).to_numpy() for x in ("w", "u", "c", "kept", "root", "tables"))
                t = seated(c.astype(float), (S1 + D1 * tables) * root, D1, mixed(w.view(np.uint64) + mixed(u.view(np.uint64) + np.uint64(1 + 1000 * i))))
                kept = kept + np.maximum(c - D1 * t, 0) if keep else kept
                yield pa.RecordBatch.from_arrays([b.column("w"), b.column("u"), b.column("c"), pa.array(kept), pa.array(t)], names=["w", "u", "c", "kept", "t"])

        def reseat(batches: Iterator[pa.RecordBatch], i: int = i, more: float = more) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = seated(b.column("tables").to_numpy(), np.full(len(b), more), D0, mixed(b.column("w").to_numpy().view(np.uint64) + np.uint64(77 + i)))
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("w", "size", "ones", "tables")), pa.array(m), b.column("roots")], names=["w", "size", "ones", "tables", "m", "roots"])

        met = many.join(small(words.where("size > ones").select("w", root_of(state, base).alias("root")), BROADCAST_ROWS), "w")
        met = met.join(small(contexts.where("size > ones").select("u", "tables"), BROADCAST_ROWS), "u")
        many = written(met.select("w", "u", "c", "kept", "root", "tables").mapInArrow(seat, "w long, u long, c long, kept double, t double"))
        tables = (F.col("ones") + F.coalesce("t", F.lit(0.0))).alias("tables")
        contexts = written(contexts.join(many.groupBy("u").agg(F.sum("t").alias("t")), "u", "left").select("u", "size", "ones", tables, "backs"))
        words = words.join(many.groupBy("w").agg(F.sum("t").alias("t")), "w", "left").select("w", "size", "ones", tables, "roots")
        words = written(words.mapInArrow(reseat, "w long, size long, ones double, tables double, m double, roots array<double>"))
        customers, parent = (x or 0.0 for x in words.agg(F.sum("tables"), F.sum("m")).first())
        state = Totals(np.zeros(0), customers, parent)
        if keep:
            contexts = contexts.withColumn("backs", F.concat("backs", F.array((S1 + D1 * F.col("tables")) / (S1 + F.col("size")))))
            words = words.withColumn("roots", F.concat("roots", F.array(root_of(state, base))))
            unknown.append(float(parent_share(np.zeros(1), np.zeros(1), state, base)[0]))
        many = many.drop("t")
        # The sweep's own shuffles and the state before it are read no more.
        unwritten(*before)
        relieve_driver(training.sparkSession)
    every = many.unionByName(pairs.where("c = 1").withColumn("kept", F.lit(KEPT * (1 - D1))))
    every = every.join(small(words.select("w", F.col("size").alias("of_word"), "roots"), BROADCAST_ROWS), "w").join(small(contexts.select("u", "size", "backs"), BROADCAST_ROWS), "u")
    p = F.col("kept") / KEPT / (S1 + F.col("size")) + sum(F.get("roots", k) * F.get("backs", k) for k in range(KEPT)) / KEPT
    out = written(every.select("w", "u", "c", "of_word", p.alias("p")))
    unwritten(pairs, many)
    relieve_driver(training.sparkSession)
    return Histories(out, contexts, words, n_words, n_tokens, unknown)


def root_of(s: Totals, base: float) -> Column:
    """parent_share of a word's row."""
    return (F.greatest(F.col("tables") - D0 * F.col("m"), F.lit(0.0)) + (S0 + D0 * s.parent) * base) / (S0 + s.customers)


def pair_hash(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(words + mixed(before + np.uint64(1)))


class HeadPairs:
    """The head pairs' hashes in order, with log10(1 + the word's count) and log10 of the pair's probability."""

    def __init__(self, rows: pa.Table):
        w, u, of_word, p = (rows[c].to_numpy() for c in ("w", "u", "of_word", "p"))
        keys = pair_hash(w.view(np.uint64), u.view(np.uint64))
        order = np.argsort(keys)
        self.keys, self.base, self.logs = keys[order], np.log10(of_word[order] + 1), np.log10(p[order])


def scored_pairs(docs: DataFrame, model: HeadPairs) -> DataFrame:
    """As scored, by the pairs of each token and the one before it."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(PARTS.replace("u int", "u long")).fields[1:]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, arrow = shared.value, to_arrow_schema(schema)
        for batch in batches:
            for a, b in chunks(texts := batch.column("text").to_pylist()):
                words, bounds = tokens(texts[a:b])
                before, n = preceding(words, bounds), np.diff(bounds)
                doc, hashes = np.repeat(np.arange(b - a), n), pair_hash(words, before)
                at = np.searchsorted(model.keys, hashes)
                at[at == len(model.keys)] = 0
                known = model.keys[at] == hashes if len(model.keys) else np.zeros(len(words), bool)
                sums = [np.bincount(doc[known], x, b - a) for x in (None, model.base[at[known]], model.logs[at[known]])]
                # The rest, once for each document and pair.
                rest = np.flatnonzero(~known)
                rest = rest[np.lexsort((hashes[rest], doc[rest]))]
                new = np.ones(len(rest), bool)
                new[1:] = (hashes[rest[1:]] != hashes[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]])
                first = np.flatnonzero(new)
                one = rest[first]
                yield part_rows(batch.column("doc_id").slice(a, b - a), text_keys(words, bounds, doc), n, sums, doc[one], words[one], before[one].view(np.int64), np.diff(np.append(first, len(rest))), arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score_by_histories(docs: DataFrame, training: DataFrame) -> DataFrame:
    """As score_documents, with a restaurant for each preceding word."""
    model = histories(training)
    head = F.col("c") > model.n_tokens // (2 * HEAD_PAIRS)  # fewer than 2 HEAD_PAIRS
    rows = scored_pairs(docs, HeadPairs(model.pairs.where(head).select("w", "u", "of_word", "p").toArrow()))
    met = rows.join(model.pairs.where(~head).select("w", "u", "of_word", "p"), ["w", "u"], "left")
    ours, found = F.col("n") > 0, F.col("p").isNotNull()
    sums = written(met.groupBy("doc_id", "key").agg(
        F.sum("rows").alias("rows"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(ours & found, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(ours & found, F.col("n") * F.log10(F.col("of_word") + 1)).otherwise(0.0)).alias("base"),
        F.sum(F.col("score") + F.when(ours & found, F.col("n") * F.log10("p")).otherwise(0.0)).alias("score"),
        F.collect_list(F.when(ours & ~found, F.struct("w", "u", "n"))).alias("unseen"),
    ))
    # Pairs that training does not hold: the parent's probability by the context's mass for it. A list is a document's own.
    unseen = sums.select("doc_id", "key", F.explode("unseen").alias("x")).select("doc_id", "key", "x.*")
    unseen = unseen.join(small(model.words.select("w", "size", "roots"), BROADCAST_ROWS), "w", "left").join(small(model.contexts.select("u", "backs"), BROADCAST_ROWS), "u", "left")
    p = sum(F.coalesce(F.get("roots", k), F.lit(model.unknown[k])) * F.coalesce(F.get("backs", k), F.lit(1.0)) for k in range(KEPT)) / KEPT
    nothing, known = F.lit(0).cast("long"), F.col("size").isNotNull()
    parts = unseen.select("doc_id", "key", nothing.alias("rows"), nothing.alias("n_tokens"), F.when(known, F.col("n")).otherwise(0).cast("long").alias("n_known"), (F.col("n") * F.log10(F.coalesce("size", nothing) + 1)).alias("base"), (F.col("n") * F.log10(p)).alias("score"))
    names = ("rows", "n_tokens", "n_known", "base", "score")
    return finished(sums.drop("unseen").unionByName(parts).groupBy("doc_id", "key").agg(*(F.sum(c).alias(c) for c in names)), model.n_words, model.n_tokens)
