"""The Pitman-Yor model with a restaurant for each preceding word (see pitman_yor), by messages of packed arrays.

Gives what pitman_yor.score_by_histories gives, but text is read once and a pair moves once, in a few bytes. There are n buckets of pairs (by the pair's
hash) and n servers of terms (words and preceding words, by the high bits of their hash). Rows are messages: where to, kind, where from, and compressed arrays.

  POSTED  from each gather of texts (about GATHER tokens) to each bucket: its pairs, their training counts, and which text holds them how often.
  BUCKET  all of a bucket's pairs and postings, read again only for the scores. ASK: its terms and their counts there, to their servers.
  MANY    the bucket's pairs that occur twice or more with what seatings have kept; a single customer always has one table, so only these are seated.
  TELL    from a server to a bucket: tables of the terms that MANY holds; REPLY: the tables seated there. One of each for a sweep.
  SERVER  the state of a server's terms and which of them each bucket asked for.
  VALUE   in the end, counts and kept tables of all terms of a bucket: small integers, from which the bucket makes probabilities.
  PART    from a bucket to a gather: sums over the tokens of each text. DOCS: a gather's ids and sizes.

A pair that more than HOT texts of a gather hold is posted once, as an extra text of the gather; the texts that hold it stand in DOCS. So neither a
frequent pair nor a frequent word makes a bucket or a server greater than others: those get at most one entry of it from each gather or bucket. The driver only sees totals.
A bucket holds about BUCKET_BYTES of text, as the number of buckets grows with the input. It does not follow from the number of shuffle partitions: each
bucket has a message from each gather and, twice a sweep, from each server, so more buckets than the text fills would only make more messages. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import relieve_driver, shared_dir, trimmed, unwritten, written
from .decontaminate import chunks, mixed
from .pitman_yor import D0, D1, KEPT, S0, S1, START, SWEEPS, Totals, pair_hash, parent_share, seated, tokens

GATHER, HOT, BUCKET_BYTES = 1_500_000, 512, 1 << 24
POSTED, DOCS, BUCKET, ASK, MANY, TELL, REPLY, SERVER, VALUE, PART, SUM = range(11)
ROWS = StructType([StructField(c, t()) for c, t in (("dest", IntegerType), ("kind", IntegerType), ("origin", LongType), ("data", BinaryType), ("x", DoubleType), ("y", DoubleType), ("z", DoubleType))])
_CODEC = pa.Codec("zstd", 1)


class Planes:
    """An array of whole numbers by their first, second and further bytes, which compress better apart; without the bytes that all lack."""

    def __init__(self, x: np.ndarray):
        width = max((int(x.max()).bit_length() + 7) // 8, 1) if len(x) else 1
        self.n, self.planes = len(x), np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()

    def array(self) -> np.ndarray:
        width = len(self.planes) // self.n if self.n else 1
        wide = 1 << (width - 1).bit_length()
        out = np.zeros((self.n, wide), np.uint8)
        out[:, :width] = np.frombuffer(self.planes, np.uint8).reshape(width, self.n).T
        return out.view(f"<u{wide}").ravel()


def narrow(x):
    if isinstance(x, list | tuple):
        return [narrow(y) for y in x]
    return Planes(x) if isinstance(x, np.ndarray) and x.dtype.kind in "iu" else x


def widened(x):
    if isinstance(x, list):
        return [widened(y) for y in x]
    return x.array() if isinstance(x, Planes) else x


def packed(*values) -> bytes:
    """Compressed. Arrays of whole numbers (none negative) come back in the least type that holds them."""
    raw = pickle.dumps(narrow(values), 5)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpacked(data: bytes) -> list:
    return widened(pickle.loads(_CODEC.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)))


def steps(ascending: np.ndarray) -> np.ndarray:
    """Small numbers whose cumsum gives them again."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def with_terms(data: bytes) -> list:
    """Unpacked, where the first array has the steps of hashes in order."""
    steps, *others = unpacked(data)
    return [np.cumsum(steps, dtype=np.uint64), *others]


def message_rows(rows: list[tuple]) -> pa.RecordBatch:
    """rows: dest, kind, origin, data, and for a SUM its three numbers."""
    whole = [(*r, *[None] * (7 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*whole, strict=True), to_arrow_schema(ROWS), strict=True)], schema=to_arrow_schema(ROWS))


def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("dest", "kind", "origin", "data")), strict=True)


def ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of their high bits hashes lie in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def slices(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """For numbers in order: each one, and where it begins and ends."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return zip(of[first].tolist(), first.tolist(), np.append(first, len(of))[1:].tolist(), strict=True)


def owner(gather: int, n: int) -> int:
    return int(mixed(np.array([gather], np.uint64))[0] % np.uint64(n))


def delivered(df: DataFrame, n: int, work: Callable) -> DataFrame:
    """What `work` makes of the rows, each in the task that its dest names."""
    return df.repartitionById(n, "dest").mapInArrow(work, ROWS)


class Gather:
    """Texts that are posted together."""

    def __init__(self, name: int):
        self.name, self.words, self.sizes, self.ids, self.marks, self.waiting = name, [], [], [], [], 0

    def add(self, texts: list[str | None], ids: pa.Array, marks: np.ndarray) -> None:
        words, bounds = tokens(texts)
        self.words.append(words)
        self.sizes.append(np.diff(bounds))
        self.ids.append(ids)
        self.marks.append(marks)
        self.waiting += len(words)

    def rows(self, n: int, most: int) -> list[tuple]:
        """Messages to n buckets; a pair of more than `most` texts is posted once."""
        words, sizes, (scored, learnt) = np.concatenate(self.words), np.concatenate(self.sizes), np.concatenate(self.marks, axis=1)
        terms, w = np.unique(np.append(words, START), return_inverse=True)
        w, doc = w.astype(np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        u = np.concatenate([w[-1:], w[:-2]])
        u[np.cumsum(sizes)[:-1]] = w[-1]
        w = w[:-1]
        # In order of bucket, word and preceding word.
        bucket = ranges(pair_hash(words, terms[u]), n)
        if n * len(terms) ** 2 < 1 << 63:
            order = np.argsort((bucket * len(terms) + w) * len(terms) + u)
        else:
            order = np.lexsort((u, w, bucket))
        bucket, w, u, doc = bucket[order], w[order], u[order], doc[order]
        del words, order
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
        bucket, w, u, pair = bucket[new], w[new], u[new], np.cumsum(new) - 1
        c = np.bincount(pair, learnt[doc]).astype(np.int64)
        # Postings in order of pair and text.
        posts = np.sort((pair << 32 | doc)[scored[doc]])
        begin = np.flatnonzero(np.diff(posts, prepend=-1))
        times, posts = np.diff(begin, append=len(posts)), posts[begin]
        pair, doc = posts >> 32, posts & 0xFFFFFFFF
        hot = np.flatnonzero(np.bincount(pair, minlength=len(w)) > most)
        rank = np.full(len(w), -1)
        rank[hot] = np.arange(len(hot))
        held = rank[pair] >= 0
        frequent = rank[pair[held]], doc[held], times[held]
        pair, doc, times = (np.concatenate([a[~held], b]) for a, b in ((pair, hot), (doc, len(sizes) + np.arange(len(hot))), (times, np.ones(len(hot), np.int64))))
        if len(hot):
            order = np.argsort(pair, kind="stable")
            pair, doc, times = pair[order], doc[order], times[order]
        ends = np.concatenate([[0], np.cumsum(per := np.bincount(pair, minlength=len(w)))])
        out = []
        for dest, a, b in slices(bucket):
            own, place = np.unique(np.concatenate([w[a:b], u[a:b]]), return_inverse=True)
            held = slice(ends[a], ends[b])
            out.append((dest, POSTED, self.name, packed(steps(terms[own]), steps(place[: b - a]), place[b - a :], c[a:b], per[a:b], doc[held], times[held])))
        ids = pa.concat_arrays(self.ids).filter(pa.array(scored))
        out.append((owner(self.name, n), DOCS, self.name, packed(np.flatnonzero(scored), sizes[scored], *frequent, len(sizes), len(hot), ids)))
        return out


def posted(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        gather = Gather(name)
        for batch in batches:
            texts, marks = batch.column("text").to_pylist(), np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in ("scored", "learnt")], bool)
            for a, b in chunks(texts):
                gather.add(texts[a:b], batch.column("doc_id").slice(a, b - a), marks[:, a:b])
                if gather.waiting >= GATHER:
                    yield message_rows(gather.rows(n, HOT))
                    gather = Gather(gather.name + 1)
        if gather.waiting:
            yield message_rows(gather.rows(n, HOT))
        del gather
        trimmed()

    return rows.select("doc_id", "text", "scored", "learnt").mapInArrow(run, ROWS)


def merged(n: int) -> Callable:
    """POSTED to BUCKET, MANY and ASK; DOCS stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, me = [], 0
        for dest, kind, origin, data in messages(batches):
            if kind == DOCS:
                yield message_rows([(dest, kind, origin, data)])
            else:
                parts.append((origin, *with_terms(data)))
                me = dest
        if not parts:
            return
        terms, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        starts = np.cumsum([0] + [len(p[1]) for p in parts])
        keys = np.concatenate([place[s:][np.cumsum(p[2])] << 32 | place[s:][p[3]] for s, p in zip(starts, parts, strict=False)])
        keys, pair = np.unique(keys, return_inverse=True)
        c = np.bincount(pair, np.concatenate([p[4] for p in parts])).astype(np.int64)
        w, u, posts, at = keys >> 32, keys & 0xFFFFFFFF, [], 0
        for origin, _, _, _, _, per, doc, times in parts:
            posts.append((origin, steps(np.repeat(pair[at : at + len(per)], per)), doc, times))
            at += len(per)
        out = [(me, BUCKET, me, packed(steps(w), u, c, posts))]
        del parts, posts, pair, keys
        counts = [np.bincount(x, y, len(terms)).astype(np.int64) for x in (w, u) for y in (c, c == 1, c > 0)]
        many = c > 1
        active, place = np.unique(np.concatenate([w[many], u[many]]), return_inverse=True)
        if len(active):
            out.append((me, MANY, me, packed(steps(terms[active]), place[: many.sum()], place[many.sum() :], c[many], np.zeros(many.sum()))))
        for server, a, b in slices(ranges(terms, n)):
            out.append((server, ASK, me, packed(steps(terms[a:b]), *(x[a:b] for x in counts), active[np.searchsorted(active, a) : np.searchsorted(active, b)] - a)))
        del w, u, c, counts, many, place
        yield message_rows(out)
        del out
        trimmed()

    return run


def told(asked: list, n: np.ndarray, m: np.ndarray, tables: np.ndarray) -> list[tuple]:
    return [(bucket, TELL, [x[at[active]].astype(np.int64) for x in (n, m, tables)]) for bucket, at, active in asked if len(active)]


def served(me: int, state: tuple, rows: list[tuple], sums: tuple) -> pa.RecordBatch:
    return message_rows([*([(me, SERVER, me, packed(*state))] if state else []), *((dest, kind, me, packed(*x)) for dest, kind, x in rows), (me, SUM, me, None, *map(float, sums))])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ASK to SERVER and the first TELL, where each pair has one table; MANY stays."""
    parts, me = [], 0
    for dest, kind, origin, data in messages(batches):
        if kind == MANY:
            yield message_rows([(dest, kind, origin, data)])
        else:
            parts.append((origin, *with_terms(data)))
            me = dest
    if not parts:
        return
    terms, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    size, ones, n, of_context, ones_there, tables = (np.bincount(place, np.concatenate([p[i] for p in parts])).astype(np.int64) for i in range(2, 8))
    starts = np.cumsum([0] + [len(p[1]) for p in parts])
    asked = [(p[0], place[s : s + len(p[1])], p[8]) for s, p in zip(starts, parts, strict=False)]
    m = (size > 0).astype(np.int64)
    yield served(me, (steps(terms), size, ones, of_context, ones_there, asked, []), told(asked, n, m, tables), (n.sum(), m.sum(), size.sum()))


def seating(i: int, n: int, state: Totals, base: float) -> Callable:
    """MANY and TELL to MANY and REPLY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, tells, me = None, {}, 0
        for dest, kind, origin, data in messages(batches):
            if kind == MANY:
                many, me = with_terms(data), dest
            else:
                tells[origin] = unpacked(data)
        if many is None:
            return
        terms, w, u, c, kept = many
        n_of, m_of, tables = (np.concatenate([tells[s][k] for s in sorted(tells)]).astype(float) for k in range(3))  # servers hold ranges of the terms in order
        new = (S1 + D1 * tables[u]) * parent_share(n_of, m_of, state, base)[w]
        t = seated(c.astype(float), new, D1, mixed(terms[w] + mixed(terms[u] + np.uint64(1 + 1000 * i))))
        if i >= SWEEPS - KEPT:
            kept = kept + np.maximum(c - D1 * t, 0)
        by_word, by_context = (np.bincount(x, t, len(terms)).astype(np.int64) for x in (w, u))
        yield message_rows([(me, MANY, me, packed(steps(terms), w, u, c, kept)), *((server, REPLY, me, packed(by_word[a:b], by_context[a:b])) for server, a, b in slices(ranges(terms, n)))])

    return run


def reseating(i: int, state: Totals, base: float) -> Callable:
    """SERVER and REPLY to SERVER and TELL, or VALUE after the last sweep; MANY stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        server, replies, me = None, {}, 0
        for dest, kind, origin, data in messages(batches):
            if kind == MANY:
                yield message_rows([(dest, kind, origin, data)])
            elif kind == SERVER:
                server, me = with_terms(data), dest
            else:
                replies[origin] = unpacked(data)
        if server is None:
            return
        terms, size, ones, of_context, ones_there, asked, before = server
        n, tables = ones.astype(float), ones_there.astype(float)
        for bucket, at, active in asked:
            if bucket in replies:
                n[at[active]] += replies[bucket][0]
                tables[at[active]] += replies[bucket][1]
        m = seated(n, np.full(len(n), (S0 + D0 * state.parent) * base), D0, mixed(terms + np.uint64(77 + i)))
        if i >= SWEEPS - KEPT:
            before = [*before, [x.astype(np.int64) for x in (n, m, tables)]]
        if i < SWEEPS - 1:
            yield served(me, (steps(terms), size, ones, of_context, ones_there, asked, before), told(asked, n, m, tables), (n.sum(), m.sum(), 0))
        else:
            yield served(me, (), [(bucket, VALUE, [size[at], of_context[at], *(x[at] for kept in before for x in kept)]) for bucket, at, _ in asked], (n.sum(), m.sum(), 0))

    return run


def scoring(n: int, kept_states: list[Totals], base: float) -> Callable:
    """BUCKET, MANY and VALUE to PART."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, many, values = None, None, {}
        for _, kind, origin, data in messages(batches):
            if kind == BUCKET:
                bucket = unpacked(data)
            elif kind == MANY:
                many = unpacked(data)
            else:
                values[origin] = unpacked(data)
        if bucket is None:
            return
        w, u, c, posts = bucket
        w = np.cumsum(w)
        size, of_context, *tables = (np.concatenate([values[s][k] for s in sorted(values)]).astype(float) for k in range(2 + 3 * KEPT))
        p = np.where(c == 1, KEPT * (1 - D1), 0.0)
        if many is not None:
            p[c > 1] = many[4]
        p = p / KEPT / (S1 + of_context[u])
        for k, state in enumerate(kept_states):
            n_of, m_of, there = tables[3 * k : 3 * k + 3]
            p += parent_share(n_of, m_of, state, base)[w] * ((S1 + D1 * there) / (S1 + of_context))[u] / KEPT
        sums = (size > 0).astype(float)[w], np.log10(size + 1)[w], np.log10(p)
        for gather, pair, doc, times in posts:
            pair, held = np.cumsum(pair), np.flatnonzero(np.bincount(doc))
            known, own, score = (np.bincount(doc, x[pair] * times)[held] for x in sums)
            if len(held):
                yield message_rows([(owner(gather, n), PART, gather, packed(held, known.astype(np.int64), own, score))])
        del bucket, many, values, size, of_context, tables, p, sums, posts, w, u, c
        trimmed()

    return run


def finishing(n_words: int, n_tokens: int, schema: StructType) -> Callable:
    """DOCS and PART to a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathers, parts = {}, defaultdict(list)
        for _, kind, origin, data in messages(batches):
            if kind == DOCS:
                gathers[origin] = data
            else:
                parts[origin].append(data)
        for gather, data in gathers.items():
            scored, sizes, hot, doc, times, n_docs, n_hot, ids = unpacked(data)
            sums = np.zeros((3, n_docs + n_hot))
            for part in parts.pop(gather, []):
                held, *own = unpacked(part)
                sums[:, held] += own
            sums = [x[scored] + np.bincount(doc, x[n_docs + hot.astype(np.int64)] * times, n_docs)[scored] for x in sums]
            columns = [ids, sizes.astype(np.int64), np.rint(sums[0]).astype(np.int64), np.full(len(ids), n_tokens, np.int64), sums[1] - sizes * float(np.log10(n_tokens + n_words + 1)), sums[2]]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=to_arrow_schema(schema))

    return run


def buckets(size: int, cores: int) -> int:
    """For so many bytes of text: two for each core at least."""
    return max(2 * cores, -(-size // BUCKET_BYTES))


def score_marked(rows: DataFrame) -> DataFrame:
    """A row for each row that is `scored`: doc_id, n_tokens, n_known, train_tokens, base_score, score. rows: doc_id, text, and whether they are scored and learnt from."""
    spark = rows.sparkSession
    n = buckets(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, spark.sparkContext.defaultParallelism)
    path = shared_dir(spark)
    delivered(posted(rows, n), n, merged(n)).write.partitionBy("kind").parquet(path)
    kinds = lambda df, *which: df.where(F.col("kind").isin(*which))
    texts = lambda *which: kinds(spark.read.schema(ROWS).parquet(path), *which)
    texts(DOCS).count()  # the last query's shuffle is held until another one has run
    relieve_driver(spark)
    at = written(delivered(texts(ASK, MANY), n, opened))
    totals = lambda: [x or 0.0 for x in kinds(at, SUM).agg(F.sum("x"), F.sum("y"), F.sum("z")).first()]
    customers, n_words, n_tokens = totals()
    if n_words:
        unwritten(spark.read.parquet(f"{path}/kind={ASK}"))
    base, states = 1 / (n_words + 1), [Totals(np.zeros(0), customers, n_words)]
    relieve_driver(spark)
    for i in range(SWEEPS):
        before, state = at, states[-1]
        sat = delivered(kinds(before, MANY, TELL), n, seating(i, n, state, base))
        at = written(delivered(sat.unionByName(kinds(before, SERVER)), n, reseating(i, state, base)))
        states.append(Totals(np.zeros(0), *totals()[:2]))
        # The sweep's own shuffles and the state before it are read no more.
        unwritten(before)
        del sat, before
        relieve_driver(spark)
    parts = delivered(texts(BUCKET).unionByName(kinds(at, MANY, VALUE)), n, scoring(n, states[-KEPT:], base))
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return texts(DOCS).unionByName(parts).repartitionById(n, "dest").mapInArrow(finishing(int(n_words), int(n_tokens), schema), schema)
