"""Near-duplicate classes by DartMinHash.

A document is the multiset of its five-word shingles: the i-th copy of a shingle is a unit of weight one. Each unit throws darts
at ranks that form a Poisson process of rate one, from hashes of the unit alone; the darts below rank t / n (n: the
document's units) number about t = k ln k + 2 k, and each falls into one of k coordinates. The least rank of a coordinate is
its minimum; where a coordinate stays empty, the document's bound on ranks is doubled. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity, at a cost of n + t steps instead of n k.

BANDS bands of ROWS coordinates are joined: at similarity 0.8 a pair shares no band once in 150,000. Within a band's bucket the members
of every class but the largest become pivots, PIVOTS[0] of them in the first round and more in each further one, up to PIVOTS[-1],
and are compared with all members of other classes. A bucket is done when its members are of one class, or all members outside one class
have been pivots: then no pair of the bucket is left that could join two classes. So a bucket of m copies takes some m comparisons,
in a number of rounds that grows with the logarithm of m, and with m / PIVOTS[-1] only where a bucket's texts stay unlinked.
Before texts are compared, sizes and bitmaps are: a bitmap has the parity of a text's units by hash, so two bitmaps differ in no more
bits than the texts in units, and what they rule out is exact. What is left is compared by all 64 bits of the units, which are hashed again
from the texts of the nodes concerned.

Exact copies (equal words) are one node from the start. No group is gathered in a task: buckets and classes are only grouped by
partial aggregates and joined, which AQE splits where skewed. State between rounds is written to the shared folder.

Defined results: a text without words is in a class of its own; fewer than five words are one shingle; class_id is the least
doc_id of the class; rows with one doc_id are one document, so their classes unite; a null doc_id has a null class unless
its text copies one with an id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import relieve_driver, small, written
from .decontaminate import chunks, kgrams, mixed, text_bytes, word_hashes

SHINGLE = 5
#: Similarity as a fraction.
LEAST = (4, 5)
ROWS, BANDS = 5, 30
#: Pivots of a bucket in each round; the last number holds for all further ones.
PIVOTS = (1, 8, 64, 256)
#: Shares of a bucket for each pivot of a round; of the first of each, those of the greatest degrees become pivots.
SHARES = 4
#: Bits of a bitmap for each unit, at least, and its greatest number of 64-bit words.
BITS_PER_UNIT, MAX_BITMAP = 4, 64
#: Rows (of ids, of buckets with their pivots) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_PIVOTS = 500_000, 20_000
#: Edges up to which their components are found in one partition.
FEW_EDGES = 200_000
#: Bytes of text that are hashed and sketched at once.
SKETCH_BYTES = 1 << 20
_STEP, _COPY = 0xD1342543DE82EF95, np.uint64(0xAF251AF3B0F025B5)


def units_of(words: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Units of many texts, and the number of units before each text (and after the last)."""
    sizes = np.diff(bounds)
    grams = kgrams(words, shingle)
    of = np.repeat(np.arange(len(sizes)), sizes)
    good = np.arange(len(grams)) + shingle <= bounds[1:][of[: len(grams)]]
    grams, doc = grams[good], of[: len(good)][good]
    short = np.flatnonzero((sizes > 0) & (sizes < shingle))
    if len(short):
        grams = np.concatenate([grams, np.array([kgrams(words[bounds[i] : bounds[i + 1]], int(sizes[i]))[0] for i in short], np.uint64)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(grams))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    return mixed(grams + copy.astype(np.uint64) * _COPY), np.searchsorted(doc, np.arange(len(sizes) + 1))


def dart_minima(units: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Minimum rank of each of k coordinates, for each text that has units (others: infinity)."""
    n = np.diff(bounds)
    out = np.full((len(n), k), np.inf)
    todo, limit = np.flatnonzero(n), (k * math.log(k) + 2 * k) / np.maximum(n, 1)
    while len(todo):
        own = np.repeat(todo, n[todo])
        which = np.arange(len(own)) - np.repeat(np.cumsum(n[todo]) - n[todo], n[todo]) + bounds[own]
        unit, rank, step = units[which], np.zeros(len(own)), 0
        while len(unit):
            step = (step + _STEP) % (1 << 64)
            h = mixed(unit + np.uint64(step))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            on = rank < limit[own]
            unit, rank, own, h = unit[on], rank[on], own[on], h[on]
            coordinate = (mixed(h) >> np.uint64(32)).astype(np.int64) % k
            np.minimum.at(out.reshape(-1), own * k + coordinate, rank)
        todo = todo[np.isinf(out[todo]).any(1)]
        limit[todo] *= 2
    return out


def band_hashes(minima: np.ndarray, rows: int, bands: int) -> np.ndarray:
    bits = minima.view(np.uint64).reshape(len(minima), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _COPY, bits.shape[:2]).copy()
    for i in range(rows):
        out = mixed(out * np.uint64(3) + bits[:, :, i])
    return out.view(np.int64)


def bitmap(units: np.ndarray) -> np.ndarray:
    """Parity of the distinct units by their low bits, as signed 64-bit words: a power of two of them."""
    words = 1
    while words < MAX_BITMAP and 64 * words < BITS_PER_UNIT * len(units):
        words *= 2
    odd = np.bincount((units % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def hashed(texts: list[str | None]) -> Iterator[tuple[int, bytes | None, np.ndarray]]:
    """Index, key (None without words) and sorted distinct units of each text, in order."""
    for a, b in chunks(texts, SKETCH_BYTES):
        words, bounds = word_hashes(*text_bytes(texts[a:b]))
        units, cuts = units_of(words, bounds)
        for i in range(b - a):
            w = words[bounds[i] : bounds[i + 1]]
            yield a + i, _key(w) if len(w) else None, np.unique(units[cuts[i] : cuts[i + 1]])


def sketched(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, key (of the word sequence; null without words), n (its distinct units), bands, bits."""
    schema = StructType.fromDDL("doc_id long, key binary, n long, bands array<long>, bits array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(texts := batch.column("text").to_pylist(), SKETCH_BYTES):
                found = list(hashed(texts[a:b]))
                sets = [u for _, _, u in found]
                sizes = np.array([len(u) for u in sets], np.int64)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                lists = band_hashes(dart_minima(np.concatenate(sets), cuts, rows * bands), rows, bands)
                columns = [batch.column("doc_id").slice(a, b - a), [k for _, k, _ in found], sizes, [x if n else [] for x, n in zip(lists, sizes, strict=True)], [bitmap(u) if len(u) else [] for u in sets]]
                arrow = to_arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def units_by_node(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, key, units (sorted, eight bytes each) for nodes (node, key), from their texts."""
    schema = StructType.fromDDL("node long, key binary, units binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own = batch.column("key").to_pylist(), []
            for i, key, units in hashed(batch.column("text").to_pylist()):
                if key == keys[i]:  # a doc_id may have other texts as well
                    own.append((i, units.tobytes()))
            at = pa.array([i for i, _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("key").take(at).cast(pa.binary()), pa.array([u for _, u in own], pa.binary())], schema=to_arrow_schema(schema))

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(small(nodes, BROADCAST_IDS), "node")
    return texts.select("node", "key", "text").mapInArrow(run, schema).groupBy("node", "key").agg(F.first("units").alias("units"))


def similar(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """pairs (a, b) with whether any two of their texts reach LEAST, by their units."""
    schema = StructType.fromDDL("a long, b long, linked boolean")
    left, right = (units.select(F.col("node").alias(x), F.col("units").alias(f"u{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("ua"), batch.column("ub"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(y) > len(x):
                    x, y = y, x
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                linked.append(both * LEAST[1] >= (len(x) + len(y) - both) * LEAST[0])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], schema=to_arrow_schema(schema))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub").mapInArrow(run, schema).groupBy("a", "b").agg(F.max("linked").alias("linked"))


def contracted(edges: DataFrame) -> DataFrame | None:
    """edges (a, b) to the least node of each connected component: node, class, for all nodes that aren't the least. None without edges.

    Up to FEW_EDGES edges (pairs of numbers) are one partition, so that a step takes a task or two and no shuffle.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    few = edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES
    together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    edges, classes = together(edges), None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = together(both).groupBy("a").agg(F.least("a", F.min("b")).alias("up"))
        # A second step up: the least neighbour's own least neighbour.
        higher = low.select(F.col("a").alias("up"), F.col("up").alias("top"))
        step = together(written(low.join(higher, "up").select(F.col("a").alias("node"), F.col("top").alias("class"))))
        if classes is None:
            classes = step
        else:
            on = step.select(F.col("node").alias("class"), F.col("class").alias("new"))
            classes = together(written(classes.join(on, "class", "left").select("node", F.coalesce("new", "class").alias("class"))))
        a, b = (step.select(F.col("node").alias(x), F.col("class").alias(f"c{x}")) for x in "ab")
        moved = edges.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
        edges = together(written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    return classes if classes is None else classes.where("node <> class")


def may_link(p: Column) -> Column:
    """Whether a row's text may reach LEAST with the pivot p, by class, sizes and bitmaps."""
    least, most = LEAST
    fits = most * F.least("n", p["n"]) >= least * F.greatest("n", p["n"])
    differ = F.aggregate(F.zip_with("bits", p["bits"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = F.when(F.size("bits") == F.size(p["bits"]), differ * (most + least) <= (most - least) * (F.col("n") + p["n"])).otherwise(True)
    return F.when((F.col("class") != p["class"]) & fits, near).otherwise(False)


def classes_of(members: DataFrame, docs: DataFrame) -> DataFrame | None:
    """members (node, key, n, bands, bits): node, class for the nodes that aren't the least of their class; None without links."""
    banded = members.select(F.explode("bands").alias("band"), "node")
    many = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band")
    several = written(banded.join(many, "band"))
    # A text that shares many buckets lies in the middle of its group.
    wanted = several.groupBy("node").agg(F.count("*").alias("degree"))
    wanted = written(members.select("node", "key", "n", "bits").join(wanted, "node"))
    units = written(units_by_node(docs, wanted.select("node", "key")))
    met = written(several.join(wanted.drop("key"), "node").withColumn("class", F.col("node")))
    checked: list[DataFrame] = []
    classes, turn = None, 0
    while not (pivots := written(pivots_of(met, turn))).isEmpty():
        met = met.join(small(pivots, BROADCAST_PIVOTS), "band")
        other = F.explode(F.transform(F.filter("pivots", may_link), lambda p: p["node"]))
        pairs = met.select("node", other.alias("p")).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        if checked:
            pairs = pairs.join(small(reduce(DataFrame.unionAll, checked).select("a", "b"), BROADCAST_IDS), ["a", "b"], "left_anti")
        new = written(similar(written(pairs), units))
        checked.append(new)
        if not new.where("linked").isEmpty():
            classes = contracted(reduce(DataFrame.unionAll, checked).where("linked").select("a", "b"))
        met = met.where(~F.exists("pivots", lambda p: p["node"] == F.col("node"))).drop("pivots")
        if classes is not None:
            met = met.drop("class").join(small(classes, BROADCAST_IDS), "node", "left").withColumn("class", F.coalesce("class", "node"))
        met = written(met)
        turn += 1
        relieve_driver(docs.sparkSession)
    return classes


def pivots_of(rows: DataFrame, turn: int) -> DataFrame:
    """band and pivots for the buckets of several classes: of the members outside the largest class (at first of all), those of the greatest degrees; where they are few, all of them."""
    sizes = rows.groupBy("band", "class").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("m", "class")).alias("largest"), F.sum("m").alias("m"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi")
    largest = largest.select("band", F.col("largest.class").alias("largest"), (F.col("m") - F.col("largest.m")).alias("others"))
    left = rows.join(small(written(largest), BROADCAST_IDS), "band")
    some = left if turn == 0 else left.where("class <> largest")
    # Few members are a share each, as those that fall into one share would keep the whole bucket for another round.
    most = PIVOTS[min(turn, len(PIVOTS) - 1)]
    share = F.lit(0) if most == 1 else F.when(F.col("others") <= most * SHARES, F.col("node")).otherwise(F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(most * SHARES)))
    order = F.struct("degree", (-F.col("node")).alias("least"))
    one = F.max_by(F.struct("node", "class", "n", "bits"), order)
    shares = some.groupBy("band", share.alias("share")).agg(F.struct(F.max(order).alias("order"), one.alias("p")).alias("one"))
    ranked = F.slice(F.sort_array(F.collect_list("one"), asc=False), 1, most)
    return shares.groupBy("band").agg(F.transform(ranked, lambda x: x["p"]).alias("pivots"))


def near_duplicates(docs: DataFrame, *, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id of its class)."""
    drawn = written(sketched(docs, rows, bands))
    keyed = drawn.where("key is not null")
    # Equal words give equal sketches: the first will do.
    members = written(keyed.groupBy("key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n", "bands", "bits"))))
    nodes = members.select("key", "node")
    # Texts that share a doc_id are one node already; a doc_id that is copied by another text's class unites both.
    same = keyed.select("key", "doc_id").join(nodes, "key").where("doc_id <> node").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    links = _with_same(classes_of(members.where("node is not null"), docs), same)
    by_key = nodes if links is None else nodes.join(links, "node", "left").select("key", F.coalesce("class", "node").alias("node"))
    return drawn.select("doc_id", "key").join(by_key, "key", "left").select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("node")).alias("class_id"))


def _with_same(links: DataFrame | None, same: DataFrame) -> DataFrame | None:
    if same.isEmpty():
        return links
    return contracted(same if links is None else same.unionAll(links.select(F.col("class").alias("a"), F.col("node").alias("b"))))
