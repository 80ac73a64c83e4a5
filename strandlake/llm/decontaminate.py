"""Benchmark decontamination by winnowing.

A text's words are hashed; each run of K words is a k-gram; in each run of W consecutive k-grams the least hash is kept as a
fingerprint (the rightmost of equals). Two texts that share WINDOW = K + W - 1 words therefore share a fingerprint. Fingerprints
of the documents meet those of the items in a broadcast join, and each hit is extended word by word to both sides; a stretch of
WINDOW words or more marks its document words. Items of fewer words are one window each: their single k-gram of all
their words is looked up among all k-grams of that length (winnowing with a window of one).

Documents pass through one map over Arrow batches: no shuffle, so neither a hot source nor a passage in a third of all
documents gathers anywhere. The items' hashes are broadcast in blocks of at most BLOCK_MB, one after the other: with more than one block, each
is a pass over the documents, written to the shared folder, and the hit intervals are united per document.

Defined results: null or wordless texts have no words and no hits; items that are null, wordless or without an id are ignored;
ids may be null or repeat, each row is judged by itself; without items nothing is contaminated; an empty table gives an empty
result; extra columns of the documents are carried along unchanged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import KEPT, relieve, written

K, W = 5, 6
WINDOW = K + W - 1
#: Bound on the hashes and positions of items that one pass broadcasts.
BLOCK_MB = 32
#: Bytes of text that are hashed at once; a longer text makes a longer chunk of its own.
CHUNK_BYTES = 1 << 22
#: The same, and texts held at once, where documents are marked; some 50 bytes are needed for each of text.
MARK_BYTES, SLICE = 1 << 18, 512

#: Lower case of A-Z; 0 for what is no word byte. Word bytes: 0-9, A-Z, a-z and all of other letters' UTF-8.
_LOWER = np.zeros(256, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _LOWER[_b] = _b
_LOWER[65:91] = np.arange(97, 123)
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    if len(_kept.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _kept[base] = np.multiply.accumulate(out)
        if len(out) > 1 << 20:
            KEPT["powers"] = _kept.clear
    return _kept[base][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _LOWER, with_ends: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of many texts, and the number of words before each text (and after the last).

    data: UTF-8 bytes of all texts; offsets: where each begins and the last ends; letters: what each byte counts as, 0 outside words.
    with_ends: also where each word ends. prefixes: also hashes of the words' first so many bytes (the word's own if it has no more).
    """
    low = letters[data]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low != 0
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(offsets[1:-1])  # a word may not run over from one text into the next
    if len(starts) and len(cuts):
        k = np.searchsorted(starts, cuts, "left") - 1
        split = cuts[(k >= 0) & (starts[k] < cuts) & (cuts < ends[k])]
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_P, len(low)), out=sums[1:])
    unit = powers(_INVERSE, len(low) + 1)[starts]

    def hashed(stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[starts]) * unit + (stop - starts).astype(np.uint64))

    out = hashed(ends), np.searchsorted(starts, offsets, "left"), *(hashed(np.minimum(ends, starts + n)) for n in prefixes)
    return (*out, ends) if with_ends else out


def text_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])


def kgrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (over text borders too, which callers leave out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out = mixed(out * np.uint64(3) + words[i : n + i])
    return out


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """Mask of the k-grams that are the rightmost least of some run of w of them (all runs of the concatenated texts: never fewer)."""
    n = len(grams)
    keep = np.zeros(n, bool)
    if n <= w:
        keep[:] = True
        return keep
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], w)
    keep[np.unique(n - 1 - (np.arange(len(view)) + view.argmin(1)))] = True
    return keep


class Items:
    """Word hashes and fingerprints of some items, sorted for lookup."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        words, bounds = word_hashes(*text_bytes(texts))
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        prints, shorts = [], defaultdict(dict)
        for i, w in enumerate(self.words):
            if len(w) >= WINDOW:
                grams = kgrams(w, K)
                for at in np.flatnonzero(winnowed(grams, W)):
                    prints.append((grams[at], i, at))
            elif len(w):
                shorts[len(w)].setdefault(kgrams(w, len(w))[0], []).append(i)
        prints.sort()
        self.keys = np.array([x[0] for x in prints], np.uint64)
        self.item = np.array([x[1] for x in prints], np.int64)
        self.at = np.array([x[2] for x in prints], np.int64)
        self.shorts = {n: (np.sort(np.array(list(found), np.uint64)), found) for n, found in shorts.items()}


def found_in(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == values


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def hits(words: np.ndarray, bounds: np.ndarray, items: Items) -> dict[int, list[tuple[int, int, int]]]:
    """For texts with hits: (first word, word after the last, item) of each stretch."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    grams = kgrams(words, K)
    places = np.flatnonzero(winnowed(grams, W) & found_in(items.keys, grams)) if len(items.keys) else np.zeros(0, np.int64)
    of = np.searchsorted(bounds, places, "right") - 1
    done: dict[tuple[int, int, int], int] = {}
    for p, doc in zip(places.tolist(), of.tolist(), strict=True):
        lo, hi = int(bounds[doc]), int(bounds[doc + 1])
        if p + K > hi:
            continue
        for j in range(*np.searchsorted(items.keys, [grams[p]], "left"), int(np.searchsorted(items.keys, grams[p], "right"))):
            item, q = int(items.item[j]), int(items.at[j])
            if done.get((doc, item, p - q), -1) > p:
                continue
            own = items.words[item]
            left = agreement(words[lo:p][::-1][:q], own[:q][::-1])
            right = agreement(words[p:hi], own[q:])
            done[doc, item, p - q] = p + right
            if left + right >= WINDOW:
                out[doc].append((p - left - lo, p + right - lo, item))
    for n, (keys, found) in items.shorts.items():
        grams = kgrams(words, n)
        places = np.flatnonzero(found_in(keys, grams))
        of = np.searchsorted(bounds, places, "right") - 1
        for p, doc in zip(places.tolist(), of.tolist(), strict=True):
            lo, hi = int(bounds[doc]), int(bounds[doc + 1])
            if p + n <= hi:
                out[doc] += [(p - lo, p + n - lo, item) for item in found[grams[p]] if np.array_equal(items.words[item], words[p : p + n])]
    return out


def chunks(texts: list[str | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def united(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _marked(docs: DataFrame, items: Items, carry: list[str], names: tuple[str, str, str]) -> DataFrame:
    """The columns in carry, and under `names` the number of words, the hit spans and the items."""
    new = StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("long", "array<struct<start:int,end:int>>", "array<string>"), strict=True)))
    schema = StructType([*(docs.schema[c] for c in carry), *new.fields])
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        items = shared.value
        relieve()
        for batch in (x.slice(at, SLICE) for x in batches for at in range(0, len(x), SLICE)):
            for a, b in chunks(texts := batch.column("text").to_pylist(), MARK_BYTES):
                words, bounds = word_hashes(*text_bytes(texts[a:b]))
                found = hits(words, bounds, items)
                spans = [[{"start": s, "end": e} for s, e in united([[s, e] for s, e, _ in found[i]])] if i in found else [] for i in range(b - a)]
                names = [sorted({items.ids[x[2]] for x in found[i]}) if i in found else [] for i in range(b - a)]
                new = [np.diff(bounds), spans, names]
                part = batch.slice(a, b - a)
                old = [part.column(c).cast(arrow.field(c).type) for c in carry]
                yield pa.RecordBatch.from_arrays(old + [pa.array(x, arrow.field(len(carry) + i).type) for i, x in enumerate(new)], schema=arrow)

    return docs.mapInArrow(run, schema)


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """Items in blocks whose texts have at most BLOCK_MB / 16 MB (a word takes 8 bytes, a fingerprint 24), one at a time; one block without items."""
    ids, texts, size, some = [], [], 0, False
    for row in items.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").toLocalIterator():
        if ids and size + len(row[1]) > BLOCK_MB * (1 << 20) // 16:
            yield Items(ids, texts)
            ids, texts, size, some = [], [], 0, True
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    if ids or not some:
        yield Items(ids, texts)


def joined_spans(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""

    def grown(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = F.coalesce(x["start"] <= last["end"], F.lit(False))
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), grown)


NEW = ("n_words", "hit_spans", "n_hit", "item_ids", "contaminated")


def find_contamination(docs: DataFrame, items: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in carry), with n_words, hit_spans (disjoint, in words, end exclusive), n_hit, item_ids (sorted as strings) and contaminated.

    docs: text and any other columns. items: item_id, text. Clashing names: the new columns take the place of old ones.
    """
    own = [c for c in carry or docs.columns if c not in NEW]
    need = list(dict.fromkeys([*own, "text"]))
    # The columns of a pass come after the documents' own ones, under names that none of those has.
    free = {c: _free(c, need) for c in ("_n_words", "_spans", "_items", "_s0", "_i0")}
    n_words, spans, names, s0, i0 = (free[c] for c in free)
    blocks = item_blocks(items)
    out, block = None, next(blocks)
    while block is not None:
        following = next(blocks, None)
        keep = own if following is None else need
        if out is None:
            out = _marked(docs.select(*need), block, keep, (n_words, spans, names))
        else:
            # A further pass over the texts, whose findings are united with those of earlier passes; written, so that passes don't pile up.
            before = written(out.withColumnsRenamed({spans: s0, names: i0}).drop(n_words))
            out = _marked(before, block, [*keep, s0, i0], (n_words, spans, names))
            out = out.withColumns({spans: joined_spans(F.concat(s0, spans)), names: F.array_sort(F.array_union(i0, names))}).drop(s0, i0)
        block = following
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return out.select(*own, F.col(n_words).alias("n_words"), F.col(spans).alias("hit_spans"), n_hit.alias("n_hit"), F.col(names).alias("item_ids")).withColumn("contaminated", F.col("n_hit") > 0)


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = "_" + name
    return name
