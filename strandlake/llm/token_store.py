"""Token-ID output into a content-addressed store.

Each document's ids, closed by an end id, are one stream. A rolling hash over RUN ids cuts it where its low bits are zero, so equal
stretches of different documents give equal chunks; a stretch without a cut is cut after MAX_CHUNK ids. A chunk is addressed by
the BLAKE2b hash of its bytes (little-endian, two bytes an id where the vocabulary allows, else four).

The folder holds
  chunks/     hash, ids (binary), and where it stands: arrays of doc and place. One shuffle by hash brings equal chunks of
              different tasks together; only the first row of a hash keeps the ids, so unique chunks are stored once.
              Within a task equal chunks are joined before the shuffle, so a chunk of a third of all documents
              comes as one row from each map batch.
  recipes/    in ascending doc_id order: doc_id, part, place, start, n_tokens, chunk hashes, root (Merkle root over the chunk hashes).
  manifest/   a row for each recipe part: part, rows, tokens, root over the roots of its blocks of documents (starts, sizes, ids, roots).
  root/       one row: the store's own root, over the rows of the manifest and the bytes that an id takes; and those bytes.
Reading back takes the ids from the chunk files: their hashes are verified, and CRC-32s of the chunks are combined into
documents' by the recipes, so ids move no more than once. All roots are computed again: a document is intact if its chunks are there and
good, its own root and size are right, and so are those of its part and the store's root, with no part missing.
`reconstruct` gives the id streams themselves, unchecked.

Ids come from the tokenizers library. Byte-level BPE splits a text into pieces first and encodes each by itself, so a worker encodes
a piece by the library's model and keeps the ids of those met lately (twice CACHE_PIECES at most, none of a long piece); a text that holds a special
token, and any text under a vocabulary of another kind, is encoded whole.

Defined results: null text is the empty text (one id, the end); rows with equal doc_id are documents of their own, ordered
by their ids' hash; a null doc_id comes first; an empty table gives an empty store and result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation as MARKS

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import KEPT, Memory
from .token_count import byte_alphabet

END_ID = 0
#: Ids under the rolling hash, log2 of a chunk's mean length, and its greatest length.
RUN, CUT_BITS, MAX_CHUNK = 16, 8, 2048
CACHE_PIECES = 1 << 19
#: Documents whose roots are tied together in a manifest part's tree.
BLOCK = 1024
#: Ids that are cut and joined at once.
BATCH_IDS = 1 << 20
#: The split of GPT-2's byte-level BPE, as the library applies it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Marks a part of a text that no blank precedes, after a cut between a letter and a mark (or a line's end), or between a lone line's end and a letter.
CUT = "\x01"
AFTER_LETTER = re.compile(rf"[{re.escape(MARKS.replace('_', ''))}\n](?<=[^\W\d_].)", re.DOTALL)
LINE = re.compile(r"\n(?<=\S\n)(?=[^\W\d_])")


class Encoder:
    """Text to the bytes of its ids (two or four each)."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        how = parts.get("pre_tokenizer") or {}
        #: Whether pieces are encoded one by one; vocabularies of other kinds are applied to whole texts.
        self.by_piece = parts.get("normalizer") is None and how.get("type") == "ByteLevel" and not how.get("add_prefix_space") and how.get("use_regex", True)
        self.split = regex.compile(PIECES).findall
        self.alphabet = str.maketrans(dict(enumerate(byte_alphabet())))
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")  # as width
        self.pieces, self.met = Memory(self.piece, CACHE_PIECES >> 2), Memory(self.part, CACHE_PIECES)
        self.blank, self.code = byte_alphabet()[32], "H" if self.dtype.itemsize == 2 else "I"
        self.end = np.array([END_ID], self.dtype).tobytes()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
            KEPT["token_store"] = cls._of.clear
        return cls._of[path]

    @staticmethod
    def width(path: str) -> int:
        """Bytes an id takes, without an encoder that the driver would keep."""
        from tokenizers import Tokenizer

        return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def tokenized(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        elif piece[0] == " " and piece[1:].isalnum():
            piece = self.blank + piece[1:]
        else:
            piece = piece.translate(self.alphabet)
        return array(self.code, [t.id for t in self.library.model.tokenize(piece)]).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a piece; those of a blank and a word are kept in one place, however the text around them was cut."""
        return self.met[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else self.tokenized(piece)

    def stretch(self, text: str) -> bytes:
        """Ids of a text or of a part that the split cuts out of one."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def part(self, part: str) -> bytes | None:
        """Ids of a blank and a part of a text between blanks, or of what follows a CUT; None where the blank may belong to a run of white space."""
        if part.isalpha():
            return self.tokenized(" " + part)
        if part[:1] == CUT:
            return self.stretch(part[1:])
        return self.stretch(" " + part) if part and part.strip() == part else None

    def text(self, text: str) -> bytes:
        if not self.by_piece or any(s in text for s in self.special):
            return self.whole(text)
        if CUT in text:
            return self.stretch(text)
        # Where every blank stands alone, the split cuts before each one: the parts between are encoded once each. It also cuts between a letter
        # and a mark or a line's end, and between a lone line's end and a letter, so that a word is one part whatever stands around it.
        first, *rest = LINE.sub(f"\n {CUT}", AFTER_LETTER.sub(f" {CUT}\\g<0>", text)).split(" ")
        try:
            rest = b"".join(map(self.met.__getitem__, rest)) if first and not first[-1].isspace() or not rest else None
        except TypeError:  # a None among them
            rest = None
        return self.stretch(text) if rest is None else self.stretch(first) + rest

    def texts(self, texts: list[str | None]) -> list[bytes]:
        return [self.text(t or "") + self.end for t in texts]


_GEAR = np.random.default_rng(20).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


def cut_places(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Chunk ends in concatenated streams. starts: where each stream begins, and the total length at last."""
    # The hash of a run, each id's gear shifted by its distance from the end, by doubling the length of the run.
    h, run = _GEAR[ids & 0xFFFF], 1
    while run < RUN:
        longer = h.copy()
        longer[run:] += h[:-run] << np.uint64(run)
        h, run = longer, 2 * run
    h *= np.uint64(0x9E3779B97F4A7C15)
    ends = np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1
    of = np.searchsorted(starts, ends - 1, "right") - 1
    ends = np.union1d(ends[ends - starts[of] >= RUN], starts[1:])  # a run lies within its stream
    gaps = np.diff(ends, prepend=0)
    wide = np.flatnonzero(gaps > MAX_CHUNK)
    more = [np.arange(ends[k] - gaps[k] + MAX_CHUNK, ends[k], MAX_CHUNK) for k in wide]
    return np.union1d(ends, np.concatenate(more)) if more else ends


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(hashes: list[bytes]) -> bytes:
    level = list(hashes) or [b""]
    while len(level) > 1:
        level = [address(b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def crc_joined(crc: int, other: int, length: int, _shift: dict = {}) -> int:  # noqa: B006
    """CRC-32 of a + b from those of a and b and b's length in bytes: a's moves past b by appending powers of two of zero bytes."""
    k = 0
    while length >> k:
        if length >> k & 1:
            if k not in _shift:
                # What appending 2**k zero bytes does to each value of each byte of a CRC (it is linear).
                empty = zlib.crc32(bytes(1 << k), 0)
                _shift[k] = [[zlib.crc32(bytes(1 << k), v << at) ^ empty for v in range(256)] for at in (0, 8, 16, 24)]
            t = _shift[k]
            crc = t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]
        k += 1
    return crc ^ other


CHUNKS = "hash binary, ids binary, docs array<long>, keys array<binary>, places array<int>"


def _cut(docs: DataFrame, vocabulary: str) -> DataFrame:
    schema = StructType.fromDDL(CHUNKS)

    def groups(batches: Iterator[pa.RecordBatch], encoder: Encoder):
        ids, streams, size = [], [], 0
        for batch in batches:
            for a in range(0, len(batch), 256):
                ids += batch.column("doc_id")[a : a + 256].to_pylist()
                streams += (new := encoder.texts(batch.column("text")[a : a + 256].to_pylist()))
                size += sum(map(len, new)) // encoder.dtype.itemsize
                if size >= BATCH_IDS:
                    yield ids, streams
                    ids, streams, size = [], [], 0
        if ids:
            yield ids, streams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(vocabulary)
        width = encoder.dtype.itemsize
        for ids, streams in groups(batches, encoder):
            data = b"".join(streams)
            starts = np.concatenate([[0], np.cumsum([len(x) // width for x in streams], dtype=np.int64)])
            ends = cut_places(np.frombuffer(data, encoder.dtype).astype(np.int64), starts)
            of = np.searchsorted(starts, ends - 1, "right") - 1
            first = np.searchsorted(of, np.arange(len(ids)))
            own = [address(x)[:8] for x in streams]
            rows: dict[bytes, tuple] = {}
            begin = 0
            for k, (end, doc) in enumerate(zip(ends.tolist(), of.tolist(), strict=True)):
                chunk = data[begin * width : end * width]
                row = rows.setdefault(chunk, ([], [], []))
                row[0].append(ids[doc])
                row[1].append(own[doc])
                row[2].append(k - int(first[doc]))
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([address(c) for c in rows], list(rows), *([r[i] for r in rows.values()] for i in range(3))), to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def write_store(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Writes docs (doc_id, text) into a new store at path."""
    spark, width = docs.sparkSession, Encoder.width(vocabulary)
    first = F.row_number().over(Window.partitionBy("hash").orderBy(F.col("docs")[0], F.col("places")[0])) == 1
    chunks = _cut(docs, vocabulary).withColumn("ids", F.when(first, F.col("ids")))
    chunks.withColumn("n", F.length("ids") / width).withColumn("n", F.col("n").cast("int")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks")
    sizes = stored.where("ids is not null").select("hash", "n")
    places = stored.select("hash", F.explode(F.arrays_zip("docs", "keys", "places")).alias("x")).select("hash", "x.docs", "x.keys", "x.places")
    listed = places.join(sizes, "hash").groupBy(F.col("docs").alias("doc_id"), F.col("keys").alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col("places").alias("place"), "hash", "n"))).alias("c"))
    # Equal documents of one id (same id and key) hold each place several times: one recipe for each.
    listed = listed.withColumn("copies", F.size(F.filter("c", lambda x: x["place"] == 0))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    every = F.filter("c", lambda x, i: (i % F.col("copies")) == (F.col("copy") - 1))
    recipes = listed.select("doc_id", "key", every.alias("c")).select("doc_id", "key", F.transform("c", lambda x: x["hash"]).alias("chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"))
    ordered = recipes.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")

    schema = StructType.fromDDL("doc_id long, part int, place long, start long, n_tokens long, chunks array<binary>, root binary")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, place, part = 0, 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            ends = at + np.cumsum(n)
            roots = [merkle(x) for x in b.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(place, place + len(n))), pa.array(ends - n), b.column("n_tokens").cast(pa.int64()), b.column("chunks").cast(pa.list_(pa.binary())), pa.array(roots, pa.binary())], names=schema.fieldNames())
            place += len(n)
            at = int(ends[-1]) if len(n) else at

    ordered.mapInArrow(numbered, schema).write.option("compression", "zstd").parquet(f"{path}/recipes")
    part_sums(spark.read.parquet(f"{path}/recipes")).coalesce(1).write.parquet(f"{path}/manifest")
    store_root(spark.read.parquet(f"{path}/manifest"), width).write.parquet(f"{path}/root")


def tied(rows: DataFrame, by: list[str], order: str, line: Column) -> DataFrame:
    """A row for each group: by, and the hash of its rows' lines in order (root)."""
    lines = F.sort_array(F.collect_list(F.struct(order, line.alias("line"))))
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ","), 256).alias("root"))


def part_sums(recipes: DataFrame) -> DataFrame:
    """A row for each part: part, rows, tokens, root. The root ties the roots of blocks of BLOCK documents, so no list grows with the corpus but that of a part's blocks."""
    leaf = F.concat_ws(":", "place", "start", "n_tokens", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("root"))
    blocks = tied(recipes.withColumn("block", F.floor(F.col("place") / BLOCK)), ["part", "block"], "place", leaf)
    sums = recipes.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    return sums.join(tied(blocks, ["part"], "block", F.col("root")), "part")


def store_root(manifest: DataFrame, width: int) -> DataFrame:
    """One row: root, width (bytes an id)."""
    lines = F.sort_array(F.collect_list(F.struct("part", F.concat_ws(":", "part", "rows", "tokens", "root").alias("line"))))  # a row for each part
    return manifest.agg(F.sha2(F.concat_ws(";", F.lit(str(width)), F.array_join(F.transform(lines, lambda x: x["line"]), ",")), 256).alias("root"), F.lit(width).alias("width"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 (of four-byte little-endian ids), whether hashes, sizes and roots verify (intact); null for a CRC whose chunks are not all there."""
    known = spark.read.parquet(f"{path}/root").first()
    if known is None:
        raise ValueError(f"'{path}' is no store: it has no root")
    width = known["width"]
    schema = StructType.fromDDL("hash binary, crc long, size long, good boolean")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<u2") if width == 2 else np.dtype("<u4")
        for b in batches:
            ids = b.column("ids").to_pylist()
            wide = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in ids]
            good = [address(x) == h for x, h in zip(ids, b.column("hash").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("hash").cast(pa.binary()), pa.array([zlib.crc32(x) for x in wide], pa.int64()), pa.array([len(x) for x in wide], pa.int64()), pa.array(good, pa.bool_())], names=["hash", "crc", "size", "good"])

    chunks = spark.read.parquet(f"{path}/chunks").where("ids is not null").select("hash", "ids").mapInArrow(summed, schema)
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    sound = known["root"] == store_root(manifest, width).first()["root"]
    found = part_sums(recipes).withColumnsRenamed({c: f"own_{c}" for c in ("rows", "tokens", "root")})
    same = (F.col("rows") == F.col("own_rows")) & (F.col("tokens") == F.col("own_tokens")) & (F.col("root") == F.col("own_root"))
    complete = F.min(F.col("rows").isNotNull() & F.col("own_rows").isNotNull()).over(Window.partitionBy())
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = manifest.join(found, "part", "full_outer").select("part", before.alias("before"), (F.coalesce(same, F.lit(False)) & complete & F.lit(sound)).alias("checked"))  # a row for each part

    rooted = StructType.fromDDL("doc_id long, part int, start long, n_tokens long, chunks array<binary>, rooted boolean")

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [merkle(x or []) == r for x, r in zip(b.column("chunks").to_pylist(), b.column("root").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rooted.fieldNames()[:4]), b.column("chunks").cast(pa.list_(pa.binary())), pa.array(good, pa.bool_())], names=rooted.fieldNames())

    keyed = recipes.select("doc_id", "part", "start", "n_tokens", "chunks", "root").mapInArrow(proved, rooted).select("part", "start", "n_tokens", "doc_id", "rooted", F.posexplode_outer("chunks").alias("place", "hash"))
    rows = keyed.join(chunks, "hash", "left").groupBy("part", "start", "doc_id", "n_tokens", "rooted").agg(F.sort_array(F.collect_list(F.struct("place", "crc", "size", "good"))).alias("c"))
    out = StructType.fromDDL("doc_id long, part int, start long, n_tokens long, ids_crc32 long, intact boolean")

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column("c")
            ends = c.offsets.to_numpy()
            crc, size, good = (c.values.field(f).to_pylist() for f in ("crc", "size", "good"))
            crcs, intact = [], []
            for n, root, i, j in zip(b.column("n_tokens").to_pylist(), b.column("rooted").to_pylist(), ends, ends[1:], strict=False):
                if None in crc[i:j]:
                    crcs.append(None)
                    intact.append(False)
                    continue
                own = crc[i]
                for k in range(i + 1, j):
                    own = crc_joined(own, crc[k], size[k])
                crcs.append(own)
                intact.append(root and all(good[i:j]) and sum(size[i:j]) == 4 * n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array(intact, pa.bool_())], names=out.fieldNames())

    read = rows.select("doc_id", "part", "start", "n_tokens", "rooted", "c").mapInArrow(combined, out)
    return read.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", (F.col("intact") & F.col("checked")).alias("intact"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (the bytes of the whole stream), joined from the chunks."""
    chunks = spark.read.parquet(f"{path}/chunks").where("ids is not null").select("hash", "ids")
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "start", "doc_id", F.posexplode("chunks").alias("place", "hash"))
    joined = recipes.join(chunks, "hash").groupBy("part", "start", "doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("c"))
    return joined.select("doc_id", F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
