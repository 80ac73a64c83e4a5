"""Token counts by greedy longest match, in time linear in the text.

The vocabulary's pieces form a trie. Each node has a failure link, and the number of pieces that are popped on following it:
the pieces of the greedy segmentation of the node's own string that are certain once no longer match goes on. Walking a word
byte by byte along trie edges and failure links, adding the popped counts, gives the number of pieces the greedy segmentation
has, without building any piece.

A word is white-space delimited; its string is the mark of a word's start followed by its UTF-8 bytes, in the byte alphabet of
the vocabulary file. Every single byte and the mark are pieces there, so every word has a segmentation; with a vocabulary that
lacks some, a word that can't be segmented counts as one unknown piece.

Documents pass through one map over Arrow batches. A worker keeps the automaton, and the counts of words it has met lately (twice
CACHE_WORDS at most, none of a long word), so its memory is bounded in bytes.

Defined results: null or blank text has 0 words and 0 pieces; ids may be null or repeat, each row is counted by itself; an empty
table gives an empty result; extra columns are carried along unchanged unless they clash with the new ones, which take their place.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Memory

CACHE_WORDS = 1 << 16


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else a code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else n))
        n += b not in plain
    return out


class Automaton:
    """Trie with failure links and popped-piece counts over byte strings."""

    def __init__(self, pieces: Iterable[bytes], start: bytes = b""):
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node; the root is 0
        piece = [False]
        for p in sorted({p for p in pieces if p}):
            node = 0
            for b in p:
                node = self.edges.setdefault(node << 8 | b, len(piece))
                if node == len(piece):
                    piece.append(False)
            piece[node] = True
        self.start = start
        #: Where to go on after no edge fits, or -1, and how many pieces that pops.
        self.fail, self.pops = [-1] * len(piece), [0] * len(piece)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.edges.items():
            below.setdefault(key >> 8, []).append((key & 255, child))
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, child in below.get(node, ()):
                queue.append(child)
                if piece[child]:
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                back, popped = self.fail[node], self.pops[node]
                while back >= 0 and (back << 8 | b) not in self.edges:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[child], self.pops[child] = self.edges[back << 8 | b], popped

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match segmentation of start + word; 1 if there is none; 0 for no bytes."""
        node, n, edges, fail, pops = 0, 0, self.edges, self.fail, self.pops
        for b in self.start + word:
            while (to := edges.get(node << 8 | b)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def load(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file (JSON, model.vocab), whose mark of a word's start is the blank."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    back = {c: b for b, c in enumerate(byte_alphabet())}
    special = {x["content"] for x in content.get("added_tokens", ())}
    return Automaton((bytes(back[c] for c in p) for p in content["model"]["vocab"] if p not in special), b" ")


class Counter:
    """Counts with a bounded memory of words met before."""

    _of: dict[str, Counter] = {}

    def __init__(self, automaton: Automaton, limit: int = CACHE_WORDS):
        self.automaton, self.met = automaton, Memory(automaton.count, limit)

    @classmethod
    def at(cls, path: str) -> Counter:
        if path not in cls._of:
            cls._of[path] = cls(load(path))
        return cls._of[path]

    def text(self, text: str | None) -> tuple[int, int]:
        words = (text or "").encode().split()  # bytes.split cuts at the six ASCII white-space bytes
        return len(words), sum(map(self.met.__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: str, carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in carry) with n_words and n_pieces (long). vocabulary: path of the file on every machine."""
    carry = [c for c in carry or docs.columns if c not in ("n_words", "n_pieces")]
    need = list(dict.fromkeys([*carry, "text"]))
    schema = StructType([*(docs.schema[c] for c in carry), *StructType.fromDDL("n_words long, n_pieces long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, counter = to_arrow_schema(schema), Counter.at(vocabulary)
        for batch in batches:
            counts = [counter.text(t.as_py()) for t in batch.column("text")]
            old = [batch.column(c).cast(arrow.field(c).type) for c in carry]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array([x[i] for x in counts], pa.int64()) for i in (0, 1))], schema=arrow)

    return docs.select(*need).mapInArrow(run, schema)
