"""Encoding texts with a byte-level BPE vocabulary by a tokenization automaton."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the public pattern that splits a text into words before any merge.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = 1 << 40
CACHED_WORDS, CACHED_LENGTH = 300_000, 200


def _byte_letters() -> dict[str, int]:
    """The letter by which vocabulary files write each byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Deterministic automaton whose arcs are tokens and whose paths are the BPE encodings.

    It starts as one state with an arc for each byte. Each merge (a, b), in order, applies a
    gadget: wherever arc a is followed by arc b, the pair is replaced by an arc ab. The
    state behind ab takes over what may follow b; ab may follow whatever a may follow; and b
    is cut off from the state behind a. A state is thus known by the arc that leads to it,
    and merge number r cuts arc t from state s exactly when, after the merges before r, s
    ends in a and t begins with b. What s ends in over time are its right parts (s, its
    right half, the right half of that, ..) with the number of the merge that used each up;
    what t begins with likewise its left parts. Those two lists are the compiled form of all
    gadgets; an entry of the transition table is read off them when first reached and kept.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list):
        letters = _byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        self.label = {i: to_bytes(t) for t, i in vocabulary.items() if all(c in letters for c in t)}
        single = [vocabulary[c] for c in letters]
        self.right: dict[int, tuple] = {i: ((i, NEVER),) for i in single}
        self.left: dict[int, tuple] = {i: ((i, NEVER),) for i in single}
        self.rank: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(merges):
            x, y = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            a, b, ab = vocabulary[x], vocabulary[y], vocabulary[x + y]
            if (a, b) in self.rank:
                continue
            self.rank[a, b] = r
            if ab not in self.right and a in self.left and b in self.right and not self._cut(a, b, r):
                self.right[ab] = ((ab, NEVER), (b, r), *self.right[b][1:])
                self.left[ab] = ((ab, NEVER), (a, r), *self.left[a][1:])
        self.root: list = [{}, -1]  # trie of the arcs that exist: [next by byte, token]
        for token in self.left:
            node = self.root
            for byte in self.label[token]:
                node = node[0].setdefault(byte, [{}, -1])
            node[1] = token
        self.table: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT).findall

    def _cut(self, s: int, t: int, before: int = NEVER) -> bool:
        """Whether a merge numbered below before cuts arc t from state s. Of two overlapping places the left one merges first."""
        rank = self.rank
        return any(r < gone and r <= used and r < before for x, gone in self.right[s] for y, used in self.left[t] if (r := rank.get((x, y), NEVER)) < NEVER)

    def _path(self, word: bytes) -> tuple[int, ...]:
        """Labels of the only path that spells word; last[i] is the arc by which it would end at i."""
        n, table = len(word), self.table
        last, came = [-1] * (n + 1), [0] * (n + 1)
        for j in range(n):
            state = last[j]
            if j and state < 0:
                continue
            node, i = self.root, j
            while i < n and (node := node[0].get(word[i])):
                i += 1
                token = node[1]
                if token < 0 or last[i] >= 0:
                    continue
                if j:
                    key = state << 20 | token
                    fine = table.get(key)
                    if fine is None:
                        if len(table) > 4_000_000:
                            table.clear()
                        fine = table[key] = not self._cut(state, token)
                    if not fine:
                        continue
                last[i], came[i] = token, j
        labels, i = [], n
        while i:
            labels.append(last[i])
            i = came[i]
        return tuple(labels[::-1])

    def word(self, word: str) -> tuple[int, ...]:
        ids = self._path(word.encode())
        if len(word) <= CACHED_LENGTH:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """The ids of text, word by word."""
        known, own = self.words.get, self.word
        return [known(w) or own(w) for w in self.split(text)]


_compiled: dict[str, Automaton] = {}


def _automaton(source: str) -> Automaton:
    """Compiled once in each Python worker."""
    if source not in _compiled:
        model = json.loads(source)
        _compiled.clear()
        _compiled[source] = Automaton(model["vocab"], model["merges"])
    return _compiled[source]


def load_vocabulary(spark: SparkSession, path: str):
    """Broadcast the vocabulary and merges of a tokenizer file (about 1.5 MB, a fixed size)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return spark.sparkContext.broadcast(json.dumps({"vocab": model["vocab"], "merges": model["merges"]}))


def encode_texts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids ARRAY<INT>): the ids of each text by the byte-level BPE file at path.

    No special tokens are added, and text that looks like one is ordinary text. A null or
    empty text gives an empty list. One row comes out for each row of df, repeated ones
    too; other columns are ignored. Texts are encoded whole, whatever their length: a word
    costs time in proportion to its length, so a run without blanks does no harm. There is
    no shuffle.
    """
    source = load_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(source.value)
        for batch in batches:
            ids, offsets = array("i"), [0]
            for value in batch.column(1).to_pylist():
                if value:
                    ids.extend(chain.from_iterable(machine.encode(value)))
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    shape = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(doc_id), F.col(text)).mapInArrow(run, shape)


def count_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens INT): as encode_texts, but only how many ids; 0 for null and empty texts."""
    source = load_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(source.value)
        for batch in batches:
            sizes = [sum(map(len, machine.encode(value))) if value else 0 for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["doc_id", "n_tokens"])

    shape = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n_tokens", T.IntegerType())])
    return df.select(F.col(doc_id), F.col(text)).mapInArrow(run, shape)


def decode_ids(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): the labels of the arcs joined; null for null ids, bytes that aren't UTF-8 replaced."""
    source = load_vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _automaton(source.value).label
        for batch in batches:
            texts = [None if v is None else b"".join(label[i] for i in v).decode("utf-8", "replace") for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    shape = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("text", T.StringType())])
    return df.select(F.col(doc_id), F.col(ids)).mapInArrow(run, shape)
