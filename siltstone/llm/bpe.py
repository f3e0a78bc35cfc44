"""Byte-level BPE by monoid tree reduction.

A text's encoding is a monoid element: halves are encoded recursively down to
leaves, and neighbours are joined by encoding a window around their seam
again. The window grows, twice as wide each time, until it begins and ends at
a place where a character that is no white space is followed by a space or
line break. The splitting pattern never puts such a pair into one piece, and
what comes before it neither looks at nor changes what comes after, so tokens
outside the window are those of the whole text: the result is exactly that of
encoding the text at once. Where a side has no such place, the window takes
the whole side. Decoding concatenates the bytes of halves up the tree.

Null texts have null tokens, empty ones none. Texts of any length and repeated
rows are encoded alike and whole; an empty table gives an empty result. Other
columns are ignored. Token ids outside the vocabulary decode to null, bytes
that are no UTF-8 to replacement characters.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import ID, TEXT, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, SEAM = 4096, 32
_SAFE = re.compile(r"(?<=\S)[ \n]")
_LOADED: dict[int, "Codec"] = {}


class Codec:
    """Encodes and decodes with one vocabulary of ranks."""

    def __init__(self, ranks: bytes, leaf: int = LEAF, seam: int = SEAM) -> None:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.leaf, self.seam = leaf, seam
        self.direct = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes = [b""] * (max(table.values()) + 1)
        for b, i in table.items():
            self.bytes[i] = b
        self.known = {i for i in table.values()}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, stop: int) -> list[int]:
        if stop - start <= self.leaf:
            return self.direct.encode_ordinary(text[start:stop])
        middle = (start + stop) // 2
        return self.join(text, start, middle, stop, self._encode(text, start, middle), self._encode(text, middle, stop))

    def join(self, text: str, start: int, middle: int, stop: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[start:stop] from those of its two parts."""
        a, wide = start, self.seam
        while middle - wide > start:
            # a place is safe if its character before lies in the left part too
            found = [m.start() for m in _SAFE.finditer(text, middle - wide, middle) if m.start() > start]
            if found:
                a = found[-1]
                break
            wide *= 2
        b, wide = stop, self.seam
        while True:
            m = _SAFE.search(text, middle + 1, min(middle + wide, stop))
            if m:
                b = m.start()
                break
            if middle + wide >= stop:
                break
            wide *= 2
        keep = len(left) - self._tokens_of(left, len(text[a:middle].encode()), True)
        skip = self._tokens_of(right, len(text[middle:b].encode()), False)
        return left[:keep] + self.direct.encode_ordinary(text[a:b]) + right[skip:]

    def _tokens_of(self, tokens: list[int], size: int, backwards: bool) -> int:
        """How many tokens at one end make up so many bytes."""
        n = 0
        for t in reversed(tokens) if backwards else tokens:
            if size <= 0:
                break
            size -= len(self.bytes[t])
            n += 1
        assert size == 0, "a window has to end between tokens"
        return n

    def decode(self, tokens: list[int]) -> bytes:
        if len(tokens) <= self.leaf:
            return b"".join([self.bytes[t] for t in tokens])
        middle = len(tokens) // 2
        return self.decode(tokens[:middle]) + self.decode(tokens[middle:])


def codec(ranks: bytes) -> Codec:
    """The codec of a vocabulary file's content, made once a process."""
    key = hash(ranks)
    if key not in _LOADED:
        _LOADED[key] = Codec(ranks)
    return _LOADED[key]


def ranks_of(vocabulary: str = VOCABULARY) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, n_tokens, tokens, exact) of every row; exact: the tokens decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks_of(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column(1).to_pylist()
                tokens = [None if t is None else c.encode(t) for t in texts]
                exact = [None if t is None else c.decode(k) == t.encode() for t, k in zip(texts, tokens)]
                sizes = np.array([0 if k is None else len(k) for k in tokens])
                flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(np.array(k, np.int32) for k in tokens if k)]), pa.int32())
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                missing = np.array([k is None for k in tokens] + [False])
                lists = pa.ListArray.from_arrays(pa.array(ends, mask=missing), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32(), mask=missing[:-1]), lists, pa.array(exact, pa.bool_())], names=["doc_id", "n_tokens", "tokens", "exact"])

    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    return small_batches(docs).select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = ID, tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) of every row of tokens."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks_of(vocabulary))

    def text_of(c: Codec, tokens: list[int] | None) -> str | None:
        if tokens is None or any(t not in c.known for t in tokens):
            return None
        return c.decode(tokens).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(c, k) for k in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    out = T.StructType([T.StructField("doc_id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return small_batches(encoded).select(encoded[id_col].alias("i"), F.col(tokens_col).cast("array<int>").alias("k")).mapInArrow(run, out)
