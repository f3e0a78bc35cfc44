"""Vectors for chunks through a pluggable embedder."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import classified

Embedder = Callable[[list[str]], list[list[float]]]
BATCH, ATTEMPTS = 100, 2


class EmbeddingError(RuntimeError):
    """No chunk has a vector."""


def hashed_bigrams(texts: list[str], dims: int = 1024) -> list[list[float]]:
    """Counts of hashed word pairs at unit length; a single word counts as itself. Needs no network."""
    out = np.zeros((len(texts), dims))
    for i, text in enumerate(texts):
        words = text.lower().split()
        for pair in zip(words, words[1:]) if len(words) > 1 else [tuple(words)]:
            out[i, zlib.crc32(" ".join(pair).encode()) % dims] += 1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def embed(chunks: DataFrame, embedder: Embedder = hashed_bigrams, batch: int = BATCH, attempts: int = ATTEMPTS) -> DataFrame:
    """chunks with embedding filled where it is null, and embedding_error where every attempt failed."""
    have = "embedding" in chunks.columns
    base = chunks if have else chunks.withColumn("embedding", F.lit(None).cast("array<double>"))
    text, vector = base.columns.index("text"), base.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors, texts = part.column(vector).to_pylist(), part.column(text).to_pylist()
                errors: list[str | None] = [None] * len(texts)
                todo = [i for i, v in enumerate(vectors) if v is None]
                for attempt in range(attempts if todo else 0):
                    try:
                        for i, v in zip(todo, embedder([texts[i] or "" for i in todo])):
                            vectors[i], errors[i] = [float(x) for x in v], None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of the service is a row's error
                        for i in todo:
                            errors[i] = f"{type(classified(e)).__name__}: {classified(e)}"
                cols = [pa.array(vectors, pa.list_(pa.float64())) if i == vector else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(errors, pa.string())], names=[*part.schema.names, "embedding_error"])

    return base.mapInArrow(run, T.StructType([*base.schema, T.StructField("embedding_error", T.StringType())]))


def require_vectors(chunks: DataFrame) -> DataFrame:
    """The chunks that have a vector; an error when there are chunks and none has."""
    kept = chunks.where("embedding IS NOT NULL")
    if kept.isEmpty() and not chunks.isEmpty():
        raise EmbeddingError("no chunk could be embedded")
    return kept


def failed_batches(chunks: DataFrame) -> DataFrame:
    """(embedding_error, chunk_count) of what could not be embedded."""
    return chunks.where("embedding_error IS NOT NULL").groupBy("embedding_error").agg(F.count("*").alias("chunk_count"))
