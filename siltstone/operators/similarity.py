"""Cosine similarity joins, computed once in blocks and filtered for every use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import PAGES, byte_batches, materialise

EXACT, NEAR, BLOCK = 0.98, 0.85, 4096
_PARTS, _STRIP = 4, 1 << 20
BAND = (0.70, 0.95)
PAIRS = "left_id string, right_id string, score double, scope string"


def checked(chunks: DataFrame) -> DataFrame:
    """chunks, or an error for vectors of several lengths or of no length."""
    r = chunks.agg(F.count_distinct(F.size("embedding")).alias("sizes"), F.min(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("least")).first()
    if r["sizes"] > 1:
        raise ValueError("embeddings have different dimensions")
    if r["least"] is not None and r["least"] <= 0:
        raise ValueError("an embedding is the zero vector")
    return chunks


def _written(chunks: DataFrame, rows: int) -> DataFrame:
    """(chunk, is_new, ids, wide, vectors): up to so many rows of a side in each, vectors of length one; as float32 where that loses nothing, which halves what is written."""
    parts = max(-(-chunks.count() // (_PARTS * rows)), 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}

        def flush(side: bool) -> pa.RecordBatch:
            t = pa.Table.from_batches(held[side]).combine_chunks()
            ids, vectors = t["chunk_id"].combine_chunks(), t["embedding"].combine_chunks()
            v = vectors.flatten().to_numpy(zero_copy_only=False)
            less = v.astype(np.float32)
            wide = not np.array_equal(less.astype(np.float64), v)
            held[side].clear()
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([side]), lists, pa.array([wide]), pa.array([(v if wide else less).tobytes()], pa.binary())], names=["is_new", "ids", "wide", "vectors"])

        for whole in batches:
            for side in (True, False):
                b = whole.filter(pc.equal(whole.column(2), side)).select([0, 1])
                while b.num_rows:
                    part = b.slice(0, rows - sum(x.num_rows for x in held[side]))
                    held[side].append(part)
                    b = b.slice(part.num_rows)
                    if sum(x.num_rows for x in held[side]) == rows:
                        yield flush(side)
        for side in (True, False):
            if held[side]:
                yield flush(side)

    rows_in = chunks.select(F.col("chunk_id").cast("string"), F.col("embedding").cast("array<double>"), F.coalesce(F.col("side") == "new", F.lit(False)).alias("is_new"))
    few = rows_in.repartition(parts, "chunk_id").mapInArrow(cut, "is_new boolean, ids array<string>, wide boolean, vectors binary")
    return materialise(few.withColumn("chunk", F.monotonically_increasing_id()), "similarity-chunks", **PAGES)


def scores(chunks: DataFrame, floor: float, block: int = BLOCK) -> DataFrame:
    """(left_id, right_id, score, scope) of the pairs of chunks (chunk_id, side, embedding) with a cosine of floor at least.

    side is 'new' or 'existing'. Pairs within the new side come once, the
    lesser id left; pairs of a new and an existing chunk have the new one
    left; existing chunks are not compared with each other. Vectors are written
    once, in lots of half a block, and every two lots that have to meet do so in
    a task that reads them, a strip of their matrix at a time: no vector is
    shuffled more than once, and no row is compared twice. The result is worked
    out whenever it is read; where it is read several times, write it first.
    """
    if not 0 <= floor <= 1:
        raise ValueError("a similarity threshold lies between 0 and 1")
    few = _written(chunks, max(block // 2, 1))
    one, two = (few.select(*(F.col(c).alias(f"{c}{i}") for c in ("chunk", "is_new", "ids", "wide", "vectors"))) for i in (1, 2))
    # of two lots of new rows one order only, which falls evenly on the two tasks in which they stand together
    turn = F.when((F.col("chunk1") + F.col("chunk2")) % 2 == 0, F.col("chunk1") <= F.col("chunk2")).otherwise(F.col("chunk1") > F.col("chunk2"))
    pairs = one.where("is_new1").join(two.hint("shuffle_replicate_nl"), ~F.col("is_new2") | turn)

    def unit(ids: pa.ListScalar, wide: bool, data: bytes) -> np.ndarray:
        v = np.frombuffer(data, np.float64 if wide else np.float32).astype(np.float64).reshape(len(ids), -1)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                chunk1, _, ids1, wide1, data1, chunk2, new, ids2, wide2, data2 = (c[r] for c in batch.columns)
                if chunk1.as_py() != last:
                    last, a = chunk1.as_py(), unit(ids1, wide1.as_py(), data1.as_py())
                same = last == chunk2.as_py()
                b = a if same else unit(ids2, wide2.as_py(), data2.as_py())
                step = max(_STRIP // len(b), 1)
                for at in range(0, len(a), step):
                    s = a[at : at + step] @ b.T
                    x, y = np.nonzero(s >= floor - 1e-12)
                    score = s[x, y]
                    left, right = ids1.values.take(pa.array(x + at)), ids2.values.take(pa.array(y))
                    if new.as_py():
                        less = pc.less(left, right).to_numpy(zero_copy_only=False)
                        keep = pa.array(less if same else less | pc.greater(left, right).to_numpy(zero_copy_only=False))
                        left, right, score, less = left.filter(keep), right.filter(keep), pa.array(score).filter(keep), pa.array(less).filter(keep)
                        left, right = pc.if_else(less, left, right), pc.if_else(less, right, left)
                    yield pa.RecordBatch.from_arrays([left, right, pa.array(score), pa.array([f"new_vs_{'new' if new.as_py() else 'existing'}"] * len(left), pa.string())], names=["left_id", "right_id", "score", "scope"])

    return byte_batches(pairs).mapInArrow(multiply, PAIRS)


def severity(score: Column | str, exact: float = EXACT) -> Column:
    return F.when(F.col(score) >= exact, "exact").otherwise("near_duplicate") if isinstance(score, str) else F.when(score >= exact, "exact").otherwise("near_duplicate")


def similar(pairs: DataFrame, exact: float = EXACT, near: float = NEAR) -> DataFrame:
    """The pairs of near at least, with their severity; both bounds belong to the higher class."""
    if not 0 <= near <= exact <= 1:
        raise ValueError("thresholds have to be 0 <= near <= exact <= 1")
    return pairs.where(F.col("score") >= near).withColumn("severity", severity("score", exact))


def in_band(pairs: DataFrame, low: float = BAND[0], high: float = BAND[1]) -> DataFrame:
    """The pairs between low and high, both included."""
    if not 0 <= low <= high <= 1:
        raise ValueError("a band has to be 0 <= low <= high <= 1")
    return pairs.where(F.col("score").between(low, high)).withColumn("severity", F.lit("candidate"))


def cross_document(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pairs whose chunks are of different documents by id and by name; blank ids and names match nothing."""
    info = chunks.select("chunk_id", F.nullif(F.btrim(F.col("document_id")), F.lit("")).alias("d"), F.nullif(F.btrim(F.lower("filename")), F.lit("")).alias("f"))
    two = pairs.join(info.toDF("left_id", "ld", "lf"), "left_id").join(info.toDF("right_id", "rd", "rf"), "right_id")
    same = F.coalesce(F.col("ld") == F.col("rd"), F.lit(False)) | F.coalesce(F.col("lf") == F.col("rf"), F.lit(False))
    return two.where(~same).select(*pairs.columns)
