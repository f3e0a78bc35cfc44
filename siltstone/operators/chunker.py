"""Overlapping chunks that end at preferred boundaries."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "document_id string, filename string, chunk_index int, start_char int, end_char int, text string"


@dataclass(frozen=True)
class ChunkConfig:
    """size and overlap in characters; parity keeps windows that crawl forward by one character before a far boundary."""

    size: int = 500
    overlap: int = 50
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")
    parity: bool = True

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("size has to be positive, and overlap less than it and not negative")


def boundaries(text: str, config: ChunkConfig) -> list[int]:
    """Ascending ends of the spans that the separators leave; spans longer than a chunk are cut by the next separator."""
    ends: list[int] = []
    stack = [(0, len(text), 0)]
    while stack:
        a, b, level = stack.pop()
        if b - a <= config.size:
            ends.append(b)
            continue
        if level >= len(config.separators):
            ends += [*range(a + config.size, b, config.size), b]
            continue
        mark = config.separators[level]
        if not mark:
            ends += range(a + 1, b + 1)
            continue
        cuts, at = [], a
        while (hit := text.find(mark, at, b)) >= 0:
            at = hit + len(mark)
            cuts.append(at)
        if not cuts or cuts[-1] < b:
            cuts.append(b)
        if len(cuts) == 1:
            stack.append((a, b, level + 1))
        else:
            stack += [(x, y, level + 1) for x, y in zip([a, *cuts], cuts)][::-1]
    return ends


def windows(text: str, config: ChunkConfig) -> Iterator[tuple[int, int, int]]:
    """(index, start, end) of the chunks, white space at their ends left out."""
    if not text:
        return
    ends, start, index = boundaries(text, config), 0, 0
    while True:
        limit = start + config.size
        k = bisect_right(ends, limit) - 1
        end = ends[k] if k >= 0 and ends[k] > start else min(limit, len(text))
        body = text[start:end]
        kept = body.strip()
        if kept:
            lead = len(body) - len(body.lstrip())
            yield index, start + lead, start + lead + len(kept)
            index += 1
        if end >= len(text):
            return
        nxt = end - config.overlap
        start = max(nxt, start + 1) if config.parity else (nxt if nxt > start else end)


def chunk(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of docs (document_id, filename, text), with a chunk_id that is the same on every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows = []
                for doc, name, text in zip(*(whole.slice(at, 500).column(i).to_pylist() for i in range(3))):
                    rows += [(doc, name, i, a, b, text[a:b]) for i, a, b in windows(text or "", config)]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=["document_id", "filename", "chunk_index", "start_char", "end_char", "text"])

    out = docs.select(F.col("document_id").cast("string"), "filename", "text").mapInArrow(run, SCHEMA)
    return out.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.coalesce("document_id", F.lit("")), "chunk_index"), 256))
