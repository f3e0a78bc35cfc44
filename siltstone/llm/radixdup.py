"""Exact duplicates by distributed MSD radix partitioning.

Equality never rests on a digest. The space of texts is split into ranges by
their leading bytes: a prefix that holds too many bytes of text is split again
by its next bytes, of doubling number, until every range is small or its texts
have ended. The first 64 bytes of all texts are written once and counted there;
only prefixes that are longer are counted in the texts. At most 4000 ranges are
named; where that makes them larger than ``range_bytes``, each is dealt into as
many parts as it needs by a checksum, which decides where texts meet and not
whether they are equal. Batches first collapse their own copies, so that a
text with very many copies crosses the network once a batch at most; parts
are then refined byte by byte until each group is a singleton or has ended.

Null texts equal nothing. Empty texts equal each other. A null id is greater
than any other. Of rows that repeat an id and a text one is kept, whichever
other columns it has. Very long texts are compared to their end. An empty
table gives an empty result; columns of any name are carried along.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.lineage import materialise

from .rows import ID, TEXT, small_batches
from .textvec import utf8

RANGE_BYTES, MOST_RANGES, _HEAD = 16 << 20, 4000, 64


def equal_groups(texts: pa.Array) -> np.ndarray:
    """For each row the first row of the same text; null texts are their own."""
    buf, off = utf8(texts)
    start, length = off[:-1], np.diff(off)
    label = np.arange(len(length))
    rows = np.flatnonzero(np.asarray(pc.is_valid(texts))) if len(length) else label
    group = np.zeros(len(rows), dtype=np.int64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    for depth in range(0, 64, 8):
        if len(rows) < 2:
            return label
        left = np.minimum(length[rows] - depth, 8)
        digit = np.ascontiguousarray(padded[(start[rows] + depth)[:, None] + np.arange(8)])
        digit[np.arange(8)[None, :] >= left[:, None]] = 0
        word = digit.view(np.uint64).ravel()
        order = np.lexsort((rows, left, word, group))
        same = np.zeros(len(rows), dtype=bool)
        same[1:] = (group[order][1:] == group[order][:-1]) & (word[order][1:] == word[order][:-1]) & (left[order][1:] == left[order][:-1])
        name = np.cumsum(~same) - 1
        size = np.bincount(name)
        first = rows[order][np.flatnonzero(~same)]
        ended = left[order] < 8
        label[rows[order][ended]] = first[name[ended]]
        on = ~ended & (size[name] > 1)
        rows, group = rows[order][on], name[on]
    groups: dict[int, list[int]] = {}
    for r, g in zip(rows.tolist(), group.tolist()):
        groups.setdefault(g, []).append(r)
    todo, depth, width = list(groups.values()), 64, 64
    view = memoryview(buf) if len(buf) else memoryview(b"")
    while todo:
        nxt: list[list[int]] = []
        for members in todo:
            parts: dict[bytes, list[int]] = {}
            for r in members:
                at = int(start[r]) + depth
                parts.setdefault(bytes(view[at : min(at + width, int(off[r + 1]))]), []).append(r)
            for digit_bytes, part in parts.items():
                if len(part) > 1:
                    if len(digit_bytes) < width:
                        label[part] = min(part)
                    else:
                        nxt.append(part)
        todo, depth, width = nxt, depth + width, min(width * 2, 1 << 20)
    return label


def split_points(texts: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """(ascending byte strings that cut the texts, one column t, into ranges; number of parts of each range)."""
    raw = texts.where("t IS NOT NULL").select(F.encode("t", "UTF-8").alias("b")).select("b", F.octet_length("b").alias("size"))
    heads = materialise(raw.select(F.substring("b", 1, _HEAD).alias("b"), "size"), "heads")
    limit = max(range_bytes, (heads.agg(F.sum("size")).first()[0] or 0) // MOST_RANGES)
    width, depth = 2, 0
    heavy: list[bytes] = []
    leaves: dict[bytes, int] = {}
    while True:
        level = heads if depth + width <= _HEAD else raw
        level = level.where(F.substring("b", 1, depth).isin(heavy)) if depth else level  # no more of them than ranges
        found = level.groupBy(F.substring("b", 1, depth + width).alias("p")).agg(F.sum(F.col("size") + 16).alias("n"), F.max("size").alias("most"))
        rows = found.collect()
        depth += width
        width = depth
        heavy = []
        for r in rows:
            p = bytes(r["p"])
            leaves[p] = r["n"]
            if r["n"] > limit and r["most"] > depth and len(p) == depth:
                heavy.append(p)
                leaves[p] = 0
        if not heavy:
            break
    cuts, totals, held = [], [], 0
    for p in sorted(leaves):
        if held and held + leaves[p] > limit:
            cuts.append(p)
            totals.append(held)
            held = 0
        held += leaves[p]
    return cuts, np.maximum(-(-np.array([*totals, held], np.int64) // range_bytes), 1)


def _columns(docs: DataFrame) -> tuple[DataFrame, T.StructType]:
    """docs with columns c0, c1, ..., and their types."""
    plain = small_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain, T.StructType([T.StructField(f.name, f.dataType, True) for f in plain.schema])


def _least(table: pa.Table, label: np.ndarray, ids: int) -> np.ndarray:
    """Whether each row has the least id of its group, one row a group."""
    order_by = pa.table({"l": label, "i": table.column(ids)})
    order = np.asarray(pc.sort_indices(order_by, sort_keys=[("l", "ascending"), ("i", "ascending")], null_placement="at_end"))
    ordered = label[order]
    keep = np.zeros(len(label), dtype=bool)
    keep[order[np.r_[True, ordered[1:] != ordered[:-1]] if len(order) else []]] = True
    return keep


def _buckets(texts: pa.Array, cuts: list[bytes], parts: np.ndarray) -> pa.Array:
    """The part of its range that each text belongs to; a null text is put somewhere by its row number, as it meets no other."""
    base = (np.cumsum(parts) - parts).tolist()
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    deep = max(map(len, cuts), default=0)
    raw = texts.cast(pa.large_binary())
    head = pc.binary_slice(raw.cast(pa.binary()) if raw.nbytes < 1 << 31 else raw, 0, max(deep, 1)).to_pylist()
    out = []
    for i, b in enumerate(head):
        if b is None:
            out.append(i % int(parts.sum()))
            continue
        r = bisect.bisect_right(cuts, b)
        out.append(base[r] + (zlib.crc32(raw[i].as_buffer()) % int(parts[r]) if parts[r] > 1 else 0))
    return pa.array(out, pa.int32())


def drop_exact_duplicates(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with one row, of the least id, for each text; rows without a text stay."""
    names = docs.columns
    plain, schema = _columns(docs)
    ids, text = names.index(id_col), names.index(text_col)
    cuts, parts = split_points(plain.select(F.col(f"c{text}").alias("t")), range_bytes)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = _least(b, equal_groups(b.column(text)), ids)
            b = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*b.columns, _buckets(b.column(text), cuts, parts)], names=[*b.schema.names, "bucket"])

    def whole(table: pa.Table) -> pa.Table:
        keep = _least(table, equal_groups(table.column(text).combine_chunks()), ids)
        return table.filter(pa.array(keep)).drop_columns(["bucket"])

    mapped = plain.mapInArrow(local, T.StructType([*schema, T.StructField("bucket", T.IntegerType())]))
    return mapped.groupBy("bucket").applyInArrow(whole, schema).toDF(*names)


def exact_duplicates(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, keep_id, copies) of each row whose text another row has; keep_id is the least id that is not null."""
    kind = docs.schema[id_col].dataType
    pair = small_batches(docs).select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    cuts, parts = split_points(pair.select("t"), range_bytes)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column(1)))
            label = equal_groups(b.column(1))
            order = np.argsort(label, kind="stable")
            starts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]]) if len(order) else np.zeros(0, np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), b.column(0).take(pa.array(order)))
            texts = b.column(1).take(pa.array(order[starts]))
            yield pa.RecordBatch.from_arrays([ids, texts, _buckets(texts, cuts, parts)], names=["ids", "t", "bucket"])

    def whole(table: pa.Table) -> pa.Table:
        label = equal_groups(table.column("t").combine_chunks())
        ids = table.column("ids").combine_chunks()
        owner = np.repeat(label, np.asarray(pc.list_value_length(ids)))
        flat = pa.table({"g": owner, "doc_id": pc.list_flatten(ids)})
        found = flat.group_by("g").aggregate([("doc_id", "min"), ([], "count_all")])
        found = found.filter(pc.greater(found["count_all"], 1)).rename_columns({"doc_id_min": "keep_id", "count_all": "copies"})
        return flat.join(found, "g", join_type="inner", use_threads=False).select(["doc_id", "keep_id", "copies"])

    out = T.StructType([T.StructField("doc_id", kind), T.StructField("keep_id", kind), T.StructField("copies", T.LongType())])
    mapped = pair.mapInArrow(local, T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("t", T.StringType()), T.StructField("bucket", T.IntegerType())]))
    return mapped.groupBy("bucket").applyInArrow(whole, out)


ORACLE = """
SELECT d.doc_id, g.keep_id, g.copies FROM documents d
JOIN (SELECT text, min(doc_id) AS keep_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) g ON d.text = g.text
"""
