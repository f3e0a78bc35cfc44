"""Longest-processing-time sharding of groups that must stay together.

Groups, by size descending and then by their least id, each go to the shard
with the least load, the lower number where loads are equal. Groups of one
size are interchangeable, so the driver only needs the histogram of sizes: it
runs the heap over the sizes and writes, for each, which ranks go to which
shard, many equal groups at once as a repeating cycle. The shards are exactly
those of the heap over single groups.

A null in a group column is a value like others. A null size counts as 0. Ids
may be null or repeat. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.lineage import materialise

from .rows import ID, TEXT

SHARDS = 16


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first rank, rank after the last, cycle of shards) for sizes in descending order."""
    heap = [(0, j) for j in range(shards)]
    out = []
    for size, count in zip(sizes.tolist(), counts.tolist()):
        at = 0
        while at < count:
            if size == 0 or count - at <= shards:
                n = count - at
                cycle = []
                for _ in range(1 if size == 0 else n):
                    load, j = heap[0]
                    heapq.heapreplace(heap, (load + size, j))
                    cycle.append(j)
            else:
                # the shards within one size of the least take turns until another one comes within reach
                order = sorted(heap)
                least = order[0][0]
                turn = [x for x in order if x[0] < least + size]
                rounds = (order[len(turn)][0] - least) // size if len(turn) < shards else count
                n = min(count - at, rounds * len(turn))
                cycle = [j for _, j in turn]
                full, rest = divmod(n, len(turn))
                heap = [(load + size * (full + (k < rest)), j) for k, (load, j) in enumerate(turn)] + order[len(turn) :]
                heapq.heapify(heap)
            out.append((size, at, at + n, cycle))
            at += n
    return out


def shard(docs: DataFrame, keys: list[str] | None = None, size: Column | None = None, shards: int = SHARDS, id_col: str = ID) -> DataFrame:
    """(doc_id, group_id, shard) of every row; rows equal in keys share a shard, group_id is their least id.

    size is a row's share of its group's size, by default the length of its text.
    """
    keys = keys or [TEXT]
    size = F.length(docs[TEXT]) if size is None else size
    parts = [x for k in keys for x in (docs[k], docs[k].isNull())]
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *parts).alias("h2"), F.coalesce(size.cast("long"), F.lit(0)).alias("n"))
    rows = materialise(rows, "shard-rows")
    groups = materialise(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("group_id"), F.sum("n").alias("size")), "shard-groups")
    found = groups.groupBy("size").agg(F.count("*").alias("n")).toPandas().sort_values("size", ascending=False)
    runs = schedule(found["size"].to_numpy(), found["n"].to_numpy(), shards)
    spark = docs.sparkSession
    plan = spark.createDataFrame(pd.DataFrame(runs, columns=["size", "first", "after", "cycle"]) if runs else [], "size long, first long, after long, cycle array<int>")
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("size").orderBy(F.col("group_id").asc_nulls_first(), "h1", "h2")) - 1)
    placed = ranked.join(plan, "size").where("rank >= first AND rank < after").select("h1", "h2", "group_id", F.expr("element_at(cycle, CAST((rank - first) % size(cycle) AS INT) + 1)").alias("shard"))
    return rows.join(placed, ["h1", "h2"]).select("doc_id", "group_id", "shard")


ORACLE = f"""
WITH RECURSIVE g AS (SELECT text, min(doc_id) AS group_id, sum(coalesce(length(text), 0))::BIGINT AS size FROM documents GROUP BY text),
r AS (SELECT group_id, size, row_number() OVER (ORDER BY size DESC, group_id) AS i FROM g),
f AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS group_id, -1 AS shard, list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS loads
  UNION ALL
  SELECT q.i, q.group_id, q.j - 1, list_transform(q.loads, lambda x, k: CASE WHEN k = q.j THEN x + q.size ELSE x END)
  FROM (SELECT r.i, r.group_id, r.size, f.loads, list_position(f.loads, list_min(f.loads)) AS j FROM f JOIN r ON r.i = f.i + 1) q
)
SELECT d.doc_id, f.group_id, f.shard::INTEGER AS shard FROM documents d JOIN g ON d.text IS NOT DISTINCT FROM g.text JOIN f ON f.group_id = g.group_id
"""
