"""Duplicate findings from similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .lineage import materialise

KINDS = ("exact", "already_in_index", "near_duplicate")


def exact_clusters(pairs: DataFrame) -> DataFrame:
    """(chunk_id, cluster_id, score): the components of exact pairs of new chunks, each with its least pair score.

    cluster_id is the least chunk id of the component. Chunks are joined under
    64-bit hashes of their ids; two ids with the same hash raise an error. Pairs
    are read three times and never shuffled as such: each task adds up what its
    pairs say of a chunk first.
    """
    exact = pairs.where("scope = 'new_vs_new' AND severity = 'exact'").withColumns({"a": F.xxhash64("left_id"), "b": F.xxhash64("right_id")})
    named = exact.select(F.col("left_id").alias("id"), F.col("a").alias("node"), "score").union(exact.select("right_id", "b", "score"))
    named = materialise(named.groupBy("node").agg(F.min("id").alias("chunk_id"), F.max("id").alias("high"), F.min("score").alias("score")), "exact-chunks")
    if not named.where("chunk_id <> high").isEmpty():
        raise ValueError("two chunk ids have the same hash")
    member = named.select("chunk_id", "node", "score").join(connected_components(exact, "a", "b"), "node")
    least = member.groupBy("component").agg(F.min("chunk_id").alias("cluster_id"), F.min("score").alias("least"))
    return member.join(least, "component").select("chunk_id", "cluster_id", F.col("least").alias("score"))


def near_pairs(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Near pairs of new chunks, but for those with both ends in exact clusters."""
    inside = clusters.select("chunk_id").distinct()
    near = pairs.where("scope = 'new_vs_new' AND severity = 'near_duplicate'")
    left, right = (inside.select(F.col("chunk_id").alias(c), F.lit(True).alias(f"in_{c}")) for c in ("left_id", "right_id"))
    both = near.join(left, "left_id", "left").join(right, "right_id", "left")
    return both.where("in_left_id IS NULL OR in_right_id IS NULL").select(*pairs.columns)


def findings(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(finding_type, finding_id, score, members): clusters, pairs with the index and near pairs; sinks put them in this order, each by falling score.

    members are structs of chunk_id, document_id, filename, chunk_index and side.
    """
    clusters = exact_clusters(pairs)
    near = near_pairs(pairs, clusters)
    brown = pairs.where("scope = 'new_vs_existing'")
    pair_id = F.concat_ws("|", "left_id", "right_id")
    ends = F.array(F.struct(F.lit(0).alias("k"), F.col("left_id").alias("chunk_id")), F.struct(F.lit(1).alias("k"), F.col("right_id").alias("chunk_id")))
    flat = clusters.select(F.lit("exact").alias("finding_type"), F.col("cluster_id").alias("finding_id"), "score", F.lit(0).alias("k"), "chunk_id")
    for kind, rows in (("already_in_index", brown), ("near_duplicate", near)):
        flat = flat.unionByName(rows.select(F.lit(kind).alias("finding_type"), pair_id.alias("finding_id"), "score", F.explode(ends).alias("e")).select("finding_type", "finding_id", "score", "e.*"))
    info = chunks.select("chunk_id", "document_id", "filename", "chunk_index", "side")
    member = F.struct("k", F.coalesce("filename", F.lit("")).alias("name"), "chunk_index", "chunk_id", "document_id", "filename", "side")
    found = flat.join(info, "chunk_id").groupBy("finding_type", "finding_id", "score").agg(F.sort_array(F.collect_list(member)).alias("members"))
    found = found.withColumn("members", F.transform("members", lambda m: m.dropFields("k", "name")))
    return found


def counts(found: DataFrame) -> DataFrame:
    """One row with the number of findings of each type."""
    return found.agg(*(F.count_if(F.col("finding_type") == k).alias(k) for k in KINDS))


def tally(pairs: DataFrame) -> DataFrame:
    """counts of the findings of pairs, without their members: a cluster is a finding, and so is every other pair."""
    clusters = exact_clusters(pairs)
    parts = [
        clusters.agg(F.count_distinct("cluster_id").alias("exact")),
        pairs.where("scope = 'new_vs_existing'").agg(F.count("*").alias("already_in_index")),
        near_pairs(pairs, clusters).agg(F.count("*").alias("near_duplicate")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))
    return one.select(*KINDS)


def memberships(found: DataFrame) -> DataFrame:
    """(finding_type, finding_id, score, chunk_id, document_id, filename, chunk_index, side): a row for each chunk of each finding."""
    return found.select("finding_type", "finding_id", "score", F.explode("members").alias("m")).select("finding_type", "finding_id", "score", "m.*")
