"""Corpus health: dimension scores, their weighted mean, and the projection after clean-up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import duplication
from .staleness import STALE

WEIGHTS = {"duplication": 0.25, "staleness": 0.20, "contradictions": 0.25, "metadata": 0.10, "rot": 0.20}


def duplicated_ids(duplicates: DataFrame) -> DataFrame:
    """The distinct new chunks in any duplication finding."""
    return duplication.memberships(duplicates).where("side = 'new'").select("chunk_id").distinct()


def stale_ids(stale: DataFrame) -> DataFrame:
    return stale.where(F.col("score") > STALE).select("chunk_id").distinct()


def removable(rot: DataFrame) -> DataFrame:
    """The documents that can go: the redundant ones."""
    return rot.where(F.array_contains("classifications", "redundant")).select("document_id")


def percent(part: Column, total: Column) -> Column:
    """What is left of a hundred when part of total is bad; 100 of nothing."""
    return F.when(total == 0, F.lit(100.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1 - part / F.nullif(total, F.lit(0))) * 100, 1))


def dimensions(total_chunks: DataFrame, duplicates: DataFrame, stale: DataFrame, contradictions: DataFrame, candidates: DataFrame | None, average_completeness: DataFrame, rot: DataFrame, unknown: Iterable[str] = ()) -> DataFrame:
    """One row with a score for each dimension; contradictions are null without judged candidates, and so are the unknown dimensions.

    total_chunks and candidates are one-column tables of new chunks and of
    candidate pairs, average_completeness one row.
    """
    parts = [
        total_chunks.agg(F.count("*").alias("n")),
        duplicated_ids(duplicates).agg(F.count("*").alias("d")),
        stale.agg(F.round((1 - F.avg("score")) * 100, 1).alias("s")),
        contradictions.agg(F.count("*").alias("c")),
        (candidates.agg(F.count("*").alias("k")) if candidates is not None else total_chunks.sparkSession.sql("SELECT CAST(NULL AS BIGINT) AS k")),
        average_completeness.agg(F.first("average_completeness").alias("m")),
        rot.agg(F.count("*").alias("r"), F.count_if((F.size("classifications") == 1) & F.array_contains("classifications", "healthy")).alias("h")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))
    made = {
        "duplication": percent(F.col("d"), F.col("n")),
        "staleness": F.coalesce("s", F.lit(100.0)),
        "contradictions": F.when(F.col("k").isNotNull(), percent(F.col("c"), F.col("k"))),
        "metadata": F.round(F.coalesce("m", F.lit(1.0)) * 100, 1),
        "rot": F.when(F.col("r") == 0, 100.0).otherwise(F.round(F.col("h") / F.nullif(F.col("r"), F.lit(0)) * 100, 1)),
    }
    return one.select(*((F.lit(None).cast("double") if d in set(unknown) else c).alias(d) for d, c in made.items()))


def overall(row: DataFrame) -> DataFrame:
    """row with overall, the mean weighted over the dimensions that are not null, and skipped, the names of the others."""
    up = sum((F.when(F.col(d).isNotNull(), F.col(d) * w).otherwise(0.0) for d, w in WEIGHTS.items()), F.lit(0.0))
    down = sum((F.when(F.col(d).isNotNull(), w).otherwise(0.0) for d, w in WEIGHTS.items()), F.lit(0.0))
    skipped = F.array_compact(F.array(*(F.when(F.col(d).isNull(), d) for d in WEIGHTS)))
    return row.withColumns({"overall": F.when(down == 0, 0.0).otherwise(F.round(up / F.nullif(down, F.lit(0.0)), 1)), "skipped": skipped})


def documents_with_issues(documents: DataFrame, *findings: DataFrame) -> DataFrame:
    """The uploaded documents that any of the tables of document_id names."""
    named = None
    for f in findings:
        ids = f.select(F.col("document_id").cast("string"))
        named = ids if named is None else named.union(ids)
    return documents.select(F.col("document_id").cast("string")).join(named.distinct(), "document_id", "left_semi")


def projected(chunks: DataFrame, duplicates: DataFrame, stale: DataFrame, contradictions: DataFrame, contradiction_docs: DataFrame, candidates: DataFrame | None, rot: DataFrame, unknown: Iterable[str] = ()) -> DataFrame:
    """The dimension scores once removable documents and duplicated and stale chunks are gone.

    Duplication is clean by then; the number of candidate pairs stays what it was.
    """
    gone = removable(rot)
    old = stale_ids(stale)
    left = chunks.where("side = 'new'").join(gone, "document_id", "left_anti").join(duplicated_ids(duplicates), "chunk_id", "left_anti").join(old, "chunk_id", "left_anti")
    fresh = stale.join(gone, "document_id", "left_anti").join(old, "chunk_id", "left_anti")
    hit = contradiction_docs.join(gone, "document_id", "left_semi").select("finding_id").distinct()
    contra = contradictions.join(hit, "finding_id", "left_anti")
    rows = rot.join(gone, "document_id", "left_anti")
    complete = rows.agg(F.coalesce(F.avg("completeness"), F.lit(1.0)).alias("average_completeness"))
    return dimensions(left.select("chunk_id"), duplicates.limit(0), fresh, contra, candidates, complete, rows, unknown)


def counters(documents: DataFrame, chunks: DataFrame, duplicates: DataFrame, stale: DataFrame, superseded: DataFrame, contradictions: DataFrame, rot: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of summary counters; clusters are exact and near findings."""
    parts = [
        documents.agg(F.count("*").alias("documents")),
        chunks.agg(F.count_if(F.col("side") == "new").alias("chunks")),
        duplicates.agg(F.count_if(F.col("finding_type").isin("exact", "near_duplicate")).alias("duplicate_clusters")),
        stale_ids(stale).agg(F.count("*").alias("stale_chunks")),
        superseded.agg(F.count("*").alias("superseded")),
        contradictions.agg(F.count("*").alias("contradictions")),
        removable(rot).agg(F.count("*").alias("removable_documents")),
        issues.agg(F.count("*").alias("documents_with_issues")),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))
    return one
