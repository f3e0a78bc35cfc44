"""What a report shows of a finding: labels, levels and short lines, as columns beside the finding's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import metadata, staleness
from siltstone.plans.audit import AuditResult

DIMENSIONS = ("duplication", "staleness", "contradictions", "metadata", "rot")
_KIND = {"exact": "The same text", "near_duplicate": "Nearly the same text", "already_in_index": "In the index already"}


def level(score: Column) -> Column:
    """How a score of a hundred reads: good, fair or poor; unknown where there is none."""
    return F.when(score.isNull(), "unknown").when(score > 80, "good").when(score >= 50, "fair").otherwise("poor")


def percent(share: Column) -> Column:
    return F.format_string("%.0f %%", F.round(share * 100))


def duplication(found: DataFrame) -> DataFrame:
    """finding_type, label, similarity, sources (file and chunk of each member) and what to do."""
    sources = F.transform("members", lambda m: F.concat(F.coalesce(m["filename"], F.lit("Unknown source")), F.lit(" #"), (m["chunk_index"] + 1).cast("string")))
    label = F.coalesce(*(F.when(F.col("finding_type") == k, v) for k, v in _KIND.items()), F.lit("Duplicate"))
    action = F.when(F.col("finding_type") == "already_in_index", "Leave it out").when(F.col("finding_type") == "exact", "Keep one of them").otherwise("Compare and merge")
    return found.select("finding_type", "finding_id", label.alias("label"), percent(F.col("score")).alias("similarity"), sources.alias("sources"), action.alias("action"))


def stale(found: DataFrame) -> DataFrame:
    """chunk, label (high, review or fresh), score, notes, date labels and what to do."""
    s = F.col("score")
    label = F.when(s > 0.8, "high").when(s >= 0.5, "review").otherwise("fresh")
    return found.select("chunk_id", "filename", (F.col("chunk_index") + 1).alias("chunk"), label.alias("label"), percent(s).alias("staleness"), "notes", staleness.date_labels().alias("dates"), "recommendation")


def contradictions(found: DataFrame) -> DataFrame:
    line = F.when((F.col("claim_a") != "") & (F.col("claim_b") != ""), F.concat(F.col("claim_a"), F.lit(" / "), F.col("claim_b"))).otherwise(F.col("explanation"))
    return found.select("finding_id", F.initcap("severity").alias("label"), percent(F.col("similarity")).alias("similarity"), line.alias("line"), "recommendation")


def described(found: DataFrame) -> DataFrame:
    return found.select("document_id", "filename", percent(F.col("completeness")).alias("complete"), level(F.col("completeness") * 100).alias("level"), F.array_join("missing_fields", ", ").alias("missing"), "consistency_issues", metadata.explanation().alias("explanation"), metadata.recommendation().alias("recommendation"))


def labelled(found: DataFrame) -> DataFrame:
    return found.select("document_id", "filename", F.transform("classifications", F.initcap).alias("labels"), "explanation", "impact", "recommendation")


def cards(result: AuditResult) -> DataFrame:
    """(dimension, score, level, projected, gain) of each dimension and overall."""
    names = (*DIMENSIONS, "overall")
    wide = lambda df, c: df.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias(c)) for d in names))))
    both = wide(result.health, "score").join(wide(result.projected, "projected"), "dimension")
    return both.select("dimension", "score", level(F.col("score")).alias("level"), "projected", F.round(F.col("projected") - F.col("score"), 1).alias("gain"))


def views(result: AuditResult) -> dict[str, DataFrame]:
    """The view of every finding table, and the cards."""
    return {
        "cards": cards(result),
        "duplication": duplication(result.duplication),
        "staleness": stale(result.staleness),
        "contradictions": contradictions(result.contradictions),
        "metadata": described(result.metadata),
        "rot": labelled(result.rot),
    }
