"""Redundant, outdated and trivial documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X

from . import duplication
from .staleness import STALE

REDUNDANT_RATIO, JUDGE_BUDGET = 0.5, 3


def triviality(chunks: DataFrame) -> DataFrame:
    """chunks with words, unique_ratio, hits, boilerplate_ratio, trivial and borderline; ratios are rounded after the flags."""
    t = chunks.withColumn("w", X.tokens("text")).withColumn("hits", X.boilerplate_hits("text"))
    t = t.withColumn("words", F.size("w")).withColumn("ur", F.when(F.col("words") > 0, F.size(F.array_distinct("w")) / F.col("words")).otherwise(0.0))
    wc, ur, hit = F.col("words"), F.col("ur"), F.size("hits") > 0
    trivial = ((wc < 20) & (ur < 0.5)) | ((wc < 30) & (ur < 0.4)) | (ur < 0.3) | (hit & (wc < 80))
    edge = (wc < 40) | ((ur >= 0.35) & (ur < 0.45)) | hit
    flagged = t.withColumns({"trivial": trivial, "borderline": ~trivial & edge})
    return flagged.withColumns({"unique_ratio": F.round("ur", 3), "boilerplate_ratio": F.round(F.size("hits") / F.greatest("words", F.lit(1)), 3)}).drop("w", "ur")


def document_triviality(assessed: DataFrame) -> DataFrame:
    """(document_id, chunks, avg_words, avg_unique, avg_boilerplate, trivial_share, state): trivial, healthy or open."""
    d = assessed.groupBy("document_id").agg(F.count("*").alias("chunks"), F.avg("words").alias("avg_words"), F.avg("unique_ratio").alias("avg_unique"), F.avg("boilerplate_ratio").alias("avg_boilerplate"), F.avg(F.col("trivial").cast("int")).alias("trivial_share"))
    trivial = ((F.col("avg_words") < 30) & (F.col("avg_unique") < 0.4)) | (F.col("trivial_share") >= 0.5) | (F.col("avg_boilerplate") > 0.04)
    healthy = (F.col("avg_words") >= 45) & (F.col("avg_unique") >= 0.45) & (F.col("avg_boilerplate") < 0.02) & (F.col("trivial_share") < 0.34)
    return d.withColumn("state", F.when(trivial, "trivial").when(healthy, "healthy").otherwise("open"))


def judge_queue(assessed: DataFrame, documents: DataFrame, budget: int = JUDGE_BUDGET) -> DataFrame:
    """The first borderline chunks, in document and chunk order, that a judge of substance is asked about."""
    open_docs = document_triviality(assessed).where("state = 'open'").select("document_id")
    order = documents.select(F.col("document_id").cast("string"), "ordinal")
    asked = assessed.where("borderline").join(open_docs, "document_id", "left_semi").join(order, "document_id")
    return asked.orderBy("ordinal", "chunk_index").limit(budget)


def judged(asked: DataFrame, substantial: Callable[[str], bool]) -> DataFrame:
    """(document_id, substantive) for the chunks of a judge's queue; a failing call counts as substantive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                try:
                    out.append(bool(substantial(text)))
                except Exception:  # noqa: BLE001 - whatever fails, the document keeps the benefit of the doubt
                    out.append(True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.bool_())], names=["document_id", "substantive"])

    return asked.select("document_id", "text").mapInArrow(run, "document_id string, substantive boolean")


def apply_judgements(states: DataFrame, judged: DataFrame) -> DataFrame:
    """states with open documents made trivial where judged (document_id, substantive) has half or more unsubstantial chunks."""
    v = judged.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("substantive", F.lit(True))).alias("poor"))
    new = F.when((F.col("state") == "open") & (F.col("poor") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))), "trivial").otherwise(F.col("state"))
    return states.join(v, "document_id", "left").withColumn("state", new).drop("n", "poor")


def classify(documents: DataFrame, chunks: DataFrame, duplicates: DataFrame, stale: DataFrame, superseded: DataFrame, contradictions: DataFrame, completeness: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """A row a document with its signals, classifications and what they mean; sinks put those with most labels first.

    duplicates are duplication findings, stale those of staleness, superseded
    (document_id, finding_id), contradictions (finding_id, document_id) and
    completeness (document_id, completeness).
    """
    assessed = triviality(chunks.where("side = 'new'"))
    states = document_triviality(assessed)
    if judged is not None:
        states = apply_judgements(states, judged)
    docs = documents.select(F.col("document_id").cast("string"), "ordinal", "filename")
    member = duplication.memberships(duplicates).where("side = 'new'").join(docs, "document_id", "left_semi")
    kinds = member.groupBy("document_id").agg(F.count_distinct("chunk_id").alias("duplicated"), *(F.count_if(F.col("finding_type") == k).alias(f"dup_{k}") for k in duplication.KINDS))
    aged = stale.groupBy("document_id").agg(F.round(F.avg("score"), 3).alias("avg_stale"), F.count_if(F.col("score") > STALE).alias("stale_chunks"), F.max("score").alias("max_stale"))
    over = superseded.groupBy("document_id").agg(F.count_distinct("finding_id").alias("superseded"))
    contra = contradictions.groupBy("document_id").agg(F.count_distinct("finding_id").alias("contradictions"))
    out = docs
    for part in (states, kinds, aged, over, contra, completeness.select(F.col("document_id").cast("string"), "completeness")):
        out = out.join(part, "document_id", "left")
    zero = ["chunks", "duplicated", *(f"dup_{k}" for k in duplication.KINDS), "stale_chunks", "superseded", "contradictions"]
    out = out.fillna(0, zero).fillna(0.0, ["avg_stale", "max_stale"]).withColumn("duplicate_ratio", F.round(F.col("duplicated") / F.greatest("chunks", F.lit(1)), 3))
    return out.withColumn("classifications", labels()).withColumns({"recommendation": recommendation(), "explanation": explanation(), "impact": impact()})


def labels() -> Column:
    redundant = (F.col("duplicated") / F.greatest("chunks", F.lit(1)) >= REDUNDANT_RATIO) | ((F.col("duplicated") > 0) & (F.col("chunks") <= 1))
    outdated = (F.col("avg_stale") > STALE) | (F.col("superseded") > 0)
    found = F.array_compact(F.array(F.when(redundant, "redundant"), F.when(outdated, "outdated"), F.when(F.col("state") == "trivial", "trivial")))
    return F.when(F.size(found) == 0, F.array(F.lit("healthy"))).otherwise(found)


def _has(label: str) -> Column:
    return F.array_contains("classifications", label)


def recommendation() -> Column:
    return F.when(_has("redundant"), "Remove or merge").when(_has("outdated"), "Update").when(_has("trivial"), "Review for substance").otherwise("Keep")


def _listed(name: Column, healthy: str, lead: str, parts: dict[str, Column]) -> Column:
    said = F.concat_ws("; ", F.array_compact(F.array(*(F.when(_has(k), c) for k, c in parts.items()))))
    return F.when(_has("healthy"), F.concat(name, F.lit(healthy))).otherwise(F.concat(name, F.lit(lead), said))


def explanation() -> Column:
    """Which signals a document's labels rest on."""
    parts = {
        "redundant": F.format_string("%.0f %% of its chunks are duplicates", 100 * F.col("duplicate_ratio")),
        "outdated": F.format_string("mean staleness %.2f, %d passages replaced by newer ones", F.col("avg_stale"), F.col("superseded")),
        "trivial": F.format_string("%.1f words a chunk, %.2f of them different", F.coalesce("avg_words", F.lit(0.0)), F.coalesce("avg_unique", F.lit(0.0))),
    }
    return _listed(F.coalesce("filename", F.lit("The document")), ": nothing to object to", ": ", parts)


def impact() -> Column:
    """What a document would do to answers."""
    parts = {"redundant": F.lit("it takes the place of other sources"), "outdated": F.lit("answers may state what is no longer true"), "trivial": F.lit("it fills the context with little")}
    more = F.when(F.col("contradictions") > 0, F.format_string("; contradicted in %d findings", F.col("contradictions"))).otherwise("")
    return F.concat(_listed(F.lit(""), "No harm expected", "If indexed: ", parts), more)

