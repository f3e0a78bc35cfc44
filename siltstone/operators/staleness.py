"""Staleness of chunks from dates in their text and metadata, and supersession."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import dates as D

REPORT_FLOOR, STALE, META_WEIGHT, TEXT_WEIGHT, SUPERSEDE = 0.2, 0.7, 0.6, 0.4, 0.7
CREATED_KEYS = ("created_at", "created", "date_created")
MODIFIED_KEYS = ("modified_at", "modified", "updated_at", "updated", "last_modified")


def signals(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunks with dates, cues and versions found in their text."""
    return chunks.withColumns({"dates": D.dates(text), "cues": D.sorted_hits(text, D.CUES), "versions": D.sorted_hits(text, D.VERSION)})


def content_assessment(found: DataFrame, now: Column) -> DataFrame:
    """found (dates, cues, versions) with text_score, confidence and text_date; the first two are null without a signal."""
    age = lambda d: D.age_score(D.whole_months(d["date"], now))
    cue, ver, n, s = F.size("cues") > 0, F.size("versions") > 0, F.col("n_dates"), F.col("s")
    cap = lambda x: F.least(x, F.lit(1.0))
    # a column a step: each reads the sum so far, and none is written out twice
    out = found.withColumns({"n_dates": F.size("dates"), "ages": F.transform("dates", age), "text_date": F.array_max(F.transform("dates", lambda d: d["date"]))})
    out = out.withColumns({"s": F.array_min("ages"), "old": F.size(F.filter("ages", lambda x: x >= STALE)) >= 0.75 * n})
    out = out.withColumn("s", F.when(F.col("old") & (s >= STALE), cap(s + F.least(F.lit(0.2), 0.08 * (n - 1)))).otherwise(s))
    out = out.withColumn("s", F.when(cue & (s >= 0.5), cap(s + 0.1)).otherwise(s))
    out = out.withColumn("s", F.when(ver & (s >= 0.5), cap(s + 0.05)).otherwise(s))
    sure = F.lit(0.55) + F.least(F.lit(0.24), 0.14 * (n - 1)) + F.when(F.col("old"), 0.12).otherwise(0.0) + F.when(cue, 0.05).otherwise(0.0) + F.when(ver, 0.03).otherwise(0.0)
    none = n == 0
    out = out.withColumns({
        "text_score": F.when(none & cue & ver, 0.65).when(none & cue, 0.6).when(none & ver, 0.4).when(~none, s),
        "confidence": F.when(none & cue & ver, 0.6).when(none & cue, 0.55).when(none & ver, 0.5).when(~none, F.round(F.least(sure, F.lit(0.95)), 3)),
    })
    return out.drop("n_dates", "ages", "s", "old")


def metadata_dates(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """chunks with created_at and modified_at: the uploaded document's where there is one, else those of the chunk's metadata map."""
    first = lambda keys: F.coalesce(*(F.nullif(F.btrim(F.try_element_at("metadata", F.lit(k))), F.lit("")) for k in keys))
    own = {"meta_created": D.parsed_datetime(first(CREATED_KEYS)), "meta_modified": D.parsed_datetime(first(MODIFIED_KEYS))} if "metadata" in chunks.columns else {c: F.lit(None).cast("timestamp") for c in ("meta_created", "meta_modified")}
    base = chunks.drop("created_at", "modified_at").withColumns(own)
    if documents is None:
        return base.withColumnsRenamed({"meta_created": "created_at", "meta_modified": "modified_at"})
    dates = documents.select(F.col("document_id").cast("string"), F.col("created_at").cast("timestamp").alias("c"), F.col("modified_at").cast("timestamp").alias("m"), F.lit(True).alias("known"))
    joined = base.join(dates, "document_id", "left")
    pick = lambda a, b: F.when(F.col("known"), F.col(a)).otherwise(F.col(b))
    return joined.withColumns({"created_at": pick("c", "meta_created"), "modified_at": pick("m", "meta_modified")}).drop("c", "m", "known", "meta_created", "meta_modified")


def assess(chunks: DataFrame, now: datetime, meta_weight: float = META_WEIGHT, text_weight: float = TEXT_WEIGHT) -> DataFrame:
    """chunks (text, created_at, modified_at) with score, meta_score, text_score, confidence and reference_date."""
    today = F.lit(now).cast("timestamp")
    found = content_assessment(signals(chunks), today).withColumn("meta_date", F.greatest("created_at", "modified_at"))
    found = found.withColumn("meta_score", F.when(F.col("meta_date").isNotNull(), D.age_score(D.whole_months(F.col("meta_date"), today))))
    both = F.greatest(meta_weight * F.col("meta_score") + text_weight * F.col("text_score"), F.col("text_score") * F.col("confidence"))
    score = F.when(F.col("meta_score").isNotNull() & F.col("text_score").isNotNull(), both).otherwise(F.coalesce("meta_score", "text_score", F.lit(0.5)))
    return settled(found.withColumns({"score": F.round(score, 3), "reference_date": F.coalesce("meta_date", F.col("text_date").cast("timestamp"))}), "score", "meta_score", "text_score", "confidence", "reference_date", "meta_date", "text_date", "dates", "cues", "versions")


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with columns of those names as a generator's output, which filters are not pushed through: each is worked out once a row, whatever asks for it."""
    inner = F.struct(*(F.col(c).alias(c) for c in names))
    rest = [F.col(c).alias(c) for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(inner)).alias(*names)).select(*(F.col(f"`{c}`") for c in df.columns))


def recommendation() -> Column:
    return (
        F.when(F.col("meta_score").isNull() & F.col("text_score").isNull(), "Add a date: freshness is unknown")
        .when(F.col("score") > STALE, "Update or retire")
        .when(F.col("score") >= 0.4, "Review soon")
        .otherwise("Keep an eye on it")
    )


def findings(assessed: DataFrame, floor: float = REPORT_FLOOR) -> DataFrame:
    """The new chunks with a score above floor; sinks put them in order of falling score."""
    return assessed.where((F.col("side") == "new") & (F.col("score") > floor)).withColumn("recommendation", recommendation())


def notes(now: datetime) -> Column:
    """array<string>: what a finding's score rests on, as short sentences."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    age = lambda c: D.whole_months(F.col(c), F.lit(now).cast("timestamp")).cast("string")
    said = lambda c, *parts: F.when(F.col(c).isNotNull(), F.concat(*parts))
    return F.array_compact(F.array(
        said("meta_date", F.lit("Dated "), day("meta_date"), F.lit(" by its metadata")),
        said("text_date", F.lit("Latest date in the text is "), day("text_date")),
        said("meta_date", age("meta_date"), F.lit(" months old by its metadata")),
        said("text_date", age("text_date"), F.lit(" months old by its text")),
    ))


def date_labels() -> Column:
    """array<string>: the metadata dates of a chunk."""
    one = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name} "), F.date_format(c, "yyyy-MM-dd")))
    return F.array_compact(F.array(one("Created", "created_at"), one("Modified", "modified_at")))


def supersessions(pairs: DataFrame, assessed: DataFrame, floor: float = SUPERSEDE) -> DataFrame:
    """(left_id, right_id, similarity, score): existing chunks, with their score, whose new counterpart is over a day newer."""
    side = assessed.select("chunk_id", "reference_date", "score")
    near = pairs.where((F.col("scope") == "new_vs_existing") & (F.col("score") >= floor)).select("left_id", "right_id", F.col("score").alias("similarity"))
    new = side.select(F.col("chunk_id").alias("left_id"), F.col("reference_date").alias("new_date"))
    old = side.select(F.col("chunk_id").alias("right_id"), F.col("reference_date").alias("old_date"), "score")
    met = near.join(new, "left_id").join(old, "right_id")
    met = met.where((F.col("score") > REPORT_FLOOR) & (F.col("new_date") > F.col("old_date") + F.expr("INTERVAL 1 DAY")))
    return met.select("left_id", "right_id", "similarity", "score").dropDuplicates(["left_id", "right_id"])


def histogram(found: DataFrame, superseded: DataFrame) -> DataFrame:
    """One row: high, review, fresh and superseded."""
    s = F.col("score")
    return found.agg(F.count_if(s > 0.8).alias("high"), F.count_if((s >= 0.5) & (s <= 0.8)).alias("review"), F.count_if(s < 0.5).alias("fresh")).crossJoin(F.broadcast(superseded.agg(F.count("*").alias("superseded"))))
