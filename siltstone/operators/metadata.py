"""Completeness and consistency of document metadata.

Documents have document_id, ordinal, filename, file_size, created_at,
modified_at, and embedded and frontmatter as MAP<STRING, STRUCT<v: STRING, t:
STRING>>, t naming the value's type (string, date, datetime, number, bool).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X

DEFAULT_FIELDS = ("title", "author", "created date", "modified date", "version", "document type")
_NAMES = {
    "title": "title|document title|title or meaningful filename",
    "author": "author|owner|author or owner",
    "created date": "created|created at|created date|date created",
    "modified date": "modified|modified at|modified date|date modified|last modified|updated",
    "version": "version|revision|version information|product version",
    "document type": "category|type|document type|document category|document type or category",
}
_ALIASES = {name: field for field, names in _NAMES.items() for name in names.split("|")}
_SOURCES = {
    "title": (("title",), ("title",)),
    "author": (("author", "last_modified_by"), ("author", "owner")),
    "created date": (("created",), ("created", "date")),
    "modified date": (("modified",), ("modified", "updated", "last_modified")),
    "version": (("version", "revision"), ("version",)),
    "document type": (("category",), ("category", "type", "document_type")),
}
GENERIC_NAME = r"(?i)^(?:doc|document|file|untitled|new document|scan)(?:[\s_-]?\d+)?$"
_DATE_KEY = "date|created|modified|updated"


def parse_fields(raw: str | None) -> list[str] | None:
    """The trimmed parts between commas and line breaks; None when there are none."""
    parts = [p.strip() for p in re.split(r"[\r\n,]", raw or "") if p.strip()]
    return parts or None


def resolve_fields(fields: list[str] | None) -> list[tuple[str, str | None, str]]:
    """(label, canonical field or None, normalised name) of each expected field, once a name."""
    out, seen = [], set()
    for label in fields or DEFAULT_FIELDS:
        name = re.sub(r"[\s_\-]+", " ", label.lower()).strip()
        if name and name not in seen:
            seen.add(name)
            out.append((label, _ALIASES.get(name), name))
    return out or resolve_fields(None)


def _has(c: Column) -> Column:
    return c.isNotNull() & c["v"].isNotNull() & (F.btrim(c["v"]) != "")


def present(canonical: str) -> Column:
    """Whether a document has a canonical field."""
    inner, front = _SOURCES[canonical]
    checks = [_has(F.try_element_at("embedded", F.lit(k))) for k in inner] + [_has(F.try_element_at("frontmatter", F.lit(k))) for k in front]
    if canonical == "title":
        name = F.btrim(X.stem(F.coalesce("filename", F.lit(""))))
        checks.append((name != "") & ~name.rlike(GENERIC_NAME))
    if canonical in ("created date", "modified date"):
        checks.append(F.col("created_at" if canonical == "created date" else "modified_at").isNotNull())
    out = F.lit(False)
    for c in checks:
        out = out | F.coalesce(c, F.lit(False))
    return out


def custom_present(name: str) -> Column:
    """Whether any metadata key, normalised, has the name and a value; five names mean the document's own columns."""
    own = {"filename": F.col("filename"), "extension": X.extension("filename"), "file size": F.col("file_size").cast("string"), "created date": F.col("created_at").cast("string"), "modified date": F.col("modified_at").cast("string")}
    both = F.concat(*(F.coalesce(F.map_entries(m), F.array()) for m in ("embedded", "frontmatter")))
    names = (name, name.replace(" ", ""))
    hit = F.exists(both, lambda e: X.normalised_key(e["key"]).isin(*names) & _has(e["value"]))
    return F.coalesce(hit, F.lit(False)) | (F.coalesce(F.btrim(own[name]) != "", F.lit(False)) if name in own else F.lit(False))


def date_formats() -> Column:
    """The distinct classes of a document's date values, sorted."""
    merged = F.map_zip_with(F.coalesce("embedded", F.create_map().cast("map<string,struct<v:string,t:string>>")), F.coalesce("frontmatter", F.create_map().cast("map<string,struct<v:string,t:string>>")), lambda k, a, b: F.coalesce(b, a))
    value = lambda e: F.btrim(e["value"]["v"])
    kind = lambda e: (
        F.when(e["value"]["t"] == "datetime", "datetime_object")
        .when(e["value"]["t"] == "date", "date_object")
        .when(value(e).rlike(r"^\d{4}-\d{2}-\d{2}T"), "iso_datetime")
        .when(value(e).rlike(r"^\d{4}-\d{2}-\d{2}$"), "iso_date")
        .when(value(e).rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$"), "slash_date")
        .when(value(e).rlike(r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"), "month_name")
        .otherwise("other_date_string")
    )
    dated = F.filter(F.map_entries(merged), lambda e: F.lower(e["key"]).rlike(_DATE_KEY) & _has(e["value"]))
    system = F.when(F.col("created_at").isNotNull() | F.col("modified_at").isNotNull(), F.array(F.lit("normalized_datetime"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(system, F.transform(dated, kind))))


def assess(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """docs with completeness, missing_fields, date_formats and consistency_issues; sinks put the least complete first."""
    expected = resolve_fields(fields)
    have = [present(c) if c else custom_present(n) for _, c, n in expected]
    missing = F.array_compact(F.array(*(F.when(~h, F.lit(label)) for h, (label, _, _) in zip(have, expected))))
    found = docs.withColumns({"missing_fields": missing, "date_formats": date_formats()})
    found = found.withColumn("completeness", F.round((len(expected) - F.size("missing_fields")) / float(len(expected)), 3))
    corpus = found.select(F.explode_outer("date_formats").alias("f")).agg(F.count_distinct("f").alias("formats"))
    dated = found.agg(F.count_if(F.size("date_formats") > 0).alias("dated"))
    found = found.crossJoin(F.broadcast(corpus)).crossJoin(F.broadcast(dated))
    own = F.size("date_formats") > 0
    issues = F.array_compact(F.array(F.when((F.col("formats") > 1) & own, "mixed date formats"), F.when(~own & (F.col("dated") > 0), "no date while other documents have one")))
    return found.withColumn("consistency_issues", issues).drop("formats", "dated")


def summary(assessed: DataFrame) -> DataFrame:
    """One row: average_completeness and the corpus's consistency_issues."""
    formats = assessed.select(F.explode_outer("date_formats").alias("f")).agg(F.count_distinct("f").alias("formats"))
    own = F.size("date_formats") > 0
    total = assessed.agg(F.round(F.avg("completeness"), 3).alias("average_completeness"), F.count_if(own).alias("dated"), F.count_if(~own).alias("undated"))
    issues = F.array_compact(F.array(F.when(F.col("formats") > 1, "mixed date formats"), F.when((F.col("dated") > 0) & (F.col("undated") > 0), "dates on some documents only")))
    return total.crossJoin(F.broadcast(formats)).select("average_completeness", issues.alias("consistency_issues"))


def missing_counts(assessed: DataFrame) -> DataFrame:
    """(field, documents) of the missing fields, most frequent first, then as they first occur."""
    rows = assessed.select("completeness", "ordinal", F.posexplode("missing_fields").alias("p", "field"))
    return rows.groupBy("field").agg(F.count("*").alias("documents"), F.min(F.struct("completeness", "ordinal", "p")).alias("first")).orderBy(F.desc("documents"), "first").drop("first")


def recommendation() -> Column:
    return (
        F.when(F.col("completeness") < 0.3, "Add the basic metadata before indexing")
        .when(F.col("completeness") < 0.6, "Fill in the missing fields")
        .when(F.size("consistency_issues") > 0, "Use one date format")
        .when(F.size("missing_fields") > 0, "Complete the remaining fields")
        .otherwise("Nothing to do")
    )


def explanation() -> Column:
    """Why a document's completeness matters."""
    return (
        F.when(F.col("completeness") < 0.3, "Hardly any metadata says what this document is, so it can neither be filtered nor trusted")
        .when(F.col("completeness") < 0.6, "Part of the metadata is there; ranking and review have to do without the rest")
        .when(F.size("missing_fields") > 0, "The metadata can be used, with a few gaps")
        .otherwise("The metadata is complete")
    )


def has_issue() -> Column:
    return (F.size("missing_fields") > 0) | (F.size("consistency_issues") > 0) | (F.col("completeness") < 1)
