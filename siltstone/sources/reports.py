"""Report sinks: Parquet tables, one JSON payload, and a short Markdown report."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from siltstone.plans.audit import AuditResult

TOP = 5
TABLES = ("duplication", "staleness", "supersession", "contradictions", "metadata", "rot", "health", "projected", "counters")


def write_parquet(result: AuditResult, folder: str) -> None:
    """A folder of Parquet a finding table."""
    for name in TABLES:
        getattr(result, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def write_json(result: AuditResult, path: str) -> None:
    """The findings as lines of JSON, a table and a row each, written by the executors."""
    rows = None
    for name in TABLES:
        t = getattr(result, name)
        one = t.select(F.lit(name).alias("table"), F.to_json(F.struct(*(t[c] for c in t.columns)), {"ignoreNullFields": "false"}).alias("row"))
        rows = one if rows is None else rows.unionByName(one)
    rows.write.mode("overwrite").partitionBy("table").text(path)


def payload(result: AuditResult) -> dict:
    """The whole result as one JSON value: for each table its schema and rows, and the warnings. For uploads; corpora have write_parquet."""
    rows = lambda t: [json.loads(r[0]) for r in t.select(F.to_json(F.struct(*(t[c] for c in t.columns)), {"ignoreNullFields": "false"})).collect()]
    return {"tables": {n: {"schema": json.loads(getattr(result, n).schema.json()), "rows": rows(getattr(result, n))} for n in TABLES}, "warnings": list(result.warnings)}


def load_payload(spark: SparkSession, value: dict) -> AuditResult:
    """The result that a payload was made of."""
    from siltstone.plans.audit import AuditResult

    tables = {}
    for name in TABLES:
        kept = value["tables"][name]
        schema = T.StructType.fromJson(kept["schema"])
        lines = spark.createDataFrame([(json.dumps(r),) for r in kept["rows"]], "j string")
        tables[name] = lines.select(F.from_json("j", schema).alias("r")).select("r.*")
    return AuditResult(**tables, warnings=list(value["warnings"]))


def ordered(name: str, table: DataFrame) -> DataFrame:
    """A finding table as a reader wants it: the worst first."""
    kind = F.array_position(F.array(F.lit("exact"), F.lit("already_in_index"), F.lit("near_duplicate")), F.col("finding_type")) if name == "duplication" else None
    order = {
        "duplication": lambda: (kind, F.desc("score"), "finding_id"),
        "staleness": lambda: (F.desc("score"), "chunk_id"),
        "contradictions": lambda: (F.when(F.col("severity") == "high", 0).otherwise(1), F.desc("similarity"), "left_id", "right_id"),
        "metadata": lambda: ("completeness", "ordinal"),
        "rot": lambda: (F.array_contains("classifications", "healthy"), F.desc(F.size("classifications")), F.lower("filename")),
    }.get(name)
    return table.orderBy(*order()) if order else table


def load_json(spark: SparkSession, path: str, table: str, schema) -> DataFrame:
    """A table of a written JSON report."""
    raw = spark.read.text(path).where(F.col("table") == table)
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*")


def _top(df: DataFrame, columns: list[str]) -> list[dict]:
    return [json.loads(r[0]) for r in df.limit(TOP).select(F.to_json(F.struct(*columns))).collect()]


def markdown(result: AuditResult) -> str:
    """Scores, counters and the first five findings of each kind."""
    health, after, counters = (t.first().asDict() for t in (result.health, result.projected, result.counters))
    out = ["# Corpus audit", "", "## Health score", "", f"Overall {health['overall']}, {after['overall']} after clean-up.", "", "| dimension | now | after |", "|-|-|-|"]
    for d in ("duplication", "staleness", "contradictions", "metadata", "rot"):
        out.append(f"| {d} | {'not available' if health[d] is None else health[d]} | {'not available' if after[d] is None else after[d]} |")
    out += ["", "## Summary", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in counters.items())]
    sections = {
        "Duplication": _top(ordered("duplication", result.duplication).select("finding_type", "score", F.transform("members", lambda m: m["filename"]).alias("files")), ["finding_type", "score", "files"]),
        "Staleness": _top(ordered("staleness", result.staleness), ["filename", "chunk_index", "score", "recommendation"]),
        "Contradictions": _top(ordered("contradictions", result.contradictions), ["severity", "similarity", "explanation"]),
        "Metadata": _top(ordered("metadata", result.metadata), ["filename", "completeness", "missing_fields"]),
        "Redundant, outdated and trivial": _top(ordered("rot", result.rot).where(~F.array_contains("classifications", "healthy")), ["filename", "classifications", "recommendation"]),
    }
    for title, rows in sections.items():
        out += ["", f"## {title}", "", *("- " + ", ".join(f"{k}: {v}" for k, v in r.items()) for r in rows)]
        out += [] if rows else ["None."]
    return "\n".join(out) + "\n"
