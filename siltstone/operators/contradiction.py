"""Contradiction candidates and an injected judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INPUT_COST, OUTPUT_COST = 0.30, 1.20  # dollars a million tokens
VERDICT = "status string, severity string, claim_a string, claim_b string, explanation string, recommendation string"
Judge = Callable[[str], tuple[str, int | None, int | None]]


def prompts(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(left_id, right_id, score, scope, prompt) of candidate pairs."""
    info = chunks.select("chunk_id", F.coalesce("filename", F.lit("Unknown source")).alias("name"), "text")
    two = pairs.join(info.toDF("left_id", "name_a", "text_a"), "left_id").join(info.toDF("right_id", "name_b", "text_b"), "right_id")
    prompt = F.concat(F.lit("Passage A ("), "name_a", F.lit("):\n"), "text_a", F.lit("\n\nPassage B ("), "name_b", F.lit("):\n"), "text_b")
    return two.select("left_id", "right_id", "score", "scope", prompt.alias("prompt"))


def judged(asked: DataFrame, judge: Judge) -> DataFrame:
    """asked with raw_content, prompt_tokens, completion_tokens and failed; judge takes a prompt and gives content and token counts."""
    kinds = [("raw_content", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("failed", pa.bool_())]

    def call(prompt: str) -> tuple:
        try:
            return *judge(prompt), False
        except Exception:  # noqa: BLE001 - a failed call is counted, the others go on
            return None, None, None, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = list(zip(*map(call, b.column(4).to_pylist()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(a, k) for a, (_, k) in zip(answers, kinds))], names=[*b.schema.names, *(n for n, _ in kinds)])

    return asked.mapInArrow(run, "left_id string, right_id string, score double, scope string, prompt string, raw_content string, prompt_tokens bigint, completion_tokens bigint, failed boolean")


def verdicts(answers: DataFrame) -> DataFrame:
    """answers with the parsed verdict; what is no JSON object or has no known status counts as CONSISTENT."""
    bare = F.regexp_replace(F.btrim(F.coalesce("raw_content", F.lit(""))), r"(?is)^\s*```(?:json)?\s*|\s*```\s*$", "")
    v = F.from_json(bare, VERDICT)
    text = lambda f: F.btrim(F.coalesce(v[f], F.lit("")))
    contra = F.upper(text("status")) == "CONTRADICTION"
    out = {c: text(c) for c in ("claim_a", "claim_b", "recommendation")}
    out["status"] = F.when(contra, "CONTRADICTION").otherwise("CONSISTENT")
    out["given_severity"] = F.lower(text("severity"))
    out["explanation"] = text("explanation")
    return answers.withColumns(out)


def severity() -> Column:
    hedge = "|".join(("may", "might", "partial", "ambiguous", "unclear"))
    return (
        F.when(F.col("given_severity").isin("high", "medium"), F.col("given_severity"))
        .when(F.lower("explanation").rlike(hedge), "medium")
        .when((F.col("claim_a") != "") & (F.col("claim_b") != ""), "high")
        .otherwise("medium")
    )


def findings(parsed: DataFrame) -> DataFrame:
    """Contradictions with any claim or explanation; sinks put high ones first, then by falling score."""
    real = parsed.where("status = 'CONTRADICTION' AND (claim_a <> '' OR claim_b <> '' OR explanation <> '')")
    return real.select("left_id", "right_id", "scope", F.round("score", 3).alias("similarity"), severity().alias("severity"), "claim_a", "claim_b", "explanation", "recommendation")


def usage(answers: DataFrame) -> DataFrame:
    """One row: calls, failures, tokens and cost; tokens that are not reported count as a quarter of the characters, one at least."""
    guess = lambda c: F.greatest(F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4), F.lit(1))
    pt = F.coalesce("prompt_tokens", guess("prompt"))
    ct = F.when(F.col("failed"), F.lit(0)).otherwise(F.coalesce("completion_tokens", guess("raw_content")))
    total = answers.agg(F.count("*").alias("calls"), F.count_if("failed").alias("failed_calls"), F.coalesce(F.sum(pt), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(ct), F.lit(0)).alias("completion_tokens"))
    return total.withColumn("cost", F.round((INPUT_COST * F.col("prompt_tokens") + OUTPUT_COST * F.col("completion_tokens")) / 1e6, 6))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium")))
