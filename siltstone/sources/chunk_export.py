"""Existing chunks from JSON and CSV exports whose columns go by many names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHUNKS = 5000
ALIASES = {
    "text": ("text", "content", "chunk_text", "page_content", "body"),
    "document_id": ("parent_document_id", "document_id", "doc_id", "source_id"),
    "filename": ("parent_document_name", "document_name", "filename", "source", "source_path", "document"),
    "chunk_index": ("chunk_index", "index", "position"),
    "start_char": ("start_char", "start"),
    "end_char": ("end_char", "end"),
}
VECTORS = ("embedding", "embeddings", "vector")
_RESERVED = {n for names in ALIASES.values() for n in names} | {*VECTORS, "metadata", "id", "chunk_id"}


class ExportError(ValueError):
    """An export without usable chunks."""


def first_string(m: Column | str, names: tuple[str, ...]) -> Column:
    """The first of the names whose value is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.btrim(F.try_element_at(m, F.lit(n))), F.lit("")) for n in names))


def first_int(m: Column | str, names: tuple[str, ...]) -> Column:
    """The first of the names whose value is a whole number."""
    return F.coalesce(*(F.try_element_at(m, F.lit(n)).try_cast("int") for n in names))


def vector(text: Column) -> Column:
    """Numbers from a JSON array or a bracketed or bare list; null if any is none."""
    bare = F.transform(F.split(F.regexp_replace(F.btrim(text), r"^\[|\]$", ""), ","), lambda x: F.btrim(x).try_cast("double"))
    parsed = F.coalesce(F.from_json(text, "array<double>"), bare)
    return F.when(F.btrim(text) != "", F.when((F.size(parsed) > 0) & ~F.exists(parsed, lambda x: x.isNull()), parsed))


def normalise(rows: DataFrame) -> DataFrame:
    """Chunks of rows (ordinal, m: MAP<STRING, STRING>); rows without a text are left out."""
    inner = F.coalesce(F.from_json(F.try_element_at("m", F.lit("metadata")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    base = rows.withColumn("inner", inner)
    start = F.coalesce(first_int("m", ALIASES["start_char"]), F.lit(0))
    text = first_string("m", ALIASES["text"])
    end = F.coalesce(first_int("m", ALIASES["end_char"]), start + F.length(text))
    row_vector = F.coalesce(*(F.nullif(F.try_element_at("m", F.lit(n)), F.lit("")) for n in VECTORS))
    nested_vector = F.coalesce(*(F.nullif(F.try_element_at("inner", F.lit(n)), F.lit("")) for n in VECTORS))
    rest = F.map_filter("m", lambda k, v: ~k.isin(*sorted(_RESERVED)) & v.isNotNull() & (v != ""))
    own = F.map_filter("inner", lambda k, v: ~k.isin(*VECTORS))
    merged = F.map_zip_with(rest, own, lambda k, a, b: F.coalesce(b, a))
    out = base.select(
        "ordinal",
        text.alias("text"),
        first_string("m", ALIASES["document_id"]).alias("document_id"),
        first_string("m", ALIASES["filename"]).alias("filename"),
        F.coalesce(first_int("m", ALIASES["chunk_index"]), F.pmod("ordinal", F.lit(1 << 31)).cast("int")).alias("chunk_index"),
        F.greatest(start, F.lit(0)).alias("start_char"),
        F.greatest(end, start).alias("end_char"),
        merged.alias("metadata"),
        vector(F.coalesce(row_vector, nested_vector)).alias("embedding"),
    ).where("text IS NOT NULL")
    return out.withColumns({"chunk_id": F.sha2(F.concat_ws("|", F.lit("existing"), "ordinal", F.coalesce("document_id", F.lit(""))), 256), "side": F.lit("existing")})


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, m) of a JSON array of objects, or of an object with one under chunks, data, items or results."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    listed = lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>"))
    rows = F.coalesce(listed(F.col("j")), *(listed(F.get_json_object("j", f"$.{k}")) for k in ("chunks", "data", "items", "results")))
    if not text.where(rows.isNull()).isEmpty():
        raise ExportError("the export is neither a JSON array nor an object with chunks, data, items or results")
    objects = F.filter(rows, lambda x: F.ltrim(x).startswith("{"))
    found = text.select(F.posexplode(objects).alias("ordinal", "o")).select("ordinal", F.from_json("o", "map<string,string>").alias("m")).where("m IS NOT NULL")
    return found.withColumn("ordinal", F.col("ordinal").cast("long"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, m) of a CSV file with a header."""
    t = spark.read.csv(path, header=True, multiLine=True, inferSchema=False, escape='"')
    clean = t.toDF(*[c.lstrip("﻿") for c in t.columns])
    pairs = [x for c in clean.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    return clean.select(F.monotonically_increasing_id().alias("ordinal"), F.create_map(*pairs).alias("m"))


def read(spark: SparkSession, path: str, most: int | None = MOST_CHUNKS) -> DataFrame:
    """Chunks of an export file; an error when none has a text or there are more than most (None: no limit)."""
    if not path.lower().endswith((".json", ".csv")):
        raise ExportError("an export is a .json or .csv file")
    rows = read_json(spark, path) if path.lower().endswith(".json") else read_csv(spark, path)
    chunks = normalise(rows)
    n = chunks.count()
    if not n and not rows.isEmpty():
        raise ExportError("no row of the export has a text")
    if most is not None and n > most:
        raise ExportError(f"the export has more than {most} chunks")
    return chunks
