"""Demonstration corpora: JSON arrays of filename, title and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import VALUE


class SampleError(ValueError):
    """A sample that is unknown or incomplete."""


class SampleRegistry:
    """Named corpora; each is read once and kept."""

    def __init__(self, paths: dict[str, str]) -> None:
        self.paths = dict(paths)
        self._held: dict[str, DataFrame] = {}

    def names(self) -> list[str]:
        return sorted(self.paths)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        """The corpus's documents, or an error when one lacks a part."""
        if name not in self.paths:
            raise SampleError(f"there is no sample {name}")
        if name not in self._held:
            raw = spark.read.schema("filename string, title string, text string").json(self.paths[name], multiLine=True)
            blank = F.lit(False)
            for c in ("filename", "title", "text"):
                blank = blank | F.coalesce(F.btrim(c) == "", F.lit(True))
            if not raw.where(blank).isEmpty():
                raise SampleError(f"a document of {name} lacks its filename, title or text")
            none = F.create_map().cast(f"map<string,{VALUE}>")
            title = F.create_map(F.lit("title"), F.struct(F.col("title").alias("v"), F.lit("string").alias("t")))
            self._held[name] = raw.select(F.sha2(F.concat_ws("/", F.lit(name), "filename"), 256).alias("document_id"), F.monotonically_increasing_id().alias("ordinal"), "filename", "text", F.octet_length("text").cast("long").alias("file_size"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("modified_at"), title.alias("embedded"), none.alias("frontmatter"), F.concat_ws("/", F.lit(name), "filename").alias("source_path")).cache()
        return self._held[name]

    def clear(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held = {}
