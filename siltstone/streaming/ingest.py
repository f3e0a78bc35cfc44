"""Continuous ingestion: new files are parsed, chunked and compared with the index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import chunker, embedding, similarity
from siltstone.sources import documents

_FILE = "path string, modificationTime timestamp, length long, content binary"


def incoming_documents(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of parsed documents from the files that appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return documents.parse_files(files)


def incoming_chunks(docs: DataFrame, config: chunker.ChunkConfig = chunker.ChunkConfig()) -> DataFrame:
    """The chunks of a stream of documents, without state."""
    return chunker.chunk(docs.where("error IS NULL"), config)


def watch(spark: SparkSession, folder: str, index: str, findings: str, checkpoint: str, config: chunker.ChunkConfig = chunker.ChunkConfig(), floor: float = similarity.NEAR, embedder: embedding.Embedder = embedding.hashed_bigrams) -> StreamingQuery:
    """Compares each batch's chunks with the index, a Parquet folder of chunks, and appends them to it.

    Pairs with a cosine of floor at least are written to findings. A batch that
    runs again after a failure replaces what it had written: its folders bear
    its number.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = embedding.embed(incoming_chunks(batch, config), embedder).where("embedding IS NOT NULL").withColumn("side", F.lit("new"))
        mine = f"{index}/batch={number}"
        new.write.mode("overwrite").parquet(mine)
        new = spark.read.parquet(mine)
        known = spark.read.parquet(index).where(F.col("batch") < number).withColumn("side", F.lit("existing")).select(*new.columns)
        pairs = similarity.scores(new.unionByName(known), floor)
        pairs.write.mode("overwrite").parquet(f"{findings}/batch={number}")

    return incoming_documents(spark, folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
