"""Structured Streaming ingest: documents to fixed-size chunks, appended exactly once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from granary.operators.text import chunk_fixed


def stream_chunks(spark: SparkSession, path: str, out: str, checkpoint: str, size: int = 512, overlap: int = 50) -> StreamingQuery:
    """Chunk every new Parquet file of documents below ``path`` into ``out``/batch=<n>; a batch that is
    replayed overwrites its own folder."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.readStream.schema(schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        chunk_fixed(batch, size, overlap).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
