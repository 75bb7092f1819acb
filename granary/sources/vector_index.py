"""A folder of vectors that grows by checked batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

STAGED = "_staged"


class RefusedBatch(ValueError):
    """A batch that does not fit; the index is as it was."""


def append_batch(chunks: DataFrame, vectors: DataFrame, path: str, dim: int) -> dict[str, int]:
    """Add the vectors (chunk_id, embedding) of ``chunks`` (chunk_id) to the index at ``path``, or raise RefusedBatch.

    The batch is written once, to a folder that readers pass over, and measured while it is written: rows, chunks
    without a vector or named twice, vectors without a chunk or with another length, values that are no numbers, and
    norms of zero, which are only reported. If all agree, the folder is renamed into place, which is one step, so readers see all of a batch or nothing. Returns
    the measurements.
    """
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    asked = chunks.groupBy("chunk_id").agg(F.count("*").alias("asked"))
    given = vectors.select(F.col("chunk_id").alias("id"), "embedding", F.count("*").over(Window.partitionBy("chunk_id")).alias("times"))
    both = given.join(asked, F.col("id") == F.col("chunk_id"), "full_outer")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    seen = Observation(f"batch-{name}")
    watched = both.observe(
        seen, F.count("embedding").alias("rows"), F.count_if((F.col("asked") > 1) | (F.col("times") > 1)).alias("repeated"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("unasked"),
        F.count_if(F.size("embedding") != dim).alias("other_length"), F.count_if(odd).alias("no_number"), F.count_if(norm == 0).alias("zero"),
    )
    staged = f"{path.rstrip('/')}/{STAGED}/{name}"
    watched.select(F.coalesce("id", "chunk_id").alias("chunk_id"), "embedding").write.parquet(staged)
    found = {k: int(v) for k, v in seen.get.items()}
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    wrong = [f"{k}={found[k]}" for k in ("missing", "unasked", "repeated", "other_length", "no_number") if found[k]]
    if wrong:
        fs.delete(folder(staged), True)
        raise RefusedBatch(", ".join(wrong))
    if not fs.rename(folder(staged), folder(f"{path.rstrip('/')}/batch={name}")):
        raise RefusedBatch(f"{staged} could not be moved into place")
    return found


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of all batches that were accepted."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*").drop("batch")
