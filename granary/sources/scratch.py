"""Tables that an operator writes and reads again, so that later steps do not repeat earlier ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; a local session without one (tests) uses its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/granary-files/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
