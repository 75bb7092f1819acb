"""Exact medians by counting: no task holds the values of a group, only counts of buckets of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import saved

#: A value's 64 bits are settled in three steps, so a step counts at most 2**22 buckets of a group.
SHIFTS = (42, 21, 0)
_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


def _ordered(values: pa.Array) -> pa.Array:
    """Integers in the order of the doubles; NaN is the largest, and both zeros are one."""
    x = values.to_numpy(zero_copy_only=False) + 0.0
    x = np.where(np.isnan(x), np.nan, x)  # one NaN, without a sign
    bits = x.view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ _SIGN, bits))


def _restored(keys: pa.Array) -> pa.Array:
    bits = keys.to_numpy(zero_copy_only=False)
    return pa.array(np.where(bits < 0, bits ^ _SIGN, bits).view(np.float64))


def exact_medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(*by, median): exact median of the values that are not null, the mean of the two middle ones for even counts.

    Every step counts, in the tasks first, how many values fall into each bucket of the next bits, and goes on with
    the one bucket of each group that holds a middle value.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = saved(df.select(group.alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL").select("g", F.arrow_udf(_ordered, "long")("v").alias("key")), "keys")
    n = rows.groupBy("g").agg(F.count("*").alias("n"))
    middle = n.select("g", F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))).alias("rank"))
    middle = middle.withColumn("which", F.col("rank"))
    left = rows
    for step, shift in enumerate(SHIFTS):
        keys = ["g", "which"] if step else ["g"]
        if step:
            chosen = middle.select(F.col("g").alias("cg"), "which", F.col("bucket").alias("cb"))
            left = rows.join(chosen, (F.col("g") == F.col("cg")) & (F.shiftright("key", SHIFTS[step - 1]) == F.col("cb"))).select("g", "which", "key")
        counts = left.groupBy(*keys, F.shiftright("key", shift).alias("bucket")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bucket"))
        counts = counts.withColumn("before", upto - F.col("c"))
        middle = middle.select("g", "which", "rank").join(counts, keys).where("before <= rank AND rank < before + c").select("g", "which", (F.col("rank") - F.col("before")).alias("rank"), "bucket")
    found = middle.groupBy("g").agg(F.avg(F.arrow_udf(_restored, "double")("bucket")).alias("median"))
    return found.select(*(F.col(f"g.{c}").alias(c) for c in by), "median")
