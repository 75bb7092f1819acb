"""Input frames of the registered queries, written once as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from granary.sources.scratch import scratch_path

__all__ = ["frame", "plain", "scratch_path", "table"]


#: Tables of texts with their keys: work on a text costs more than moving it.
TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that lie in fewer parts than there are cores are dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, TEXTS[name]) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` with table names in braces, over the given tables."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The same SQL for an engine that knows the tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


KNOWLEDGE = """
    SELECT 'c' || c_custkey AS source_id, 'triple' AS input_type, '' AS metadata,
           CASE c_custkey % 3 WHEN 0 THEN c_name || ' | from_nation | ' || n_name
                WHEN 1 THEN '(' || c_name || ', from_nation, ' || n_name || ') (' || c_name || ' , in_segment, ' || c_mktsegment || ')'
                ELSE c_name || ', from_nation,  ' || n_name END AS content
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
    UNION ALL
    SELECT 'p' || p_partkey, 'schema', '', 'Part:brand -> ' || p_brand || chr(10) || 'Part : type -> ' || p_type || '; Part:size -> ' || p_size FROM {part}
    UNION ALL
    SELECT 's' || s_suppkey, 'entity', '', s_name || ' [Supplier] ' || chr(123) || 'nation: ' || n_name || ', key: ' || s_suppkey || chr(125)
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
    UNION ALL
    SELECT 'd' || doc_id, 'text', '', text FROM {documents}
"""

TRIPLES = """
    SELECT 'nation ' || n_name AS subject, 'in_region' AS predicate, 'region ' || r_name AS object FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 'supplier ' || s_suppkey, 'from_nation', 'nation ' || n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
    UNION ALL
    SELECT 'customer ' || c_custkey, 'from_nation', 'nation ' || n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""
