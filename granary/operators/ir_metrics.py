"""Ranking metrics in long form (query_id, metric, k, value).

Judged frames have (query_id, rank, chunk_id, hit, n_relevant), with n_relevant on every row of a query.
Variant ``distinct`` counts each relevant chunk once and leaves out queries without relevant chunks;
variant ``list`` counts list positions, bounds k by the list and scores such queries 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.selection import exact_medians

KS = (1, 3, 5, 10)


def judge(retrieved: DataFrame, qrels: DataFrame) -> DataFrame:
    """Retrieved rows with their relevance by qrels (query_id, chunk_id)."""
    rel = qrels.select("query_id", "chunk_id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    marked = retrieved.join(rel.withColumn("r", F.lit(True)), ["query_id", "chunk_id"], "left").join(n, "query_id", "left")
    return marked.select("query_id", "rank", "chunk_id", F.coalesce("r", F.lit(False)).alias("hit"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def judge_by_label(retrieved: DataFrame, labels: DataFrame) -> DataFrame:
    """Retrieved rows, relevant where query and chunk carry the same label (id, label)."""
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    asked = labels.select(F.col("id").alias("query_id"), F.col("label").alias("ql"))
    found = labels.select(F.col("id").alias("chunk_id"), F.col("label").alias("cl"))
    marked = retrieved.join(asked, "query_id").join(found, "chunk_id").join(sizes.withColumnRenamed("label", "ql"), "ql")
    return marked.select("query_id", "rank", "chunk_id", (F.col("ql") == F.col("cl")).alias("hit"), "n_relevant")


def _first_time(judged: DataFrame) -> DataFrame:
    again = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    return judged.withColumn("fresh", F.row_number().over(again) == 1)


def _ideal(n: Column) -> Column:
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))).otherwise(0.0)


def retrieval_metrics(judged: DataFrame, ks: tuple[int, ...] = KS, variant: str = "list") -> DataFrame:
    """precision, recall, ndcg and hit_rate at each k, and mrr (k 0)."""
    rows = _first_time(judged).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k OR rank = 1")
    inside, distinct = F.col("rank") <= F.col("k"), variant == "distinct"
    hit = F.col("hit") & inside & (F.col("fresh") if distinct else F.lit(True))
    per = rows.groupBy("query_id", "k").agg(
        F.max("n_relevant").alias("rel"), F.count_if(hit).alias("hits"), F.count_if(inside).alias("n"),
        F.sum(F.when(F.col("hit") & inside, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"),
    )
    best = F.least("k", "rel") if distinct else F.least("k", "rel", "n")
    per = per.withColumn("ideal", _ideal(best)).select(
        "query_id", "k", "rel",
        F.expr("stack(4, 'precision', hits / {}, 'recall', if(rel > 0, hits / rel, 0), 'ndcg', if(ideal > 0, gain / ideal, 0), 'hit_rate', if(hits > 0, 1.0D, 0.0D)) as (metric, value)".format("k" if distinct else "least(k, n)")),
    )
    first = judged.groupBy("query_id").agg(F.max("n_relevant").alias("rel"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("r"))
    mrr = first.select("query_id", F.lit(0).alias("k"), "rel", F.lit("mrr").alias("metric"), F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("value"))
    out = per.unionByName(mrr)
    out = out.where("rel > 0") if distinct else out.withColumn("value", F.when(F.col("rel") > 0, F.col("value")).otherwise(0.0))
    return out.select("query_id", "metric", "k", "value")


def aggregate_scores(long: DataFrame) -> DataFrame:
    """(metric, k, mean, std, n_queries): population deviation over the queries that have the metric."""
    return long.groupBy("metric", "k").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.countDistinct("query_id").alias("n_queries"))


def aggregate_run(long: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row: avg_<metric>_at_<k> columns, avg_mrr, and the mean and exact median latency."""
    name = F.when(F.col("k") == 0, F.concat(F.lit("avg_"), "metric")).otherwise(F.concat_ws("_", F.lit("avg"), "metric", F.lit("at"), "k"))
    names = [r[0] for r in long.select(name.alias("n")).distinct().orderBy("n").collect()]  # one per metric and k
    means = long.withColumn("name", name).groupBy().pivot("name", names).agg(F.avg("value"))
    middle = exact_medians(latencies, [], "latency_ms").withColumnRenamed("median", "median_latency_ms")
    one = latencies.agg(F.avg("latency_ms").alias("avg_latency_ms")).join(middle, how="left")  # rows of one each
    return means.crossJoin(one)


def pair_results(queries: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paired by query_id, queries without a result, results without a query)."""
    return queries.join(results, "query_id"), queries.join(results, "query_id", "left_anti"), results.join(queries, "query_id", "left_anti")
