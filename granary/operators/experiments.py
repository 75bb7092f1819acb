"""Experiment matrices, statistics, comparisons and reports.

Scores are long: question_id, model, strategy, question_type, metric_name, score.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.selection import exact_medians
from granary.functions.student import p_value, t_quantile

CONDITION = ("model", "strategy", "question_type")
# Name parts that tell a model's provider, in the order they are tried.
PROVIDERS = (("gpt", "openai"), ("openai", "openai"), ("deepseek", "deepseek"), ("claude", "claude"))


def experiment_matrix(knowledge: DataFrame, models: list[str], strategies: list[str], types: list[str]) -> DataFrame:
    """Every knowledge row under every condition."""
    out = knowledge
    for name, values in zip(CONDITION, (models, strategies, types), strict=True):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def template_questions(matrix: DataFrame, preview: int = 50) -> DataFrame:
    """Placeholder questions with ids derived from the condition."""
    head = F.substring(F.coalesce("content", F.lit("")), 1, preview)
    text = (
        F.when(F.col("question_type") == "factual", F.concat(F.lit("What is described by: "), head, F.lit("?")))
        .when(F.col("question_type") == "schema", F.concat(F.lit("What is the structure of: "), head, F.lit("?")))
        .otherwise(F.concat(F.lit("How do the parts relate in: "), head, F.lit("?")))
    )
    return matrix.withColumn("question_text", text).withColumn("question_id", F.substring(F.sha2(F.concat_ws("/", "source_id", *CONDITION), 256), 1, 12))


def align_references(questions: DataFrame, refs: DataFrame) -> DataFrame:
    """Questions with their source's first reference (source_id, pos, reference), empty if none."""
    first = refs.groupBy("source_id").agg(F.min(F.struct("pos", "reference")).alias("f")).select("source_id", "f.reference")
    return questions.join(first, "source_id", "left").withColumn("reference", F.coalesce("reference", F.lit("")))


def provider(model: Column) -> Column:
    low, out = F.lower(model), None
    for part, name in PROVIDERS:
        out = F.when(low.contains(part), name) if out is None else out.when(low.contains(part), name)
    return out.otherwise("ollama")


def provider_breakdown(questions: DataFrame) -> DataFrame:
    return questions.groupBy(provider(F.col("model")).alias("provider")).agg(F.count("*").alias("n"))


def condition_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*CONDITION).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def marginal_means(scores: DataFrame) -> DataFrame:
    """(factor, level, metric_name, mean, n) by model, strategy and type in one pass."""
    sets = [[F.col(c), F.col("metric_name")] for c in CONDITION]
    grouped = scores.groupingSets(sets, *(F.col(c) for c in CONDITION), F.col("metric_name")).agg(
        F.avg("score").alias("mean"), F.count("*").alias("n"), *(F.grouping(c).alias(f"g_{c}") for c in CONDITION)
    )
    factor, level = (F.coalesce(*(F.when(F.col(f"g_{c}") == 0, v(c)) for c in CONDITION)) for v in (F.lit, F.col))
    return grouped.select(factor.alias("factor"), level.alias("level"), "metric_name", "mean", "n")


def _moments(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(F.col(by).alias("g")).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.var_pop("score").alias("vp"), F.var_samp("score").alias("vs"))


def _two(a: str, b: str, population: bool) -> dict[str, Column]:
    c = F.col
    v = "vp" if population else "vs"
    pooled = F.sqrt((c(f"{a}_{v}") + c(f"{b}_{v}")) / 2)
    ra, rb = c(f"{a}_vs") / c(f"{a}_n"), c(f"{b}_vs") / c(f"{b}_n")
    diff = c(f"{b}_mean") - c(f"{a}_mean")
    return {
        "difference": diff, "percent_change": F.when(c(f"{a}_mean") != 0, 100 * diff / F.abs(c(f"{a}_mean"))).otherwise(0.0),
        "cohens_d": F.when((c(f"{a}_n") > 1) & (c(f"{b}_n") > 1) & (pooled > 0), diff / pooled).otherwise(0.0),
        "welch_t": F.when(ra + rb > 0, diff / F.sqrt(ra + rb)),
        "welch_df": F.when(ra + rb > 0, (ra + rb) * (ra + rb) / (ra * ra / (c(f"{a}_n") - 1) + rb * rb / (c(f"{b}_n") - 1))),
    }


def effect_size(a: str = "a", b: str = "b") -> Column:
    """Cohen's d of moment columns with sample variances; 0 where a group has no spread or one row."""
    return _two(a, b, False)["cohens_d"]


def compare(scores: DataFrame, by: str, a: str, b: str, pair_on: list[str]) -> DataFrame:
    """One row: means, difference, percent change, paired t if both sides pair up fully, else Welch's t,
    p, Cohen's d with population variances, significance at .05."""
    m = _moments(scores.where(F.col(by).isin(a, b)), by)
    side = [m.where(F.col("g") == v).select(*(F.col(x).alias(f"{s}_{x}") for x in ("n", "mean", "vp", "vs"))) for v, s in ((a, "a"), (b, "b"))]
    left, right = (scores.where(F.col(by) == v).groupBy(*pair_on).agg(F.avg("score").alias(s), F.count("*").alias(f"n{s}")) for v, s in ((a, "sa"), (b, "sb")))
    d = left.join(right, pair_on).agg(F.count("*").alias("pairs"), F.avg(F.col("sb") - F.col("sa")).alias("d_mean"), F.stddev_samp(F.col("sb") - F.col("sa")).alias("d_std"))
    row = side[0].crossJoin(side[1]).crossJoin(d)  # three rows of one
    two = _two("a", "b", True)
    paired = (F.col("a_n") == F.col("b_n")) & (F.col("pairs") == F.col("a_n")) & (F.col("pairs") > 1)
    t = F.when(paired, F.when(F.col("d_std") > 0, F.col("d_mean") / (F.col("d_std") / F.sqrt("pairs")))).otherwise(two["welch_t"])
    df = F.when(paired, F.col("pairs") - 1).otherwise(two["welch_df"])
    out = row.select(
        F.lit(a).alias("baseline"), F.lit(b).alias("comparison"), F.col("a_mean").alias("baseline_mean"), F.col("b_mean").alias("comparison_mean"),
        two["difference"].alias("difference"), two["percent_change"].alias("percent_change"), two["cohens_d"].alias("cohens_d"),
        F.when(paired, "paired").otherwise("welch").alias("test"), t.alias("t"), df.cast("double").alias("df"),
    )
    return out.withColumn("p", p_value(F.col("t"), F.col("df"))).withColumn("significant", F.coalesce(F.col("p") < 0.05, F.lit(False)))


def compare_all(scores: DataFrame, by: str) -> DataFrame:
    """Welch comparisons of every two groups in name order, with sample variances."""
    m = _moments(scores, by)
    a, b = (m.select(*(F.col(x).alias(f"{s}_{x}") for x in m.columns)) for s in "ab")
    two = _two("a", "b", False)
    out = a.join(b, F.col("a_g") < F.col("b_g")).select(
        F.col("a_g").alias("baseline"), F.col("b_g").alias("comparison"), F.col("a_mean").alias("baseline_mean"), F.col("b_mean").alias("comparison_mean"),
        *(two[k].alias(n) for k, n in (("difference", "difference"), ("percent_change", "percent_change"), ("cohens_d", "cohens_d"), ("welch_t", "t"), ("welch_df", "df"))),
    )
    return out.withColumn("p", p_value(F.col("t"), F.col("df"))).withColumn("significant", F.coalesce(F.col("p") < 0.05, F.lit(False)))


def comparison_table(compared: DataFrame) -> DataFrame:
    four = [F.bround(c, 4).alias(c) for c in ("baseline_mean", "comparison_mean", "difference", "cohens_d")]
    return compared.select("baseline", "comparison", *four, F.bround("percent_change", 2).alias("percent_change"))


def describe(long: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """Count, mean, sample deviation (0 for one row), median, extremes and t interval by group."""
    s = long.groupBy(*by).agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"),
        F.min("score").alias("min"), F.max("score").alias("max"),
    )
    middle = exact_medians(long, by, "score").select(*(F.col(c).alias(f"middle_{c}") for c in by), "median")
    s = s.join(middle, reduce(and_, (F.col(c).eqNullSafe(F.col(f"middle_{c}")) for c in by), F.lit(True)), "left")
    half = t_quantile(level, F.col("n") - 1) * F.col("std") / F.sqrt("n")
    s = s.withColumn("half", F.when((F.col("n") > 1) & (F.col("std") > 0), half))
    return s.select(*by, "n", *(F.bround(c, 4).alias(c) for c in ("mean", "std", "median", "min", "max")), F.bround(F.col("mean") - F.col("half"), 4).alias("ci_low"), F.bround(F.col("mean") + F.col("half"), 4).alias("ci_high"))


def describe_by(df: DataFrame, group_by: list[str], metrics: list[str], level: float = 0.95) -> DataFrame:
    """``describe`` of metric columns over any fields; list fields count once per element, missing is unknown."""
    for c in group_by:
        if df.schema[c].dataType.typeName() == "array":
            df = df.withColumn(c, F.explode_outer(c))
    key = F.concat_ws(" / ", *(F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in group_by))
    long = df.select(key.alias("group"), *metrics).unpivot("group", metrics, "metric_name", "score").where("score IS NOT NULL")
    return describe(long, ["group", "metric_name"], level)


def rankings(long: DataFrame, group: str) -> DataFrame:
    """(metric_name, group, mean, rank) by descending mean."""
    means = long.groupBy("metric_name", group).agg(F.avg("score").alias("mean"))
    order = Window.partitionBy("metric_name").orderBy(F.desc(F.round("mean", 9)), group)
    return means.withColumn("rank", F.row_number().over(order))


def assemble_long(quality: DataFrame, auto: DataFrame, retrieval: DataFrame, generation: DataFrame) -> DataFrame:
    """(group, metric_name, score) of all evaluation parts."""
    return (
        quality.select(F.concat_ws("_", "model", "strategy").alias("group"), F.col("dimension").alias("metric_name"), "score")
        .unionByName(auto.select(F.lit("all").alias("group"), "metric_name", "score"))
        .unionByName(retrieval.select(F.lit("rag_retrieval").alias("group"), F.when(F.col("k") == 0, F.col("metric")).otherwise(F.concat_ws("@", "metric", "k")).alias("metric_name"), F.col("value").alias("score")))
        .unionByName(generation.select(F.lit("rag_generation").alias("group"), "metric_name", "score"))
    )


def metric_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric_name").agg(
        F.count("score").alias("count"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.min("score").alias("min"), F.max("score").alias("max")
    )


def score_matrix(scores: DataFrame, row: str, column: str, values: list[str] | None = None) -> DataFrame:
    """Mean scores of row by column, 0 where there are none."""
    return scores.groupBy(row).pivot(column, values).agg(F.avg("score")).na.fill(0.0)


def experiment_summary(questions: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, strategy by metric means)."""
    totals = questions.agg(F.count("*").alias("n_questions"), *(F.countDistinct(c).alias(f"n_{c}") for c in CONDITION))
    n = scores.agg(F.count("*").alias("n_scores"), F.countDistinct("metric_name").alias("n_metrics"))
    joined = scores.select("question_id", "metric_name", "score").join(questions.select("question_id", "strategy"), "question_id")
    return totals.crossJoin(n), score_matrix(joined, "strategy", "metric_name")


def compare_runs(scores: DataFrame) -> DataFrame:
    """(strategy, metric_name, mean, best): means over runs; the best of a metric is flagged if above 0."""
    means = scores.groupBy("strategy", "metric_name").agg(F.bround(F.avg("score"), 4).alias("mean"))
    top = F.max("mean").over(Window.partitionBy("metric_name"))
    return means.withColumn("best", (F.col("mean") == top) & (F.col("mean") > 0))


def page(df: DataFrame, sort_by: str, id_col: str, order: str = "desc", number: int = 1, per_page: int = 20) -> tuple[DataFrame, DataFrame]:
    """(the rows of a page, one row with the total)."""
    if number < 1 or not 1 <= per_page <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    key = F.desc(sort_by) if order == "desc" else F.asc(sort_by)
    return df.orderBy(key, id_col).offset((number - 1) * per_page).limit(per_page), df.agg(F.count("*").alias("total"))


def batch_outcome(df: DataFrame, by: list[str]) -> DataFrame:
    """Totals, successes, failures and latency of rows (ok, latency_ms)."""
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.sum("latency_ms").alias("total_latency"), F.avg("latency_ms").alias("mean_latency")
    )


def validate_experiments(df: DataFrame, existing: DataFrame) -> DataFrame:
    """``df`` (experiment_id, models, strategies, types) with the reasons against creating each."""
    known = existing.select("experiment_id").distinct().withColumn("known", F.lit(True))
    reasons = F.array_compact(F.array(
        F.when(F.col("known"), F.lit("duplicate")), F.when(F.length("experiment_id") > 100, F.lit("id too long")),
        *(F.when(F.coalesce(F.size(c), F.lit(0)) < 1, F.lit(f"no {c}")) for c in ("models", "strategies", "types")),
    ))
    return df.join(known, "experiment_id", "left").withColumn("reasons", reasons).drop("known")


def find_experiment(df: DataFrame, experiment_id: str) -> DataFrame:
    """The experiment of that id, else the first whose id contains it."""
    exact = df.where(F.col("experiment_id") == experiment_id).withColumn("place", F.lit(0))
    near = df.where(F.contains("experiment_id", F.lit(experiment_id))).withColumn("place", F.lit(1))
    return exact.unionByName(near).orderBy("place", "experiment_id").limit(1).drop("place")


def report_frames(scores: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The report's frames over a score table, each made when it is called."""
    return {
        "conditions": lambda: condition_summary(scores), "marginals": lambda: marginal_means(scores), "statistics": lambda: describe(scores, ["strategy", "metric_name"]),
        "rankings": lambda: rankings(scores, "model"), "summary": lambda: metric_summary(scores), "comparisons": lambda: compare_all(scores, "strategy"),
    }


def evaluate(spark: SparkSession, stages: dict[str, Callable[[], DataFrame]], path: str) -> DataFrame:
    """Run the stages in order, such as quality, metrics, retrieval and the report's frames, and export each
    as Parquet below ``path``: (stage, n, error). A stage that fails, when it is planned or when it runs, has
    its error there and does not stop the others."""
    told = []
    for name, make in stages.items():
        try:
            make().write.mode("overwrite").parquet(f"{path}/{name}")
            told.append((name, spark.read.parquet(f"{path}/{name}").count(), None))
        except Exception as e:  # whatever a stage raises is its own affair
            told.append((name, None, type(e).__name__))
    return spark.createDataFrame(told, "stage string, n long, error string")
