"""File sources and sinks: knowledge, questions, references, results, examples and experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .json_items import file_stem, json_items, numbered

KNOWLEDGE_SCHEMA = "source_id string, input_type string, content string, metadata map<string,string>"
QUESTION_SCHEMA = "id string, question_text string, question_type string, prompt_strategy string, model_name string, reference string, source_id string"
STATS_COLUMNS = ("group", "metric_name", "n", "mean", "std", "median", "min", "max", "ci_low", "ci_high", "unit")
TABLE_KEYS = {"experiments": "experiment_id", "generated_questions": "question_id", "evaluation_results": None, "rag_runs": "run_id"}


def _parsed(items: DataFrame, schema: str) -> DataFrame:
    """``items`` with ``rows``: what an item holds, a line's array in full; null if it is no JSON."""
    wrapped = F.when(F.col("is_line") & F.startswith("item", F.lit("[")), F.col("item")).otherwise(F.concat(F.lit("["), "item", F.lit("]")))
    return items.withColumn("rows", F.from_json(wrapped, f"array<struct<{_fields(schema)}>>"))


def read_knowledge(spark: SparkSession, path: str, on_bad: str = "drop") -> DataFrame:
    """Entries with content from JSON lines (an object or an array each) or one document over many lines. A line that is no
    JSON is dropped, or kept as a text entry named by its file; an element of a document that is none is dropped."""
    rows = _parsed(json_items(spark, path), KNOWLEDGE_SCHEMA)
    good = rows.select(F.explode("rows").alias("i")).select("i.*").where("content IS NOT NULL")
    if on_bad == "drop":
        return good
    bad = rows.where("is_line AND (rows IS NULL OR exists(rows, i -> i IS NULL))").select(F.col("file").alias("source_id"), F.lit("text").alias("input_type"), F.col("item").alias("content"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return good.unionByName(bad)


def _fields(schema: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in schema.replace("map<string,string>", "map<string;string>").split(",")).replace(";", ",")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines, each an object or an array of objects, or from one document over many lines."""
    return _parsed(json_items(spark, path), QUESTION_SCHEMA).select(F.inline("rows")).where("question_text IS NOT NULL")


def _numbered(lines: DataFrame, name: str) -> DataFrame:
    """``lines`` with a running number from 1: within a part by its order, from part to part by their counts."""
    at = F.monotonically_increasing_id()
    lines = lines.withColumn("part", F.shiftright(at, 33)).withColumn("i", at.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = lines.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))  # one row per file split
    return lines.join(before, "part").withColumn(name, (F.col("before") + F.col("i") + 1).cast("long")).drop("part", "i", "before")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(pos, reference): the reference field, a JSON string, other JSON as text, or the raw line; pos is the
    line number from 1, running on from file to file in reading order."""
    lines = _numbered(spark.read.text(path), "pos")
    quoted = F.when(F.col("value").rlike(r'^\s*".*"\s*$'), F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0])
    return lines.select("pos", F.coalesce(F.get_json_object("value", "$.reference"), quoted, F.col("value")).alias("reference"))


def read_result_dir(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all JSON files of a folder with ``group``: the file stem without _results or _eval."""
    rows = _parsed(json_items(spark, f"{path}/*.json"), schema)
    return rows.select(file_stem(ending=r"(_results|_eval)?\.json$").alias("group"), F.explode("rows").alias("i")).where("i IS NOT NULL").select("i.*", "group")


def read_hotpot(spark: SparkSession, path: str) -> DataFrame:
    """Two-hop questions; ids default to q_<n>, difficulty to medium."""
    rows = _parsed(json_items(spark, path), "_id string, question string, answer string, level string")
    df = numbered(rows.select("file", "split", "n", F.posexplode("rows").alias("pos", "i")), "number", "n", "pos").select(F.col("number").alias("n"), "i.*")
    return df.select(F.coalesce("_id", F.concat(F.lit("q_"), F.col("n").cast("string"))).alias("question_id"), "question", "answer", F.lit(2).alias("hops"), F.coalesce("level", F.lit("medium")).alias("difficulty"))


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, content) from ``title | content`` lines; a line without a bar is all content."""
    lines = _numbered(spark.read.text(path).where("trim(value) <> ''"), "n")
    barred = F.contains("value", F.lit("|"))
    return lines.select(
        F.format_string("doc-%03d", "n").alias("doc_id"), F.when(barred, F.trim(F.substring_index("value", "|", 1))).otherwise(F.concat(F.lit("Doc "), F.col("n").cast("string"))).alias("title"),
        F.trim(F.regexp_replace("value", r"^[^|]*\|", "")).alias("content"),
    )


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Few-shot examples; malformed rows and rows lacking a required field are dropped."""
    df = spark.read.schema("ex_id long, knowledge string, question string, question_type string, strategy string").json(path, mode="DROPMALFORMED")
    return df.where("knowledge IS NOT NULL AND question IS NOT NULL AND question_type IS NOT NULL")


def list_experiments(spark: SparkSession, path: str) -> DataFrame:
    """One row per *_result.json, by path: id, name, models, strategies, counts, completion time."""
    schema = "project_id string, name string, models array<string>, strategies array<string>, questions array<string>, evaluations array<string>, completed_at string"
    df = json_items(spark, f"{path}/*_result.json").select(F.from_json("item", schema).alias("i"), F.col("file").alias("path")).where("i IS NOT NULL").select("i.*", "path")
    return df.select(
        "project_id", "name", F.array_join("models", ",").alias("models"), F.array_join("strategies", ",").alias("strategies"),
        F.coalesce(F.size("questions"), F.lit(0)).alias("n_questions"), F.coalesce(F.size("evaluations"), F.lit(0)).alias("n_evaluations"), "completed_at", "path",
    ).orderBy("path")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_stats_csv(df: DataFrame, path: str) -> None:
    """Statistics with the fixed header; columns the frame lacks are empty."""
    df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in STATS_COLUMNS)).write.mode("overwrite").option("header", True).csv(path)


def save_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Named tables as Parquet below ``root``; a repeated key stops before anything is written."""
    for name, df in tables.items():
        key = TABLE_KEYS.get(name)
        if key and not df.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{name}: {key} is not unique")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
