"""Queries of file sources and sinks: tables written in a source's notation and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.sources import files as S

from .common import scratch_path, table


def _written(spark, lines, name):
    path = scratch_path(spark, name)
    lines.toDF("value").write.text(path)
    return path


def _docs(spark, sf):
    return table(spark, sf, "documents")


def src1(spark, sf):
    entry = F.to_json(F.struct(F.col("doc_id").cast("string").alias("source_id"), F.lit("text").alias("input_type"), F.when(F.col("doc_id") % 7 > 0, F.col("text")).alias("content")))
    line = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("broken "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("["), entry, F.lit("]"))).otherwise(entry)
    read = S.read_knowledge(spark, _written(spark, _docs(spark, sf).select(line), "knowledge"), "text")
    return read.select(F.when(F.startswith("content", F.lit("broken ")), F.lit("file")).otherwise(F.col("source_id")).alias("source_id"), F.sha2("content", 256).alias("content_sha256"))


def src2(spark, sf):
    q = table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question_text")))).alias("line"))
    one = F.when(F.col("conv_id") % 2 == 0, F.col("line")).otherwise(F.regexp_replace("line", r"^\[(\{[^}]*\}).*$", "$1"))
    read = S.read_questions(spark, _written(spark, q.select(one), "questions"))
    return read.groupBy(F.substring_index("id", "-", 1).cast("long").alias("conv_id")).agg(F.count("*").alias("n"))


def src3(spark, sf):
    kind = F.col("doc_id") % 3
    line = F.when(kind == 0, F.to_json(F.struct(F.col("lang").alias("reference")))).when(kind == 1, F.concat(F.lit('"'), "source", F.lit('"'))).otherwise(F.concat(F.lit("raw "), "source"))
    return S.read_references(spark, _written(spark, _docs(spark, sf).select(line), "references")).groupBy("reference").agg(F.count("*").alias("n"))


def _pretty(spark, listed, name):
    """Documents (name, items) as JSON arrays over many lines."""
    value = F.to_json("items", {"pretty": "true"})
    return _named_files(spark, listed.select("name", value.alias("value")), scratch_path(spark, name))


def src1_document(spark, sf):
    """Files of FILE_ROWS documents each, as arrays over many lines; every seventh entry has no content."""
    item = F.struct(F.col("doc_id").cast("string").alias("source_id"), F.lit("text").alias("input_type"), F.when(F.col("doc_id") % 7 > 0, F.col("text")).alias("content"))
    listed = _docs(spark, sf).groupBy(F.concat(F.lit("k"), F.floor(F.col("doc_id") / FILE_ROWS).cast("string")).alias("name")).agg(F.collect_list(item).alias("items"))
    return S.read_knowledge(spark, _pretty(spark, listed, "knowledge")).select("source_id", F.sha2("content", 256).alias("content_sha256"))


def src2_document(spark, sf):
    """A file for each fifty conversations, of the questions as an array over many lines."""
    item = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question_text"), F.col("role").alias("question_type"))
    listed = table(spark, sf, "conversations").where("role = 'user'").groupBy(F.concat(F.lit("c"), F.floor(F.col("conv_id") / 50).cast("string")).alias("name")).agg(F.collect_list(item).alias("items"))
    return S.read_questions(spark, _pretty(spark, listed, "questions")).select("id", "question_type", F.sha2("question_text", 256).alias("text_sha256"))


def src3_quoted(spark, sf):
    """Whole texts as JSON strings, with their escapes."""
    line = F.expr("substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)")
    read = S.read_references(spark, _written(spark, _docs(spark, sf).where("text IS NOT NULL").select(line), "references"))
    return read.groupBy(F.sha2("reference", 256).alias("reference_sha256")).agg(F.count("*").alias("n"))


def src6(spark, sf):
    line = F.when(F.col("doc_id") % 4 == 0, F.lit("")).when(F.col("doc_id") % 4 == 1, F.concat_ws(" | ", "lang", "source", F.lit("x"))).otherwise(F.col("source"))
    read = S.read_document_lines(spark, _written(spark, _docs(spark, sf).select(line), "lines"))
    return read.groupBy("content").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"), F.count_if(F.startswith("title", F.lit("Doc "))).alias("untitled"))


def src7(spark, sf):
    entry = F.to_json(F.struct(F.col("doc_id").alias("ex_id"), F.col("source").alias("knowledge"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("question"), F.lit("factual").alias("question_type")))
    line = F.when(F.col("doc_id") % 11 == 0, F.lit("{broken")).otherwise(entry)
    return S.read_examples(spark, _written(spark, _docs(spark, sf).select(line), "examples")).select("ex_id", "knowledge", "question")


def _named_files(spark, rows, path):
    """Rows (name, value) as files ``name``.json: one partition folder each, then renamed where they lie."""
    rows.repartition("name").write.partitionBy("name").text(f"{path}-parts")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(path))
    for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}-parts/name=*/part-*")):
        name = part.getPath().getParent().getName().removeprefix("name=")
        fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.json"))
    return path


#: Rows that one JSON file holds.
FILE_ROWS = 500


def src4(spark, sf):
    """Result files of FILE_ROWS documents each, half of them named _results and half _eval."""
    part = F.floor(F.col("doc_id") / FILE_ROWS)
    name = F.concat(F.lit("run"), part.cast("string"), F.when(part % 2 == 0, "_results").otherwise("_eval"))
    listed = _docs(spark, sf).groupBy(name.alias("name")).agg(F.to_json(F.collect_list(F.struct("doc_id", "lang"))).alias("value"))
    read = S.read_result_dir(spark, _named_files(spark, listed, scratch_path(spark, "results")), "doc_id long, lang string")
    return read.select("doc_id", "lang", "group")


def src5(spark, sf):
    """Question files; every fourth question has no id and every third no level, and ids run on from file to file."""
    item = F.struct(
        F.when(F.col("doc_id") % 4 > 0, F.col("doc_id").cast("string")).alias("_id"), F.concat(F.lit("What says "), "source", F.lit("?")).alias("question"),
        F.col("lang").alias("answer"), F.when(F.col("doc_id") % 3 > 0, F.lit("hard")).alias("level"),
    )
    name = F.format_string("part%08d", F.floor(F.col("doc_id") / FILE_ROWS))
    listed = _docs(spark, sf).groupBy(name.alias("name")).agg(F.to_json(F.collect_list(item)).alias("value"))
    read = S.read_hotpot(spark, _named_files(spark, listed, scratch_path(spark, "hotpot")))
    numbered = F.col("question_id").startswith("q_")
    known = read.where(~numbered).select("question_id", "question", "answer", "hops", "difficulty")
    # Which number a question without an id gets depends on the files' order: all differ and stay below the count.
    made = read.where(numbered).select(F.regexp_replace("question_id", "^q_", "").cast("long").alias("n"), "difficulty").crossJoin(F.broadcast(read.agg(F.count("*").alias("total"))))
    made = made.groupBy("difficulty").agg(F.countDistinct("n").cast("string").alias("question_id"), F.when(F.max("n") < F.max("total"), "numbered").alias("question"), F.lit("").alias("answer"), F.lit(2).alias("hops"))
    return known.unionByName(made)


def src8(spark, sf):
    """One experiment for each hundred customers of a segment."""
    c = table(spark, sf, "customer")
    key = F.concat_ws("-", F.lower("c_mktsegment"), F.floor(F.col("c_custkey") / 100).cast("string"))
    listed = c.groupBy(key.alias("project_id")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))).alias("models"), F.collect_list("c_name").alias("questions"), F.min("c_name").alias("completed_at")
    ).select(F.concat("project_id", F.lit("_result")).alias("name"), F.to_json(F.struct("project_id", F.col("project_id").alias("name"), "models", F.array(F.lit("cot")).alias("strategies"), "questions", "completed_at")).alias("value"))
    read = S.list_experiments(spark, _named_files(spark, listed, scratch_path(spark, "experiments")))
    return read.select("project_id", "name", "models", "strategies", "n_questions", "n_evaluations", "completed_at")


def snk1(spark, sf):
    path = scratch_path(spark, "json")
    S.write_json(_docs(spark, sf).select("doc_id", "text"), path)
    return spark.read.schema("doc_id long, text string").json(path).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def snk2(spark, sf):
    path = scratch_path(spark, "csv")
    stats = _docs(spark, sf).groupBy(F.col("source").alias("group"), F.lit("n_chars").alias("metric_name")).agg(F.count("*").alias("n"), F.min("n_chars").alias("min"), F.max("n_chars").alias("max"))
    S.write_stats_csv(stats, path)
    read = spark.read.option("header", True).csv(path)
    return read.select("group", "metric_name", *(F.col(c).cast("long").alias(c) for c in ("n", "min", "max")), F.lit(len(read.columns)).alias("n_columns"))


def snk3(spark, sf):
    path = scratch_path(spark, "tables")
    S.save_tables({"rag_runs": _docs(spark, sf).select(F.col("doc_id").cast("string").alias("run_id"), "lang"), "evaluation_results": table(spark, sf, "labels")}, path)
    return spark.read.parquet(f"{path}/rag_runs").groupBy("lang").agg(F.count("*").alias("n"))


QUERIES = {
    "src1_read_knowledge": src1, "src2_read_questions": src2, "src1_read_document": src1_document, "src2_read_document": src2_document, "src3_quoted": src3_quoted, "src3_read_references": src3, "src4_read_result_dir": src4,
    "src5_read_hotpot": src5, "src8_list_experiments": src8, "src6_read_document_lines": src6, "src7_read_examples": src7,
    "snk1_write_json": snk1, "snk2_write_stats_csv": snk2, "snk3_save_tables": snk3,
}
ORACLE = {
    "src1_read_knowledge": """SELECT CASE WHEN doc_id % 10 = 0 THEN 'file' ELSE CAST(doc_id AS VARCHAR) END AS source_id, sha256(CASE WHEN doc_id % 10 = 0 THEN 'broken ' || doc_id ELSE text END) AS content_sha256
        FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 > 0""",
    "src1_read_document": "SELECT CAST(doc_id AS VARCHAR) AS source_id, sha256(text) AS content_sha256 FROM documents WHERE doc_id % 7 > 0 AND text IS NOT NULL",
    "src2_read_document": "SELECT conv_id || '-' || turn AS id, role AS question_type, sha256(text) AS text_sha256 FROM conversations WHERE role = 'user' AND text IS NOT NULL",
    "src3_quoted": "SELECT sha256(text) AS reference_sha256, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "src2_read_questions": "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN count(*) ELSE 1 END AS n FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "src3_read_references": "SELECT CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE 'raw ' || source END AS reference, count(*) AS n FROM documents GROUP BY 1",
    "src4_read_result_dir": f"SELECT doc_id, lang, 'run' || (doc_id // {FILE_ROWS}) AS \"group\" FROM documents",
    "src5_read_hotpot": """SELECT CAST(doc_id AS VARCHAR) AS question_id, 'What says ' || source || '?' AS question, lang AS answer, 2 AS hops, CASE WHEN doc_id % 3 > 0 THEN 'hard' ELSE 'medium' END AS difficulty FROM documents WHERE doc_id % 4 > 0
        UNION ALL SELECT CAST(count(*) AS VARCHAR), 'numbered', '', 2, CASE WHEN doc_id % 3 > 0 THEN 'hard' ELSE 'medium' END FROM documents WHERE doc_id % 4 = 0 GROUP BY 5""",
    "src8_list_experiments": """SELECT p AS project_id, p AS name, string_agg(DISTINCT 'n' || c_nationkey, ',' ORDER BY 'n' || c_nationkey) AS models, 'cot' AS strategies, CAST(count(*) AS INT) AS n_questions, 0 AS n_evaluations, min(c_name) AS completed_at
        FROM (SELECT *, lower(c_mktsegment) || '-' || c_custkey // 100 AS p FROM customer) AS c GROUP BY p""",
    "src6_read_document_lines": """SELECT CASE doc_id % 4 WHEN 1 THEN source || ' | x' ELSE source END AS content, count(*) AS n, count(*) AS n_ids, count(*) FILTER (doc_id % 4 > 1) AS untitled FROM documents WHERE doc_id % 4 > 0 GROUP BY 1""",
    "src7_read_examples": "SELECT doc_id AS ex_id, source AS knowledge, lang AS question FROM documents WHERE doc_id % 11 > 0 AND doc_id % 3 > 0",
    "snk1_write_json": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "snk2_write_stats_csv": "SELECT source AS \"group\", 'n_chars' AS metric_name, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, 11 AS n_columns FROM documents GROUP BY source",
    "snk3_save_tables": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
}
