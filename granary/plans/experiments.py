"""Queries of question quality and experiments.

The experiment is documents with labels: source as model, language as strategy, quality as question type,
and two scores from the text length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import experiments as E
from granary.operators import quality as Q
from granary.operators import retrieval as R

from granary.operators import ir_metrics as I
from granary.operators import text_metrics as M

from .common import frame, plain, scratch_path, table
from .retrieval import _EMBED, _TOP, _judged
from .text_metrics import _COS, _GRAMMAR, PREDS, _pairs

SCORES = """
    SELECT d.doc_id AS question_id, source AS model, lang AS strategy, CASE quality WHEN 1 THEN 'factual' ELSE 'schema' END AS question_type, 'm1' AS metric_name, CAST(n_chars % 101 AS DOUBLE) / 100 AS score
    FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
    UNION ALL
    SELECT d.doc_id, source, lang, CASE quality WHEN 1 THEN 'factual' ELSE 'schema' END, 'm2', CAST(n_chars % 13 AS DOUBLE) / 12 FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""
QUESTIONS = """
    SELECT conv_id * 1000 + turn AS id, CASE turn % 3 WHEN 0 THEN 'What type of ' || text || ' in 2024?' WHEN 1 THEN 'Why is the the ' || text ELSE 'How? ' || role END AS question_text,
           CASE conv_id % 4 WHEN 0 THEN 'factual' WHEN 1 THEN 'schema' WHEN 2 THEN 'composite' ELSE 'other' END AS question_type,
           'Class: ' || role || ' ' || text AS knowledge, CASE WHEN turn % 2 = 0 THEN chr(123) || '"class": "type", "n": ["' || role || '", "zz"]' || chr(125) ELSE '' END AS structured
    FROM {conversations}
"""


def _scores(spark, sf):
    return frame(spark, sf, SCORES)


def _questions(spark, sf):
    return frame(spark, sf, QUESTIONS)


def _vecs(spark, sf, column):
    return R.embed(_questions(spark, sf).select("id", F.col(column).alias("text")))


def _round(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


def _dimension(f):
    return lambda spark, sf: _round(f(_questions(spark, sf)), "score")


def qq1(spark, sf):
    return _round(Q.q_relevance(_vecs(spark, sf, "question_text"), _vecs(spark, sf, "knowledge")), "score")


def _long(spark, sf):
    return Q.quality_long(_questions(spark, sf), _vecs(spark, sf, "question_text"), _vecs(spark, sf, "knowledge"))


def qq6(spark, sf):
    return _round(Q.quality(_long(spark, sf)), "overall")


def qq7(spark, sf):
    return _round(_long(spark, sf), "score")


def _matrix(spark, sf):
    k = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"))
    return E.experiment_matrix(k, ["llama", "gpt-4"], ["zero_shot", "cot"], ["factual", "schema"])


def exp1(spark, sf):
    return _matrix(spark, sf).select("source_id", *E.CONDITION)


def exp2(spark, sf):
    return E.template_questions(_matrix(spark, sf)).select("question_id", "question_text")


def exp3(spark, sf):
    docs = table(spark, sf, "documents")
    refs = docs.where("doc_id % 3 = 0").select(F.lit("src0").alias("source_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("reference")).unionByName(
        docs.where("doc_id % 3 = 1").select(F.col("source").alias("source_id"), F.col("doc_id").alias("pos"), F.sha2("text", 256).alias("reference")))
    return E.align_references(docs.select("doc_id", F.col("source").alias("source_id")), refs)


def exp4(spark, sf):
    return E.provider_breakdown(_matrix(spark, sf))


def exp5(spark, sf):
    return _round(E.condition_summary(_scores(spark, sf)), "mean", "std")


def exp6(spark, sf):
    return _round(E.marginal_means(_scores(spark, sf)), "mean")


_CMP = ("baseline_mean", "comparison_mean", "difference", "percent_change", "cohens_d", "t", "df")


def exp7(spark, sf):
    s = _scores(spark, sf).where("metric_name = 'm1'").withColumn("half", F.when(F.col("question_id") % 2 == 0, "even").otherwise("odd"))
    parts = [E.compare(s, "strategy", "en", "fr", ["question_id"]), E.compare(_scores(spark, sf), "metric_name", "m1", "m2", ["question_id"])]
    return _round(parts[0].unionByName(parts[1]).drop("p", "significant"), *_CMP)


def exp7_p(spark, sf):
    """With p values, which SQL has no function for."""
    return E.compare(_scores(spark, sf), "strategy", "en", "de", ["question_id"])


def exp8(spark, sf):
    return _round(E.compare_all(_scores(spark, sf).where("metric_name = 'm1'"), "strategy").drop("p", "significant"), *_CMP)


_STATS = ("mean", "std", "median", "min", "max")


def exp9(spark, sf):
    return E.describe(_scores(spark, sf), ["model", "metric_name"]).select("model", "metric_name", "n", *(F.round(c, 3).alias(c) for c in _STATS))


def exp9_ci(spark, sf):
    return E.describe(_scores(spark, sf), ["strategy", "metric_name"])


def exp10(spark, sf):
    docs = table(spark, sf, "documents").select(F.array("lang", F.lit("any")).alias("tags"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source"), (F.col("n_chars") % 101).cast("double").alias("a"), (F.col("n_chars") % 7).cast("double").alias("b"))
    return E.describe_by(docs, ["tags", "source"], ["a", "b"]).select("group", "metric_name", "n", *(F.round(c, 3).alias(c) for c in _STATS))


def exp11(spark, sf):
    return _round(E.rankings(_scores(spark, sf), "model"), "mean")


def exp12(spark, sf):
    s = _scores(spark, sf)
    ranked = s.select(F.lit("mrr").alias("metric"), F.lit(0).alias("k"), F.col("score").alias("value")).unionByName(s.select(F.lit("p").alias("metric"), F.lit(5).alias("k"), F.col("score").alias("value")))
    long = E.assemble_long(s.withColumnRenamed("metric_name", "dimension"), s, ranked, s)
    return long.groupBy("group", "metric_name").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


def exp13(spark, sf):
    return E.comparison_table(E.compare_all(_scores(spark, sf).where("metric_name = 'm2'"), "question_type")).select("baseline", "comparison", *(F.round(c, 2).alias(c) for c in ("baseline_mean", "comparison_mean", "difference", "cohens_d")), F.round("percent_change", 1).alias("percent_change"))


def exp14(spark, sf):
    m = E._moments(_scores(spark, sf).where("metric_name = 'm1'"), "strategy")
    a, b = (m.select(*(F.col(x).alias(f"{s}_{x}") for x in m.columns)) for s in "ab")
    return a.join(b, F.col("a_g") < F.col("b_g")).select("a_g", "b_g", F.round(E.effect_size(), 6).alias("d"))


def exp15(spark, sf):
    return _round(E.metric_summary(_scores(spark, sf)), "mean", "std", "min", "max")


def exp16(spark, sf):
    s = _scores(spark, sf)
    totals, by = E.experiment_summary(s.where("metric_name = 'm1'").select("question_id", *E.CONDITION), s)
    return by.select("strategy", F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2")).crossJoin(F.broadcast(totals))


def exp17(spark, sf):
    return E.compare_runs(_scores(spark, sf)).select("strategy", "metric_name", "mean", "best")


def exp18(spark, sf):
    s = _scores(spark, sf).where("metric_name = 'm1' AND NOT (model = 'src3' AND strategy = 'en')")
    return _round(E.score_matrix(s, "model", "strategy", ["de", "en", "es", "fr"]), "de", "en", "es", "fr")


def exp19(spark, sf):
    rows, total = E.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", number=3, per_page=25)
    return rows.crossJoin(F.broadcast(total))


def exp20(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))
    return _round(E.batch_outcome(e, ["event_type"]), "mean_latency").withColumn("total_latency", F.round("total_latency", 2))


def exp21(spark, sf):
    """Quality, metrics, retrieval, report and export; one stage fails on purpose, when it runs."""
    stages = {
        "quality": lambda: _long(spark, sf), "metrics": lambda: M.compute_metrics(*_pairs(spark, sf), ["bleu", "rouge1", "exact_match"]),
        "retrieval": lambda: I.retrieval_metrics(_judged(spark, sf), (1, 5), "distinct"), "broken": lambda: _scores(spark, sf).select(F.raise_error(F.lit("no such metric"))),
        **E.report_frames(_scores(spark, sf)),
    }
    return E.evaluate(spark, stages, scratch_path(spark, "report")).select("stage", "n", F.col("error").isNotNull().alias("failed"))


def _experiments(spark, sf):
    return table(spark, sf, "customer").select(F.concat(F.lit("exp_"), F.col("c_custkey").cast("string")).alias("experiment_id"), F.array("c_mktsegment").alias("models"), F.when(F.col("c_custkey") % 4 > 0, F.array(F.lit("cot"))).alias("strategies"), F.array(F.lit("factual")).alias("types"))


def src9(spark, sf):
    x = _experiments(spark, sf).select("experiment_id")
    return E.find_experiment(x, "exp_7").withColumn("asked", F.lit("exp_7")).unionByName(E.find_experiment(x, "p_1").withColumn("asked", F.lit("p_1")))


def snk4(spark, sf):
    x = _experiments(spark, sf)
    return E.validate_experiments(x, x.where("experiment_id LIKE '%5'")).select("experiment_id", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {
    "qq1_relevance": qq1, "qq2_type_consistency": _dimension(Q.q_type_consistency), "qq3_answerability": _dimension(Q.q_answerability), "qq4_fluency": _dimension(Q.q_fluency),
    "qq5_grounding": _dimension(Q.q_grounding), "qq6_quality": qq6, "qq7_quality_long": qq7, "exp1_matrix": exp1, "exp2_template_questions": exp2, "exp3_align_references": exp3,
    "exp4_provider_breakdown": exp4, "exp5_condition_summary": exp5, "exp6_marginal_means": exp6, "exp7_compare": exp7, "exp7_compare_p": exp7_p, "exp8_compare_all": exp8, "exp9_describe": exp9,
    "exp9_describe_ci": exp9_ci, "exp10_describe_by": exp10, "exp11_rankings": exp11, "exp12_assemble_long": exp12, "exp13_comparison_table": exp13, "exp14_effect_size": exp14,
    "exp15_metric_summary": exp15, "exp16_experiment_summary": exp16, "exp17_compare_runs": exp17, "exp18_score_matrix": exp18, "exp19_page": exp19, "exp20_batch_outcome": exp20,
    "exp21_evaluate": exp21, "src9_find_experiment": src9, "snk4_validate_experiments": snk4,
}

_S = plain(SCORES)
_Q = plain(QUESTIONS)
_W = "('type'), ('class'), ('property'), ('relation'), ('attribute'), ('schema'), ('structure'), ('hierarchy'), ('category'), ('domain'), ('range'), ('subclass'), ('superclass'), ('ontology'), ('predicate')"
_MOMENTS = "SELECT {0} AS g, CAST(count(score) AS DOUBLE) AS n, avg(score) AS mean, var_pop(score) AS vp, var_samp(score) AS vs FROM s GROUP BY 1"


def _compared(by: str, where: str) -> str:
    return f"""WITH s AS (SELECT * FROM ({_S}) x WHERE {where}), m AS ({_MOMENTS.format(by)}), c AS (
        SELECT a.g AS baseline, b.g AS comparison, a.mean AS baseline_mean, b.mean AS comparison_mean, b.mean - a.mean AS difference, CASE WHEN a.mean <> 0 THEN 100 * (b.mean - a.mean) / abs(a.mean) ELSE 0 END AS percent_change,
               coalesce((b.mean - a.mean) / nullif(sqrt((a.vs + b.vs) / 2), 0), 0) AS cohens_d, (b.mean - a.mean) / sqrt(a.vs / a.n + b.vs / b.n) AS t,
               pow(a.vs / a.n + b.vs / b.n, 2) / (pow(a.vs / a.n, 2) / (a.n - 1) + pow(b.vs / b.n, 2) / (b.n - 1)) AS df
        FROM m a JOIN m b ON a.g < b.g)"""


_STAT = "round(round_even(avg(score), 4), 3) AS mean, round(round_even(coalesce(stddev_samp(score), 0), 4), 3) AS std, round(round_even(median(score), 4), 3) AS median, round(round_even(min(score), 4), 3) AS min, round(round_even(max(score), 4), 3) AS max"
#: Ranking metrics of a query at two cut-offs: mrr once, four others at each.
_METRIC_ROWS = 9
_K = "documents, (SELECT unnest(['llama', 'gpt-4']) AS model) m, (SELECT unnest(['zero_shot', 'cot']) AS strategy) t, (SELECT unnest(['factual', 'schema']) AS question_type) q"

ORACLE = {
    "qq1_relevance": f"""WITH q AS ({_Q}), e_in AS (SELECT id * 2 AS id, question_text AS text FROM q UNION ALL SELECT id * 2 + 1, knowledge FROM q), {_EMBED}
        SELECT a.id // 2 AS id, round(coalesce({_COS}, 0), 6) AS score FROM e a JOIN e b ON b.id = a.id + 1 AND a.id % 2 = 0""",
    "qq2_type_consistency": f"""WITH q AS (SELECT *, lower(question_text) AS t FROM ({_Q}) x), a AS (SELECT id, question_type,
            CAST(regexp_matches(t, '\\b(what|who|when|where|how many|how much)\\b') AS INT) + CAST(regexp_matches(t, '\\b(is|are|was|were|did|does|do|has|have|had)\\b') AS INT) AS f,
            len(regexp_extract_all(t, '\\b\\d{{4}}\\b')) + len(regexp_extract_all(t, '\\b\\d+\\b')) AS n, (SELECT count(*) FROM (VALUES {_W}) AS w(w) WHERE contains(t, w)) AS s,
            CAST(regexp_matches(t, 'what (type|kind|class) of') AS INT) + CAST(regexp_matches(t, 'what (is|are) the (relation|property|attribute)') AS INT)
              + CAST(regexp_matches(t, 'how (is|are) .* (related|connected|linked)') AS INT) + CAST(regexp_matches(t, 'what (does|do) .* (belong|classify)') AS INT) AS p FROM q
        ), b AS (SELECT *, greatest(0, least(1, 0.3::DOUBLE * least(1, f) + 0.3::DOUBLE * least(1, n / 3) - 0.2::DOUBLE * least(1, s / 2))) AS fa, greatest(0, least(1, 0.4::DOUBLE * least(1, s / 2) + 0.3::DOUBLE * least(1, p))) AS sc FROM a)
        SELECT id, round(CASE question_type WHEN 'factual' THEN fa WHEN 'schema' THEN sc WHEN 'composite' THEN (fa + sc) / 2 ELSE 0.5 END, 6) AS score FROM b""",
    "qq3_answerability": rf"""WITH q AS (SELECT id, lower(question_text) AS t, list_distinct(list_filter(regexp_extract_all(lower(question_text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3)) AS a,
            list_filter(regexp_extract_all(lower(knowledge), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3) AS k FROM ({_Q}) x)
        SELECT id, round(greatest(0, least(1, 0.7::DOUBLE * coalesce(len(list_filter(a, lambda w: list_contains(k, w))) / nullif(len(a), 0), 0)
            - 0.15::DOUBLE * (CAST(regexp_matches(t, '\b(why|how come|what if)\b') AS INT) + CAST(regexp_matches(t, '\b(opinion|think|feel|believe)\b') AS INT)))), 6) AS score FROM q""",
    "qq5_grounding": rf"""WITH q AS (SELECT id, question_type, lower(question_text) AS t, list_distinct(list_concat(regexp_extract_all(structured, '"([^"]*)"', 1), regexp_extract_all(knowledge, '(?i)(?:class|type|category)[\s:]+([A-Za-z_][A-Za-z0-9_]*)', 1),
            regexp_extract_all(knowledge, '(?i)(?:property|attribute|field)[\s:]+([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all(knowledge, '(?i)(?:relation|relationship|predicate)[\s:]+([A-Za-z_][A-Za-z0-9_]*)', 1))) AS e FROM ({_Q}) x
        ), r AS (SELECT *, coalesce(len(list_filter(e, lambda x: contains(t, lower(x)))) / nullif(len(e), 0), 0.5) AS r FROM q)
        SELECT id, round(CASE WHEN question_type = 'schema' THEN r ELSE r * 0.5 + 0.5 END, 6) AS score FROM r""",
    "qq4_fluency": rf"""WITH q AS (SELECT id, question_text AS text, len(list_filter(regexp_split_to_array(question_text, '\s+'), lambda w: w <> '')) AS n FROM ({_Q}) x), p AS (
            SELECT id, n, {_GRAMMAR} AS g, CASE WHEN regexp_matches(text, '\b\w+(\s+\w+){{14}}') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\b(the\s+the|a\s+a|an\s+an)\b') THEN 0.4::DOUBLE ELSE 0 END
                + CASE WHEN regexp_matches(text, '\b\w+\b\s*\(\s*\b\w+\b\s*\)\s*\b\w+\b\s*\(\s*\b\w+\b\s*\)') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '[^a-zA-Z0-9\s\x{{4e00}}-\x{{9fff}}.,;:!?()''\"-]') THEN 0.2::DOUBLE ELSE 0 END AS f FROM q)
        SELECT id, round(greatest(0, least(1, 0.4::DOUBLE * g + 0.4::DOUBLE * greatest(0, 1 - f) + 0.2::DOUBLE * CASE WHEN n BETWEEN 5 AND 25 THEN 1 WHEN n < 5 THEN n / 5 ELSE greatest(0.3, 1 - (n - 25) / 50) END)), 6) AS score FROM p""",
    "exp1_matrix": f"SELECT CAST(doc_id AS VARCHAR) AS source_id, model, strategy, question_type FROM {_K}",
    "exp2_template_questions": f"""SELECT substr(sha256(doc_id || '/' || model || '/' || strategy || '/' || question_type), 1, 12) AS question_id,
        CASE question_type WHEN 'factual' THEN 'What is described by: ' ELSE 'What is the structure of: ' END || substr(coalesce(text, ''), 1, 50) || '?' AS question_text FROM {_K}""",
    "exp3_align_references": """WITH r AS (SELECT 'src0' AS source_id, doc_id AS pos, lang AS reference FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT source, doc_id, sha256(text) FROM documents WHERE doc_id % 3 = 1
        ), f AS (SELECT source_id, arg_min(reference, pos) AS reference FROM r GROUP BY source_id) SELECT doc_id, source AS source_id, coalesce(reference, '') AS reference FROM documents LEFT JOIN f ON f.source_id = source""",
    "exp4_provider_breakdown": f"SELECT CASE model WHEN 'llama' THEN 'ollama' ELSE 'openai' END AS provider, count(*) AS n FROM {_K} GROUP BY 1",
    "exp5_condition_summary": f"SELECT model, strategy, question_type, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM ({_S}) s GROUP BY ALL",
    "exp6_marginal_means": f"""WITH s AS ({_S}) SELECT 'model' AS factor, model AS level, metric_name, round(avg(score), 6) AS mean, count(*) AS n FROM s GROUP BY ALL
        UNION ALL SELECT 'strategy', strategy, metric_name, round(avg(score), 6), count(*) FROM s GROUP BY ALL UNION ALL SELECT 'question_type', question_type, metric_name, round(avg(score), 6), count(*) FROM s GROUP BY ALL""",
    "exp7_compare": f"""WITH all_s AS ({_S}), s AS (SELECT *, strategy AS k FROM all_s WHERE metric_name = 'm1' AND strategy IN ('en', 'fr')), m AS ({_MOMENTS.format('k')}), w AS (
            SELECT a.g AS baseline, b.g AS comparison, a.mean AS am, b.mean AS bm, coalesce((b.mean - a.mean) / nullif(sqrt((a.vp + b.vp) / 2), 0), 0) AS d, 'welch' AS test, (b.mean - a.mean) / sqrt(a.vs / a.n + b.vs / b.n) AS t,
                   pow(a.vs / a.n + b.vs / b.n, 2) / (pow(a.vs / a.n, 2) / (a.n - 1) + pow(b.vs / b.n, 2) / (b.n - 1)) AS df FROM m a JOIN m b ON a.g = 'en' AND b.g = 'fr'
        ), p AS (SELECT a.score AS x, b.score AS y FROM all_s a JOIN all_s b ON a.question_id = b.question_id AND a.metric_name = 'm1' AND b.metric_name = 'm2'
        ), z AS (SELECT 'm1', 'm2', avg(x), avg(y), coalesce((avg(y) - avg(x)) / nullif(sqrt((var_pop(x) + var_pop(y)) / 2), 0), 0), 'paired', avg(y - x) / (stddev_samp(y - x) / sqrt(count(*))), CAST(count(*) - 1 AS DOUBLE) FROM p
        ), u AS (SELECT * FROM w UNION ALL SELECT * FROM z)
        SELECT baseline, comparison, round(am, 6) AS baseline_mean, round(bm, 6) AS comparison_mean, round(bm - am, 6) AS difference, round(100 * (bm - am) / abs(am), 6) AS percent_change, round(d, 6) AS cohens_d, test, round(t, 6) AS t, round(df, 6) AS df FROM u""",
    "exp8_compare_all": _compared("strategy", "metric_name = 'm1'") + " SELECT baseline, comparison, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CMP) + " FROM c",
    "exp9_describe": f"SELECT model, metric_name, count(*) AS n, {_STAT} FROM ({_S}) s GROUP BY ALL",
    "exp10_describe_by": f"""WITH d AS (SELECT unnest([lang, 'any']) || ' / ' || CASE WHEN doc_id % 5 > 0 THEN source ELSE 'unknown' END AS "group", CAST(n_chars % 101 AS DOUBLE) AS a, CAST(n_chars % 7 AS DOUBLE) AS b FROM documents
        ), l AS (SELECT "group", 'a' AS metric_name, a AS score FROM d UNION ALL SELECT "group", 'b', b FROM d) SELECT "group", metric_name, count(*) AS n, {_STAT} FROM l GROUP BY ALL""",
    "exp11_rankings": f"SELECT metric_name, model, round(mean, 6) AS mean, CAST(row_number() OVER (PARTITION BY metric_name ORDER BY round(x.mean, 9) DESC, model) AS INT) AS rank FROM (SELECT metric_name, model, avg(score) AS mean FROM ({_S}) s GROUP BY ALL) x",
    "exp12_assemble_long": f"""WITH s AS ({_S}), l AS (SELECT model || '_' || strategy AS "group", metric_name, score FROM s UNION ALL SELECT 'all', metric_name, score FROM s UNION ALL SELECT 'rag_retrieval', 'mrr', score FROM s
        UNION ALL SELECT 'rag_retrieval', 'p@5', score FROM s UNION ALL SELECT 'rag_generation', metric_name, score FROM s) SELECT "group", metric_name, count(*) AS n, round(sum(score), 4) AS total FROM l GROUP BY ALL""",
    "exp13_comparison_table": _compared("question_type", "metric_name = 'm2'") + " SELECT baseline, comparison, " + ", ".join(f"round(round_even({c}, 4), 2) AS {c}" for c in ("baseline_mean", "comparison_mean", "difference", "cohens_d")) + ", round(round_even(percent_change, 2), 1) AS percent_change FROM c",
    "exp14_effect_size": _compared("strategy", "metric_name = 'm1'") + " SELECT baseline AS a_g, comparison AS b_g, round(cohens_d, 6) AS d FROM c",
    "exp15_metric_summary": f"SELECT metric_name, count(*) AS \"count\", round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max FROM ({_S}) s GROUP BY metric_name",
    "exp16_experiment_summary": f"""WITH s AS ({_S}), t AS (SELECT count(*) FILTER (metric_name = 'm1') AS n_questions, count(DISTINCT model) AS n_model, count(DISTINCT strategy) AS n_strategy, count(DISTINCT question_type) AS n_question_type, count(*) AS n_scores, count(DISTINCT metric_name) AS n_metrics FROM s)
        SELECT strategy, round(avg(score) FILTER (metric_name = 'm1'), 6) AS m1, round(avg(score) FILTER (metric_name = 'm2'), 6) AS m2, n_questions, n_model, n_strategy, n_question_type, n_scores, n_metrics FROM s, t GROUP BY ALL""",
    "exp17_compare_runs": f"WITH m AS (SELECT strategy, metric_name, round_even(avg(score), 4) AS x FROM ({_S}) s GROUP BY ALL) SELECT strategy, metric_name, x AS mean, x = max(x) OVER (PARTITION BY metric_name) AND x > 0 AS best FROM m",
    "exp18_score_matrix": f"SELECT model, {', '.join(f'round(coalesce(avg(score) FILTER (strategy = {chr(39)}{c}{chr(39)}), 0), 6) AS {c}' for c in ('de', 'en', 'es', 'fr'))} FROM ({_S}) s WHERE metric_name = 'm1' AND NOT (model = 'src3' AND strategy = 'en') GROUP BY model",
    "exp19_page": "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50",
    "exp20_batch_outcome": "SELECT event_type, count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 2) AS total_latency, round(avg(value), 6) AS mean_latency FROM events GROUP BY event_type",
    "src9_find_experiment": "SELECT 'exp_7' AS experiment_id, 'exp_7' AS asked UNION ALL SELECT min('exp_' || c_custkey), 'p_1' FROM customer WHERE contains('exp_' || c_custkey, 'p_1')",
    "snk4_validate_experiments": "SELECT 'exp_' || c_custkey AS experiment_id, concat_ws(',', CASE WHEN c_custkey % 10 = 5 THEN 'duplicate' END, CASE WHEN c_custkey % 4 = 0 THEN 'no strategies' END) AS reasons FROM customer",
}


def _dimensions(digits: int) -> str:
    """(id, dimension, score) of the five dimensions' own SQL, rounded to ``digits``."""
    own = {"relevance": "qq1_relevance", "type_consistency": "qq2_type_consistency", "answerability": "qq3_answerability", "fluency": "qq4_fluency", "structural_grounding": "qq5_grounding"}
    return " UNION ALL ".join(f"SELECT id, '{d}' AS dimension, score FROM ({ORACLE[q].replace(', 6) AS score', f', {digits}) AS score')}) AS {d}" for d, q in own.items())


_WEIGHTED = " ".join(f"WHEN '{d}' THEN {w}::DOUBLE" for d, w in Q.WEIGHTS.items())
ORACLE |= {
    "qq6_quality": f"SELECT id, round(sum(score * CASE dimension {_WEIGHTED} END) / sum(CASE dimension {_WEIGHTED} END), 6) AS overall FROM ({_dimensions(15)}) AS l GROUP BY id",
    "qq7_quality_long": _dimensions(6),
    "exp21_evaluate": f"""WITH {_TOP}, sc AS ({_S}), r AS (SELECT DISTINCT query_id FROM top WHERE query_id IN (SELECT vec_id FROM embeddings e WHERE EXISTS (SELECT 1 FROM embeddings o WHERE o.label = e.label AND o.vec_id <> e.vec_id)))
        SELECT 'quality' AS stage, (SELECT 5 * count(*) FROM ({_Q}) AS q) AS n, false AS failed UNION ALL SELECT 'metrics', (SELECT 3 * count(*) FROM ({plain(PREDS)}) AS p), false
        UNION ALL SELECT 'retrieval', (SELECT {_METRIC_ROWS} * count(*) FROM r), false UNION ALL SELECT 'broken', NULL, true
        UNION ALL SELECT 'conditions', (SELECT count(*) FROM (SELECT DISTINCT model, strategy, question_type FROM sc)), false
        UNION ALL SELECT 'marginals', (SELECT count(*) FROM (SELECT DISTINCT model, metric_name FROM sc)) + (SELECT count(*) FROM (SELECT DISTINCT strategy, metric_name FROM sc)) + (SELECT count(*) FROM (SELECT DISTINCT question_type, metric_name FROM sc)), false
        UNION ALL SELECT 'statistics', (SELECT count(*) FROM (SELECT DISTINCT strategy, metric_name FROM sc)), false UNION ALL SELECT 'rankings', (SELECT count(*) FROM (SELECT DISTINCT model, metric_name FROM sc)), false
        UNION ALL SELECT 'summary', (SELECT count(DISTINCT metric_name) FROM sc), false UNION ALL SELECT 'comparisons', (SELECT count(DISTINCT strategy) * (count(DISTINCT strategy) - 1) // 2 FROM sc), false""",
}
