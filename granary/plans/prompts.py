"""Queries of few-shot selection, prompts, adversarial and multi-hop benchmarks.

The example bank is the benchmark; knowledge rows are documents, questions are about customers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import adversarial as A
from granary.operators import graph as G
from granary.operators import prompts as P
from granary.operators import retrieval as R

from .common import TRIPLES, frame, plain
from .graph import _PATHS
from .retrieval import _OVERLAP, _context, _docs, _items

BANK = """
    SELECT item_id AS ex_id, text AS knowledge, 'Question ' || item_id || '?' AS question, CASE item_id % 3 WHEN 0 THEN 'factual' ELSE 'schema' END AS question_type, CASE item_id % 2 WHEN 0 THEN 'cot' ELSE 'zero_shot' END AS strategy
    FROM {benchmark} WHERE NOT (item_id % 3 = 0 AND item_id % 2 = 0)
"""
ASKED = """
    SELECT doc_id AS source_id, text AS content, CASE doc_id % 2 WHEN 0 THEN 'factual' ELSE 'schema' END AS question_type, CASE doc_id % 5 WHEN 0 THEN 'cot' ELSE 'zero_shot' END AS strategy FROM {documents}
"""
TEMPLATES = [("cot", "factual", "[{question_type}] {examples} Think about {knowledge}"), ("cot", None, "Reason on {knowledge}"), ("few_shot", None, "{examples}\nNow {knowledge}")]
COMPLETIONS = """
    SELECT conv_id AS source_id, CASE turn % 3 WHEN 0 THEN 'chain_of_thought' WHEN 1 THEN 'self_consistency' ELSE 'zero_shot' END AS strategy,
           CASE turn % 4 WHEN 0 THEN '<think>' || text || '</think> Final question: ' || role || ' ' || text WHEN 1 THEN '"' || text || '"' || chr(10) || 'What is it?'
                WHEN 2 THEN 'Best. Final answer: `Who?`' ELSE '  ' || text || '? ' END AS raw_output
    FROM {conversations}
"""
QUESTIONS = """
    SELECT c_custkey AS question_id, CASE c_custkey % 5 WHEN 0 THEN 'What did Einstein tell Tesla about ' || c_name || '?' WHEN 1 THEN 'Where was ' || c_name || ' born?' WHEN 2 THEN 'Which is the tallest and highest of ' || c_mktsegment || '?'
           WHEN 3 THEN 'When did Dickens visit ' || c_name || '?' ELSE 'Who' END AS question, c_name AS answer FROM {customer}
"""


def _bank(spark, sf):
    return frame(spark, sf, BANK)


def _asked(spark, sf):
    return frame(spark, sf, ASKED)


def _templates(spark):
    return spark.createDataFrame(TEMPLATES, "strategy string, question_type string, template string")


def _questions(spark, sf):
    return frame(spark, sf, QUESTIONS)


def fs1(spark, sf):
    return P.filter_examples(_bank(spark, sf), "schema", "cot")


def fs2(spark, sf):
    return P.candidates(_asked(spark, sf), _bank(spark, sf)).groupBy("source_id").agg(F.count("*").alias("n"), F.sum("ex_id").alias("ids"))


def fs3(spark, sf):
    return P.select_random(_asked(spark, sf), _bank(spark, sf), 3)


def fs4(spark, sf):
    return P.select_similar(_asked(spark, sf), _bank(spark, sf), 3).withColumn("sim", F.round("sim", 6))


def fs5(spark, sf):
    return P.select_diverse(_asked(spark, sf), _bank(spark, sf), 2)


def _prompts(spark, sf):
    blocks = P.examples_block(P.select_similar(_asked(spark, sf), _bank(spark, sf), 2), _bank(spark, sf))
    return P.build_prompts(_asked(spark, sf), _templates(spark), blocks)


def pr1(spark, sf):
    return _prompts(spark, sf).select("source_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def pr2(spark, sf):
    return P.resolve_templates(_asked(spark, sf), _templates(spark)).select("source_id", "template")


def pr3(spark, sf):
    rows = P.expand_self_consistency(_asked(spark, sf).select("source_id", F.col("content").alias("prompt")), 6)
    return rows.select("source_id", "sample", F.sha2("prompt", 256).alias("prompt_sha256"))


def pr4(spark, sf):
    return P.default_examples(_asked(spark, sf))


def pr5(spark, sf):
    return P.clean_completions(frame(spark, sf, COMPLETIONS))


def pr6(spark, sf):
    rows = frame(spark, sf, COMPLETIONS).select("source_id", F.col("raw_output").alias("question"), F.when(F.col("strategy") == "zero_shot", "schema").otherwise("factual").alias("question_type"), F.length("raw_output").alias("completion_tokens"))
    return P.rank_by_confidence(rows.distinct(), 2).select("source_id", "question", "confidence", "rank")


def pr7(spark, sf):
    return P.rag_prompt(_items(spark, sf), R.pack_context(_context(spark, sf))).select("query_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def _adv(name):
    return lambda spark, sf: A.STRATEGIES[name](_questions(spark, sf))


def adv5(spark, sf):
    return A.adversarial_variants(_questions(spark, sf)).groupBy("strategy", "variant").agg(F.count("*").alias("n"))


def adv6(spark, sf):
    made = A.adversarial_variants(_questions(spark, sf))
    answers = made.join(_questions(spark, sf).select("question_id", F.col("answer").alias("expected")), "question_id").select(
        "question_id", "strategy", "variant", "expected", F.when(F.col("question_id") % 3 == 0, F.concat(F.lit("It is "), F.upper("expected"))).when(F.col("question_id") % 3 == 1, "").otherwise("no idea").alias("answer"))
    return A.robustness(made, answers)


def _mh(spark, sf):
    nodes, edges = G.graph_from_triples(frame(spark, sf, TRIPLES))
    pairs = nodes.where("id LIKE 'supplier_%'").select(F.col("id").alias("start")).crossJoin(F.broadcast(nodes.where("id LIKE 'region_%'").select(F.col("id").alias("end"))))
    return A.multihop_questions(edges, pairs, 1000)


def mh1(spark, sf):
    return _mh(spark, sf).select("question_id", "answer", "hops", F.array_join("chain", ";").alias("chain"))


def _mh_scores(spark, sf):
    q = _mh(spark, sf).withColumn("facts", F.array("answer", F.lit("zzz")))
    answers = q.select("question_id", F.when(F.length("answer") % 2 == 0, F.concat(F.lit("the "), F.upper("answer"))).otherwise("?").alias("generated"), F.length("answer").cast("double").alias("latency_ms"))
    return A.multihop_score(q, answers, q.select("question_id", F.concat(F.lit("found "), F.element_at("chain", 1)).alias("text"))).join(q.select("question_id", "hops"), "question_id")


def mh2(spark, sf):
    return _mh_scores(spark, sf).select("question_id", "answer_correct", "chain_recall", "fact_recall", "latency_ms")


def mh3(spark, sf):
    return A.multihop_summary(_mh_scores(spark, sf), ["hops"]).withColumn("accuracy", F.round("accuracy", 6))


def ret17(spark, sf):
    docs = _docs(spark, sf)

    def search(queries, number):
        return R.overlap_topk(queries.withColumn("text", F.concat(F.lit("more about " if number > 1 else ""), "text")), docs, 3)

    state, _ = A.multi_round(_items(spark, sf), search)
    return state.withColumn("confidence", F.round("confidence", 3))


QUERIES = {
    "fs1_filter_examples": fs1, "fs2_candidates": fs2, "fs3_select_random": fs3, "fs4_select_similar": fs4, "fs5_select_diverse": fs5, "pr1_build_prompts": pr1, "pr2_resolve_templates": pr2,
    "pr3_self_consistency": pr3, "pr4_default_examples": pr4, "pr5_clean_completions": pr5, "pr6_rank_by_confidence": pr6, "pr7_rag_prompt": pr7, "adv1_distractor": _adv("distractor"),
    "adv2_negation": _adv("negation"), "adv3_relation": _adv("multihop_variation"), "adv4_edge_case": _adv("edge_case"), "adv5_variants": adv5, "adv6_robustness": adv6,
    "mh1_multihop_questions": mh1, "mh2_multihop_score": mh2, "mh3_multihop_summary": mh3, "ret17_multi_round": ret17,
}

_B, _A, _C, _Q = plain(BANK), plain(ASKED), plain(COMPLETIONS), plain(QUESTIONS)
_CAND = f"""b AS ({_B}), k AS ({_A}), c AS (SELECT source_id, content, ex_id, knowledge, question FROM k JOIN b ON k.question_type = b.question_type AND (k.strategy = b.strategy
        OR NOT EXISTS (SELECT 1 FROM b x WHERE x.question_type = k.question_type AND x.strategy = k.strategy))
    ), g AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(knowledge), '\\s+'), lambda w: w <> '')) AS y FROM c
    ), s AS (SELECT *, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS sim FROM g
    ), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY round(sim, 9) DESC, ex_id) AS INT) AS rank FROM s)"""
_TEMPLATE = "CASE WHEN k.strategy = 'cot' AND k.question_type = 'factual' THEN '[{question_type}] {examples} Think about {knowledge}' WHEN k.strategy = 'cot' THEN 'Reason on {knowledge}' ELSE 'Ask a question about: {knowledge}' END"
_VARIANTS = """d AS (SELECT question_id, 'distractor' AS strategy, list_filter([{0}], lambda x: x IS NOT NULL) AS v FROM q
        UNION ALL SELECT question_id, 'negation', CASE WHEN regexp_matches(lower(question), '^(what|which|who)') AND contains(question, ' ') THEN [regexp_replace(question, '^(\\S+) ', '\\1 NOT ')] ELSE [] END FROM q
        UNION ALL SELECT question_id, 'multihop_variation', CASE WHEN contains(lower(question), 'born') THEN list_transform(['die', 'study', 'work', 'live'], lambda r: replace(lower(question), 'born', r)) ELSE [] END FROM q
        UNION ALL SELECT question_id, 'edge_case', list_concat(CASE WHEN regexp_matches(lower(question), 'tallest|highest|largest') THEN list_transform(['second tallest', 'third tallest', 'shortest', 'smallest'],
            lambda s: replace(replace(replace(lower(question), 'tallest', s), 'highest', s), 'largest', s)) ELSE [] END, CASE WHEN contains(lower(question), 'when') THEN [replace(lower(question), 'when', 'before what year')] ELSE [] END) FROM q
    ), v AS (SELECT question_id, strategy, CAST(generate_subscripts(v, 1) - 1 AS INT) AS variant, unnest(v) AS adversarial_question FROM d)""".format(
    ", ".join(f"CASE WHEN contains(lower(question), '{a}') THEN replace(lower(question), '{a}', '{b}') END" for a, b in A.SWAPS)
)
_MH = _PATHS + """, best AS (SELECT start, "end", arg_min(path, (size, path)) AS path, min(size) AS size FROM paths GROUP BY ALL HAVING min(size) >= 3
    ), mq AS (SELECT 'mh_' || substr(md5('42:' || start || ':' || "end"), 1, 12) AS question_id, "end" AS answer, CAST(size - 1 AS INT) AS hops, string_split(path, '>') AS p FROM best WHERE size <= 3 ORDER BY md5('42:' || start || ':' || "end"), start, "end" LIMIT 1000
    ), mc AS (SELECT question_id, answer, hops, p[1] || ' -> ' || p[2] || ';' || p[2] || ' -> ' || p[3] AS chain FROM mq)"""
_MH_SCORE = _MH + ", sc AS (SELECT question_id, hops, length(answer) % 2 = 0 AS answer_correct, CAST(0.5 AS DOUBLE) AS chain_recall, CAST(0 AS DOUBLE) AS fact_recall, CAST(length(answer) AS DOUBLE) AS latency_ms FROM mc)"
_VAR = ", ".join("'" + v.replace("'", "''") + "'" for v in P.VARIATIONS)
# Markers in the order in which they are tried, as the operator has them.
_AFTER = {k: "CASE " + " ".join(f"WHEN contains(x, '{m}') THEN substr(x, strpos(x, '{m}') + {len(m)})" for m in ms) + " ELSE x END" for k, ms in P.MARKERS.items()}
_CLEAN = rf"""WITH c AS ({_C}), a AS (SELECT source_id, strategy, trim(regexp_replace(trim(coalesce(raw_output, ''), E' \t\n\r'), '(?s)<think>.*?</think>', '', 'g'), E' \t\n\r') AS x FROM c
    ), b AS (SELECT source_id, trim(CASE strategy WHEN 'chain_of_thought' THEN {_AFTER['chain_of_thought']} WHEN 'self_consistency' THEN {_AFTER['self_consistency']} ELSE x END, E' \t\n\r') AS x FROM a
    ), d AS (SELECT source_id, list_filter(list_transform(regexp_split_to_array(trim(trim(trim(trim(x, '"'), chr(39)), '`'), E' \t\n\r'), '\r\n|\n|\r'), lambda l: trim(l, E' \t\n\r')), lambda l: l <> '') AS ls FROM b
    ), f AS (SELECT source_id, coalesce(list_filter(ls, lambda l: ends_with(l, '?') OR ends_with(l, '？'))[1], ls[1], '') AS l FROM d
    ), q AS (SELECT source_id, CASE WHEN l <> '' AND NOT (ends_with(l, '?') OR ends_with(l, '？')) THEN l || '？' ELSE l END AS question FROM f)"""
_ADV = f"WITH q AS ({_Q}), {_VARIANTS} "

ORACLE = {
    "fs1_filter_examples": f"SELECT * FROM ({_B}) b WHERE question_type = 'schema' AND strategy = 'cot'",
    "fs2_candidates": f"WITH {_CAND} SELECT source_id, count(*) AS n, CAST(sum(ex_id) AS BIGINT) AS ids FROM c GROUP BY source_id",
    "fs3_select_random": f"""WITH b AS ({_B}), k AS ({_A}), p AS (SELECT question_type || '|' || strategy AS pool, ex_id FROM b UNION ALL SELECT question_type, ex_id FROM b
        ), n AS (SELECT pool, ex_id, row_number() OVER (PARTITION BY pool ORDER BY CAST('0x' || substr(md5('42:' || ex_id), 1, 13) AS BIGINT), ex_id) - 1 AS place, count(*) OVER (PARTITION BY pool) AS m FROM p
        ), r AS (SELECT source_id, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.question_type = k.question_type AND b.strategy = k.strategy) THEN question_type || '|' || strategy ELSE question_type END AS pool, CAST('0x' || substr(md5('42:' || source_id), 1, 13) AS BIGINT) AS h FROM k)
        SELECT source_id, ex_id, CAST(j AS INT) AS rank FROM r JOIN n USING (pool), unnest(range(1, 4)) AS t(j) WHERE j <= m AND place = (h + j - 1) % m""",
    "pr5_clean_completions": rf"""{_CLEAN} SELECT source_id, question, count(*) AS copies FROM q GROUP BY ALL""",
    "pr6_rank_by_confidence": f"""WITH c AS ({_C}), r AS (SELECT DISTINCT source_id, raw_output AS question, CASE strategy WHEN 'zero_shot' THEN 'schema' ELSE 'factual' END AS t FROM c
        ), s AS (SELECT source_id, question, t, length(question) AS n FROM r
        ), v AS (SELECT source_id, question, round_even(greatest(0, least(1, CASE WHEN n < 10 THEN 0.5::DOUBLE WHEN n > 200 THEN 0.8::DOUBLE WHEN n BETWEEN 20 AND 100 THEN 1.05::DOUBLE ELSE 1 END
            * CASE WHEN ends_with(question, '?') OR ends_with(question, '？') THEN 1 ELSE 0.7::DOUBLE END * CASE t WHEN 'schema' THEN 0.95::DOUBLE ELSE 1 END * CASE WHEN n >= 0.95 * 512 THEN 0.85::DOUBLE ELSE 1 END)), 3) AS confidence FROM s)
        SELECT source_id, question, confidence, CAST(row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, question) AS INT) AS rank FROM v QUALIFY rank <= 2""",
    "fs4_select_similar": f"WITH {_CAND} SELECT source_id, ex_id, round(sim, 6) AS sim, rank FROM top WHERE rank <= 3",
    "fs5_select_diverse": f"""WITH {_CAND}, one AS (SELECT source_id, ex_id, y FROM top WHERE rank = 1), two AS (
            SELECT t.source_id, t.ex_id, row_number() OVER (PARTITION BY t.source_id ORDER BY round(0.5::DOUBLE * sim - 0.5::DOUBLE * (len(list_intersect(t.y, o.y)) / (len(t.y) + len(o.y) - len(list_intersect(t.y, o.y)))), 9) DESC, t.ex_id) AS r FROM top t JOIN one o ON o.source_id = t.source_id AND o.ex_id <> t.ex_id)
        SELECT source_id, ex_id, 1 AS rank FROM one UNION ALL SELECT source_id, ex_id, 2 FROM two WHERE r = 1""",
    "pr1_build_prompts": f"""WITH {_CAND}, e AS (SELECT source_id, string_agg('Knowledge: ' || knowledge || chr(10) || 'Question: ' || question, chr(10) || chr(10) ORDER BY rank) AS examples FROM top WHERE rank <= 2 GROUP BY source_id)
        SELECT k.source_id, sha256(CASE WHEN coalesce(content, '') = '' THEN '' ELSE replace(replace(replace({_TEMPLATE}, '{{question_type}}', k.question_type), '{{examples}}', coalesce(examples, '')), '{{knowledge}}', content) END) AS prompt_sha256
        FROM k LEFT JOIN e USING (source_id)""".replace("'{{", "'{").replace("}}'", "}'"),
    "pr2_resolve_templates": f"WITH k AS ({_A}) SELECT source_id, {_TEMPLATE} AS template FROM k",
    "pr3_self_consistency": f"WITH k AS ({_A}) SELECT source_id, CAST(s AS INT) AS sample, sha256(content || chr(10) || chr(10) || 'Reasoning variation ' || s || ': ' || ([{_VAR}])[(s - 1) % 5 + 1]) AS prompt_sha256 FROM k, unnest(range(1, 7)) AS t(s)",
    "pr4_default_examples": f"""WITH k AS ({_A}), e(question_type, pos, knowledge, question) AS (VALUES {', '.join("('" + t + "', " + str(i % 2) + ", '" + k + "', '" + q + "')" for i, (t, k, q) in enumerate(P.DEFAULT_EXAMPLES))})
        SELECT source_id, question_type, pos, knowledge, question FROM k JOIN e USING (question_type)""",
    "pr7_rag_prompt": _OVERLAP + """, pt AS (SELECT query_id, rank, '[' || rank || '] ' || text AS part FROM ov JOIN documents ON doc_id = chunk_id
        ), run AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM pt), pk AS (SELECT query_id, string_agg(part, chr(10) || chr(10) ORDER BY rank) AS c FROM run WHERE total <= 3000 GROUP BY query_id)
        SELECT item_id AS query_id, sha256('Answer from the context only.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || 'Question: ' || coalesce(text, '')) AS prompt_sha256 FROM benchmark LEFT JOIN pk ON query_id = item_id""",
    "adv1_distractor": _ADV + "SELECT * FROM v WHERE strategy = 'distractor'", "adv2_negation": _ADV + "SELECT * FROM v WHERE strategy = 'negation'",
    "adv3_relation": _ADV + "SELECT * FROM v WHERE strategy = 'multihop_variation'", "adv4_edge_case": _ADV + "SELECT * FROM v WHERE strategy = 'edge_case'",
    "adv5_variants": _ADV + "SELECT strategy, variant, count(*) AS n FROM v GROUP BY ALL",
    "adv6_robustness": _ADV + "SELECT coalesce(strategy, 'overall') AS strategy, count(*) AS n, round_even(avg(CASE WHEN question_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS success_rate, round_even(1 - avg(CASE WHEN question_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS attack_rate FROM v GROUP BY ROLLUP(strategy)",
    "mh1_multihop_questions": _MH + " SELECT * FROM mc", "mh2_multihop_score": _MH_SCORE + " SELECT question_id, answer_correct, chain_recall, fact_recall, latency_ms FROM sc",
    "mh3_multihop_summary": _MH_SCORE + " SELECT hops, count(*) AS total, round(avg(CASE WHEN answer_correct THEN 1.0 ELSE 0 END), 6) AS accuracy, round_even(avg(chain_recall), 4) AS chain_recall, round_even(avg(fact_recall), 4) AS fact_recall, round_even(avg(latency_ms), 2) AS latency_ms FROM sc GROUP BY ROLLUP(hops)",
}
