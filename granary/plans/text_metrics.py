"""Queries of text metrics: assistant turns against themselves with capitals, or with the turn before, and the turn before alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import retrieval as R
from granary.operators import text_metrics as M

from .common import frame, plain, table
from .retrieval import _EMBED, _OVERLAP, _TOKENS, _TOP, _dense, _docs, _items

_TURNS = "SELECT conv_id * 1000 + turn AS id, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}"
PREDS = f"SELECT id, text FROM ({_TURNS}) AS t WHERE role = 'assistant'"
REFS = f"""SELECT id, 0 AS ref, CASE id % 3 WHEN 0 THEN replace(text, 'e', 'E') WHEN 1 THEN text || ' ' || coalesce(before, '') ELSE coalesce(before, text) END AS text FROM ({_TURNS}) AS t WHERE role = 'assistant'
    UNION ALL SELECT id, 1, before FROM ({_TURNS}) AS t WHERE role = 'assistant' AND before IS NOT NULL"""
GROUPED = "SELECT conv_id AS group_id, turn AS id, text FROM {conversations}"


def _pairs(spark, sf):
    return frame(spark, sf, PREDS), frame(spark, sf, REFS)


def _rounded(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


def _metric(name):
    return lambda spark, sf: _rounded(M.METRICS[name](*_pairs(spark, sf)), "value")


def met1(spark, sf):
    return M.metric_tokens(frame(spark, sf, PREDS)).groupBy("token").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


def met2(spark, sf):
    return M.ngrams(frame(spark, sf, PREDS), 2)


def met4(spark, sf):
    return _rounded(M.bleu_corpus(*_pairs(spark, sf)), "bleu")


def met8(spark, sf):
    v = table(spark, sf, "embeddings")
    p = v.select((F.col("vec_id") / 10).cast("long").alias("id"), (F.col("vec_id") % 10).alias("pos"), "embedding")
    return M.bertscore(p.where("pos < 5"), p.where("pos >= 5")).select("id", *(F.round(c, 5).alias(c) for c in ("precision", "recall", "f1")))


def met9(spark, sf):
    return _rounded(M.self_bleu(frame(spark, sf, GROUPED), by="group_id"), "value", "std", "diversity")


def met10(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("group"), "text")
    return _rounded(M.distinct_n(docs), "value")


def met11(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return M.grammar(docs).select("id", F.round("value", 6).alias("value"), F.array_join("issues", ",").alias("issues"))


def _vecs(spark, sf, shift=0, name="id"):
    return table(spark, sf, "embeddings").select((F.col("vec_id") - shift).alias(name), "embedding")


def met14(spark, sf):
    return M.semantic_similarity(_vecs(spark, sf), _vecs(spark, sf, 1)).select("id", F.round("value", 5).alias("value"))


def met15(spark, sf):
    q = _vecs(spark, sf, 0, "query_id").where("query_id % 50 = 0")
    return M.context_relevance(q, _dense(spark, sf), _vecs(spark, sf, 0, "chunk_id")).select("query_id", F.round("value", 5).alias("value"))


def met16(spark, sf):
    p, r = _pairs(spark, sf)
    v = M.faithfulness_vec(R.embed(p), R.embed(r.where("ref = 0").select("id", "text")))
    return v.select("id", F.round("similarity", 6).alias("value"))


def met17(spark, sf):
    answers = R.extractive_answer(_items(spark, sf), R.overlap_topk(_items(spark, sf), _docs(spark, sf), 5).join(_docs(spark, sf), "chunk_id"))
    return _rounded(M.faithfulness(answers, R.overlap_topk(_items(spark, sf), _docs(spark, sf), 2), _docs(spark, sf)), "value")


def met18(spark, sf):
    return R.pair_cosine(_vecs(spark, sf), _vecs(spark, sf, 2), "id").select("id", F.round("similarity", 5).alias("value"))


def met19(spark, sf):
    top = _dense(spark, sf)
    return _rounded(M.context_precision(top, top.where("chunk_id % 3 = 0").select("query_id", "chunk_id")), "value")


def met20(spark, sf):
    p, r = _pairs(spark, sf)
    return _rounded(M.answer_overlap(p, r.where("id % 3 > 0")), "bleu", "rouge_l")


def met21(spark, sf):
    long = M.compute_metrics(*_pairs(spark, sf), ["bleu", "rouge1", "meteor", "exact_match", "contains", "grammar"])
    return long.groupBy("metric_name").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def met21_isolated(spark, sf):
    """One metric is unknown and fails alone."""
    long = M.compute_isolated(*_pairs(spark, sf), ["bleu", "no such metric", "exact_match"])
    return long.groupBy("metric_name", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def met21_batch(spark, sf):
    long = M.compute_metrics(*_pairs(spark, sf), ["bleu", "rouge1", "meteor"])
    return _rounded(M.batch_figures(long), "mean", "std")


def met11_issues(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return M.issue_counts(M.grammar(docs))


def met22(spark, sf):
    p, r = _pairs(spark, sf)
    scores = M.rouge_n(p, r, 1).select("id", F.when(F.col("id") % 5 == 0, F.col("value") + 1.5).otherwise(F.col("value")).alias("score"))
    return M.score_violations(scores).select("id")


QUERIES = {
    "met1_metric_tokens": met1, "met2_ngrams": met2, "met3_bleu_sentence": _metric("bleu"), "met4_bleu_corpus": met4, "met5_rouge1": _metric("rouge1"), "met5_rouge2": _metric("rouge2"),
    "met6_rouge_l": _metric("rougeL"), "met7_meteor": _metric("meteor"), "met8_bertscore": met8, "met9_self_bleu": met9, "met10_distinct_n": met10, "met11_grammar": met11,
    "met12_exact_match": _metric("exact_match"), "met13_contains_answer": _metric("contains"), "met14_semantic_similarity": met14, "met15_context_relevance": met15,
    "met16_faithfulness_vec": met16, "met17_faithfulness": met17, "met18_answer_relevance": met18, "met19_context_precision": met19, "met20_answer_overlap": met20,
    "met21_compute_metrics": met21, "met21_isolated": met21_isolated, "met21_batch": met21_batch, "met11_issues": met11_issues, "met22_score_violations": met22,
}

_NORMAL = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w <> '')"
_PLAIN = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"


def _sets(split: str, order: int, low: int = 1) -> str:
    return f"""pw AS (SELECT id, {split} AS w FROM ({plain(PREDS)}) x), rw AS (SELECT id, ref, {split} AS w FROM ({plain(REFS)}) x
    ), pg AS (SELECT id, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS cnt FROM pw, unnest(range({low}, {order + 1})) AS a(n), unnest(range(1, len(w) - n + 2)) AS b(i) GROUP BY ALL
    ), rg AS (SELECT id, ref, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS cnt FROM rw, unnest(range({low}, {order + 1})) AS a(n), unnest(range(1, len(w) - n + 2)) AS b(i) GROUP BY ALL
    ), sh AS (SELECT pg.id, ref, n, sum(least(pg.cnt, rg.cnt)) AS m FROM pg JOIN rg USING (id, n, gram) GROUP BY ALL)"""


def _rouge(n: int) -> str:
    return f"""WITH {_sets(_NORMAL, n, n)} SELECT pw.id, round(CASE WHEN p + r > 0 THEN 2.0 * coalesce(m, 0) / (p + r) ELSE 0 END, 6) AS value
        FROM (SELECT id, greatest(len(w) - {n - 1}, 0) AS p FROM pw) pw JOIN (SELECT id, greatest(len(w) - {n - 1}, 0) AS r FROM rw WHERE ref = 0) rw USING (id) LEFT JOIN (SELECT * FROM sh WHERE ref = 0) s USING (id)"""


_BLEU = f"""WITH {_sets(_PLAIN, 4)}, pr AS (
        SELECT pw.id, rw.ref, len(pw.w) AS pl, len(rw.w) AS rl, sum(ln(greatest(1e-10, coalesce(m / greatest(len(pw.w) - (k - 1), 1), 0)))) / 4 AS g
        FROM pw JOIN rw USING (id), unnest(range(1, 5)) AS t(k) LEFT JOIN sh ON sh.id = pw.id AND sh.ref = rw.ref AND sh.n = k GROUP BY ALL
    ), bleu AS (SELECT id, max(CASE WHEN pl > rl THEN 1 WHEN pl = 0 OR rl = 0 THEN 0 ELSE exp(1 - rl / pl) END * exp(g)) AS value FROM pr GROUP BY id)"""
_BLEU_FIRST = _BLEU.replace("FROM pw JOIN rw USING (id), unnest", "FROM pw JOIN (SELECT * FROM rw WHERE ref = 0) rw USING (id), unnest")
_LOWERED = f"""WITH p AS (SELECT id, trim(lower(coalesce(text, ''))) AS p FROM ({plain(PREDS)}) x), r AS (SELECT id, trim(lower(coalesce(text, ''))) AS r FROM ({plain(REFS)}) x WHERE ref = 0)"""
_METEOR = f"""WITH {_sets(_NORMAL, 1)}, z AS (SELECT pw.id, pw.w AS p, rw.w AS r, coalesce(m, 0) AS m FROM pw JOIN rw ON rw.id = pw.id AND rw.ref = 0 LEFT JOIN sh ON sh.id = pw.id AND sh.ref = 0
    ), c AS (SELECT *, len(list_filter(range(1, len(p) + 1), lambda i: list_contains(r, p[i]) AND (i = 1 OR NOT list_contains(r, p[i - 1])))) AS chunks FROM z
    ), meteor AS (SELECT id, CASE WHEN m > 0 THEN (m / len(p) * m / len(r)) / (0.9 * m / len(p) + 0.1 * m / len(r)) * (1 - 0.5 * pow(chunks / m, 3)) ELSE 0 END AS value FROM c)"""
_LCS = """pt AS (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM pw), rt AS (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) AS j FROM rw WHERE ref = 0
    ), l AS (SELECT id, 0 AS i, j, token, 0 AS best FROM rt
        UNION ALL SELECT id, i + 1, j, token, max(v) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) AS best
        FROM (SELECT l.id, l.i, l.j, l.token, greatest(best, CASE WHEN l.token = pt.token THEN 1 + coalesce(lag(best) OVER (PARTITION BY l.id ORDER BY l.j), 0) ELSE 0 END) AS v FROM l JOIN pt ON pt.id = l.id AND pt.i = l.i + 1) AS step
    ), longest AS (SELECT id, max(best) AS m FROM l GROUP BY id
    ), rouge AS (SELECT p.id, CASE WHEN len(p.w) + len(r.w) > 0 THEN 2.0 * coalesce(m, 0) / (len(p.w) + len(r.w)) ELSE 0 END AS value FROM pw p JOIN rw r ON r.id = p.id AND r.ref = 0 LEFT JOIN longest ON longest.id = p.id)"""
_FLAGS = [
    (r"[.!?]{2,}", 0.3, "repeated_punctuation"), (r"\s[,.!?;:]", 0.2, "missing_space_before_punctuation"), (r"[a-zA-Z][A-Z]{2,}[a-zA-Z]", 0.1, "unlikely_caps"),
    (r"\([^)]*\z", 0.4, "unbalanced_paren"), (r'"[^"]*\z', 0.4, "unbalanced_quote"), (r"\s{2,}", 0.1, "multiple_spaces"), (r"[\x{4e00}-\x{9fff}]", 0.0, "chinese_chars"),
]
_GRAMMAR = "round(greatest(0, 1 - (" + " + ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN CAST({w} AS DOUBLE) ELSE 0 END" for p, w, _ in _FLAGS) + ")), 6)"
_ISSUES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for p, _, n in _FLAGS) + "], lambda x: x IS NOT NULL), ',')"
_VEC = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_COS = "greatest(0, least(1, " + _VEC.format("a.embedding", "b.embedding") + " / (sqrt(" + _VEC.format("a.embedding", "a.embedding") + ") * sqrt(" + _VEC.format("b.embedding", "b.embedding") + "))))"

ORACLE = {
    "met1_metric_tokens": f"WITH t AS (SELECT {_NORMAL} AS w FROM ({plain(PREDS)}) x), u AS (SELECT unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM t) SELECT token, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM u GROUP BY token",
    "met2_ngrams": f"WITH {_sets(_NORMAL, 2, 2)} SELECT id, gram, cnt FROM pg",
    "met3_bleu_sentence": _BLEU + " SELECT id, round(value, 6) AS value FROM bleu",
    "met4_bleu_corpus": f"""WITH {_sets(_PLAIN, 4)}, best AS (SELECT id, n, gram, max(cnt) AS rcnt FROM rg GROUP BY ALL
        ), pool AS (SELECT n, CAST(sum(least(pg.cnt, coalesce(rcnt, 0))) AS DOUBLE) AS m, CAST(sum(pg.cnt) AS DOUBLE) AS t FROM pg LEFT JOIN best USING (id, n, gram) GROUP BY n
        ), z AS (SELECT *, count(*) FILTER (m = 0) OVER (ORDER BY n) AS zeros FROM pool
        ), l AS (SELECT pw.id, len(pw.w) AS pl, arg_min(len(rw.w), (abs(len(pw.w) - len(rw.w)), len(rw.w))) AS rl FROM pw JOIN rw USING (id) GROUP BY ALL
        ), s AS (SELECT sum(pl) AS pl, sum(rl) AS rl FROM l)
        SELECT round(CASE WHEN pl >= rl THEN 1 ELSE exp(1 - rl / pl) END * exp((SELECT sum(CASE WHEN m > 0 THEN ln(m / t) ELSE ln(1 / pow(2, zeros) / t) END) FROM z) / 4), 6) AS bleu FROM s""",
    "met5_rouge1": _rouge(1), "met5_rouge2": _rouge(2),
    "met6_rouge_l": f"WITH RECURSIVE {_sets(_NORMAL, 1)}, {_LCS} SELECT id, round(value, 6) AS value FROM rouge",
    "met20_answer_overlap": f"""WITH has AS (SELECT id FROM ({plain(REFS)}) x WHERE ref = 0 AND id % 3 > 0 AND text IS NOT NULL AND trim(text) <> ''
        ), b AS ({_BLEU_FIRST} SELECT id, value FROM bleu), r AS (WITH RECURSIVE {_sets(_NORMAL, 1)}, {_LCS} SELECT id, value FROM rouge)
        SELECT p.id, CASE WHEN has.id IS NULL THEN 0 ELSE round(b.value, 6) END AS bleu, CASE WHEN has.id IS NULL THEN 0 ELSE round(r.value, 6) END AS rouge_l, len({_PLAIN}) AS n_words
        FROM ({plain(PREDS)}) p LEFT JOIN has USING (id) LEFT JOIN b USING (id) LEFT JOIN r USING (id)""",
    "met21_isolated": f"""{_BLEU}, e AS ({_LOWERED} SELECT CASE WHEN p = r THEN 1.0::DOUBLE ELSE 0 END AS v FROM p JOIN r USING (id))
        SELECT 'bleu' AS metric_name, false AS failed, count(*) AS n, round(avg(value), 6) AS mean FROM bleu UNION ALL SELECT 'exact_match', false, count(*), round(avg(v), 6) FROM e UNION ALL SELECT 'no such metric', true, 1, 0""",
    "met21_batch": f"""WITH b AS ({_BLEU} SELECT value FROM bleu), m AS ({_METEOR} SELECT value FROM meteor), r AS ({_rouge(1)}), v AS (
            SELECT 'bleu' AS metric_name, value FROM b UNION ALL SELECT 'meteor', value FROM m UNION ALL SELECT 'rouge1', value FROM r)
        SELECT metric_name, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM v GROUP BY metric_name""",
    "met11_issues": f"SELECT issue, count(*) AS n FROM (SELECT unnest(string_split({_ISSUES}, ',')) AS issue FROM documents) WHERE issue <> '' GROUP BY issue",
    "met7_meteor": _METEOR + " SELECT id, round(value, 6) AS value FROM meteor",
    "met8_bertscore": f"""WITH v AS (SELECT vec_id // 10 AS id, vec_id % 10 AS pos, embedding FROM embeddings), s AS (SELECT a.id, a.pos AS p, b.pos AS r, {_VEC.format('a.embedding', 'b.embedding')} AS s FROM v a JOIN v b ON a.id = b.id AND a.pos < 5 AND b.pos >= 5
        ), p AS (SELECT id, avg(s) AS p FROM (SELECT id, p, max(s) AS s FROM s GROUP BY ALL) GROUP BY id), r AS (SELECT id, avg(s) AS r FROM (SELECT id, r, max(s) AS s FROM s GROUP BY ALL) GROUP BY id)
        SELECT id, round(p, 5) AS precision, round(r, 5) AS recall, round(2 * p * r / (p + r), 5) AS f1 FROM p JOIN r USING (id)""",
    "met9_self_bleu": f"""WITH w AS (SELECT conv_id AS g, turn AS id, {_NORMAL} AS w FROM conversations), c AS (
            SELECT g, id, n, array_to_string(w[i:i + n - 1], ' ') AS gram, count(*) AS cnt FROM w, unnest(range(1, 5)) AS a(n), unnest(range(1, len(w) - n + 2)) AS b(i) GROUP BY ALL
        ), sh AS (SELECT a.g, a.id, b.id AS o, a.n, sum(least(a.cnt, b.cnt)) AS m FROM c a JOIN c b ON a.g = b.g AND a.n = b.n AND a.gram = b.gram AND a.id <> b.id GROUP BY ALL
        ), pr AS (SELECT x.g, x.id, y.id AS o, exp(sum(ln(greatest(1e-10, coalesce(m / greatest(len(x.w) - (k - 1), 1), 0)))) / 4) AS v
                  FROM w x JOIN w y ON x.g = y.g AND x.id <> y.id, unnest(range(1, 5)) AS t(k) LEFT JOIN sh ON sh.g = x.g AND sh.id = x.id AND sh.o = y.id AND sh.n = k GROUP BY ALL
        ), best AS (SELECT g, id, max(v) AS v FROM pr GROUP BY ALL)
        SELECT w.g AS group_id, round(coalesce(avg(v), 0), 6) AS value, round(coalesce(stddev_pop(v), 0), 6) AS std, round(coalesce(1 - avg(v), 0), 6) AS diversity, count(*) AS n_texts FROM w LEFT JOIN best ON best.g = w.g AND best.id = w.id GROUP BY w.g""",
    "met10_distinct_n": f"""WITH w AS (SELECT lang, doc_id, {_NORMAL} AS w FROM documents), g AS (SELECT DISTINCT lang, doc_id, array_to_string(w[i:i + 1], ' ') AS gram FROM w, unnest(range(1, len(w))) AS t(i))
        SELECT lang AS "group", count(DISTINCT gram) AS "unique", count(*) AS total, round(count(DISTINCT gram) / count(*), 6) AS value FROM g GROUP BY lang""",
    "met11_grammar": f"SELECT doc_id AS id, {_GRAMMAR} AS value, {_ISSUES} AS issues FROM documents",
    "met12_exact_match": _LOWERED + " SELECT id, CASE WHEN p = r THEN 1.0::DOUBLE ELSE 0 END AS value FROM p JOIN r USING (id)",
    "met13_contains_answer": _LOWERED + " SELECT id, CASE WHEN contains(p, r) OR contains(r, p) THEN 1.0::DOUBLE ELSE 0 END AS value FROM p JOIN r USING (id)",
    "met14_semantic_similarity": f"SELECT a.vec_id AS id, round({_VEC.format('a.embedding', 'b.embedding')}, 5) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "met15_context_relevance": f"WITH {_TOP}, v AS (SELECT query_id, avg(score) AS v FROM top GROUP BY query_id) SELECT vec_id AS query_id, round(coalesce(v, 0), 5) AS value FROM embeddings LEFT JOIN v ON query_id = vec_id WHERE vec_id % 50 = 0",
    "met16_faithfulness_vec": f"""WITH e_in AS (SELECT id * 2 AS id, text FROM ({plain(PREDS)}) p UNION ALL SELECT id * 2 + 1, text FROM ({plain(REFS)}) r WHERE ref = 0), {_EMBED}
        SELECT a.id // 2 AS id, round(coalesce({_COS}, 0), 6) AS value FROM e a JOIN e b ON b.id = a.id + 1 AND a.id % 2 = 0""",
    "met17_faithfulness": _OVERLAP + f""", ans AS (SELECT item_id AS query_id, coalesce('Based on the documents: ' || substr(string_agg(substr(d.text, 1, 200), ' ' ORDER BY rank), 1, 500), 'No relevant documents were found.') AS text
            FROM benchmark LEFT JOIN ov ON item_id = query_id LEFT JOIN documents d ON d.doc_id = chunk_id GROUP BY item_id
        ), said AS (SELECT DISTINCT query_id, unnest({_TOKENS}) AS t FROM ans), known AS (SELECT DISTINCT query_id, unnest({_TOKENS}) AS t FROM ov JOIN documents ON doc_id = chunk_id WHERE rank <= 2)
        SELECT query_id, round(avg(CASE WHEN known.t IS NULL THEN 0.0 ELSE 1 END), 6) AS value FROM said LEFT JOIN known USING (query_id, t) GROUP BY query_id""",
    "met18_answer_relevance": f"SELECT a.vec_id AS id, round({_COS}, 5) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 2",
    "met19_context_precision": f"WITH {_TOP} SELECT query_id, round(avg(CASE WHEN chunk_id % 3 = 0 THEN 1.0 ELSE 0 END), 6) AS value FROM top GROUP BY query_id",
    "met21_compute_metrics": f"""{_BLEU}, {_METEOR[5:].replace('pw AS', 'pw2 AS').replace('rw AS', 'rw2 AS').replace('pg AS', 'pg2 AS').replace('rg AS', 'rg2 AS').replace('sh AS', 'sh2 AS').replace('FROM pw,', 'FROM pw2,').replace('FROM rw,', 'FROM rw2,').replace('FROM pg JOIN rg USING', 'FROM pg2 pg JOIN rg2 rg USING').replace('FROM pw JOIN rw ON', 'FROM pw2 pw JOIN rw2 rw ON').replace('LEFT JOIN sh ON', 'LEFT JOIN sh2 sh ON')},
        {_LOWERED[5:].replace('p AS', 'pl AS', 1).replace('r AS (SELECT id', 'rl AS (SELECT id')}, r1 AS ({_rouge(1)})
        SELECT 'bleu' AS metric_name, count(*) AS n, round(avg(value), 6) AS mean FROM bleu UNION ALL SELECT 'meteor', count(*), round(avg(value), 6) FROM meteor
        UNION ALL SELECT 'rouge1', count(*), round(avg(value), 6) FROM r1 UNION ALL SELECT 'exact_match', count(*), round(avg(CASE WHEN p = r THEN 1.0 ELSE 0 END), 6) FROM pl JOIN rl USING (id)
        UNION ALL SELECT 'contains', count(*), round(avg(CASE WHEN contains(p, r) OR contains(r, p) THEN 1.0 ELSE 0 END), 6) FROM pl JOIN rl USING (id)
        UNION ALL SELECT 'grammar', count(*), round(avg({_GRAMMAR}), 6) FROM ({plain(PREDS)}) x""",
    "met22_score_violations": f"SELECT id FROM ({_rouge(1)}) x WHERE id % 5 = 0",
}
