"""Queries of embedding, retrieval and ranking metrics.

Vector queries are the rows whose id is divisible by 50, against all rows; a chunk is relevant if it has
the query's label. Text queries are the benchmark items, against documents or their chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import ir_metrics as I
from granary.operators import retrieval as R
from granary.operators.text import chunk_fixed

from granary.sources.vector_index import RefusedBatch, append_batch, read_index

from .common import scratch_path, table
from .text import _PIECES

K = 10


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding")


def _dense(spark, sf, k=K):
    return R.dense_topk(*_vectors(spark, sf), k)


def _judged(spark, sf):
    return I.judge_by_label(_dense(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"))


def _items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _chunks(spark, sf):
    return chunk_fixed(table(spark, sf, "documents")).select("chunk_id", "doc_id", F.col("content").alias("text"))


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def emb1(spark, sf):
    return R.embed(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def ret1(spark, sf):
    return _dense(spark, sf).withColumn("score", F.round("score", 5))


def ret2(spark, sf):
    v = table(spark, sf, "embeddings")
    return R.pair_cosine(v.select("vec_id", "embedding"), v.select((F.col("vec_id") - 1).alias("vec_id"), "embedding"), "vec_id").withColumn("similarity", F.round("similarity", 5))


def ret3(spark, sf):
    t = R.token_table(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_docs"), F.sum("pos").alias("pos_sum"))


def ret4(spark, sf):
    _, df, stats = R.build_postings(_chunks(spark, sf))
    return df.crossJoin(F.broadcast(stats.select("n_docs", "n_chunks", F.round("avg_chars", 6).alias("avg_chars"), F.round("avg_tokens", 6).alias("avg_tokens"))))


def ret5(spark, sf):
    return R.bm25_topk(_items(spark, sf), _chunks(spark, sf), K).withColumn("score", F.round("score", 6))


def ret6(spark, sf):
    texts = _items(spark, sf).select((-1 - F.col("query_id")).alias("id"), "text").union(_docs(spark, sf).select("chunk_id", "text"))
    vectors = R.embed(texts)
    dense = R.dense_topk(vectors.where("id < 0").select(F.col("id").alias("query_id"), "embedding"), vectors.where("id >= 0").select(F.col("id").alias("chunk_id"), "embedding"), 2 * K)
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    return R.bm25_hybrid_topk(_items(spark, sf), chunks, dense.withColumn("query_id", -1 - F.col("query_id")), K).withColumn("score", F.round("score", 5))


def ret7(spark, sf):
    return R.overlap_topk(_items(spark, sf), _docs(spark, sf), 5)


def _context(spark, sf):
    return R.overlap_topk(_items(spark, sf), _docs(spark, sf), 5).join(_docs(spark, sf), "chunk_id")


def ret13(spark, sf):
    return R.pack_context(_context(spark, sf)).select("query_id", "n_parts", F.sha2("context", 256).alias("context_sha256"))


def ret14(spark, sf):
    return R.extractive_answer(_items(spark, sf), _context(spark, sf).where("query_id % 3 > 0"))


def ret15(spark, sf):
    answers = R.extractive_answer(_items(spark, sf).where("query_id % 3 > 0"), _context(spark, sf).where("query_id % 3 > 0"))
    return R.answer_defaults(_items(spark, sf), answers)


def ret16(spark, sf):
    """Retrieve, judge, measure and aggregate in one plan."""
    out = I.aggregate_scores(I.retrieval_metrics(_judged(spark, sf), (1, 3, 5), "distinct"))
    return out.select("metric", "k", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_queries")


def snk5(spark, sf):
    v = table(spark, sf, "embeddings")
    merged = R.append_index(v.where("vec_id % 2 = 0").select("vec_id", "embedding"), v.where("vec_id % 2 = 1").select("vec_id", "embedding"), 64)
    return merged.groupBy((F.col("vec_id") % 10).alias("part")).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim"))


def _signed_round(x, digits):
    """Rounded, where what is rounded to zero keeps its sign."""
    rounded = F.round(x, digits)
    return F.when(rounded == 0, x * F.lit(0.0)).otherwise(rounded)


def snk5_batches(spark, sf):
    """Two batches that fit, and one with vectors missing, which is refused."""
    path, v = scratch_path(spark, "index"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    for part in (0, 1):
        some = v.where(F.col("chunk_id") % 3 == part)
        append_batch(some, some, path, 64)
    rest = v.where("chunk_id % 3 = 2")
    try:
        append_batch(rest, rest.where("chunk_id % 7 > 0"), path, 64)
    except RefusedBatch:
        return read_index(spark, path).select("chunk_id", F.transform("embedding", lambda x: _signed_round(x.cast("double"), 5)).alias("embedding"))
    raise AssertionError("a short batch was accepted")


def _metric(name, variants=("distinct", "list")):
    def run(spark, sf):
        judged = _judged(spark, sf)
        parts = [I.retrieval_metrics(judged, variant=v).where(F.col("metric") == name).select("query_id", "k", F.round("value", 6).alias("value"), F.lit(v).alias("variant")) for v in variants]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    return run


def ir6(spark, sf):
    """Queries without relevant chunks: absent in one variant, zero in the other."""
    judged = _judged(spark, sf).withColumn("n_relevant", F.when(F.col("query_id") % 100 == 0, 0).otherwise(F.col("n_relevant"))).withColumn("hit", F.col("hit") & (F.col("n_relevant") > 0))
    parts = [I.retrieval_metrics(judged, (5,), v).groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n")).withColumn("variant", F.lit(v)) for v in ("distinct", "list")]
    return parts[0].unionByName(parts[1])


def ir7(spark, sf):
    return ret16(spark, sf)


def ir8(spark, sf):
    judged = _judged(spark, sf)
    latency = judged.groupBy("query_id").agg((F.col("query_id") % 97).cast("double").alias("latency_ms"))
    run = I.aggregate_run(I.retrieval_metrics(judged, (1, 5)), latency)
    return run.select(*(F.round(c, 6).alias(c) for c in run.columns))


def ir9(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"))
    parts = I.pair_results(v.where("query_id % 3 > 0"), v.where("query_id % 2 = 0"))
    named = [p.groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n, p in zip(("paired", "no_result", "no_query"), parts, strict=True)]
    return named[0].union(named[1]).union(named[2])


QUERIES = {
    "emb1_embed": emb1, "ret1_dense_topk": ret1, "ret2_pair_cosine": ret2, "ret3_token_table": ret3, "ret4_build_postings": ret4, "ret5_bm25": ret5, "ret6_hybrid_topk": ret6,
    "ret7_overlap_topk": ret7, "ret13_pack_context": ret13, "ret14_extractive_answer": ret14, "ret15_answer_defaults": ret15, "ret16_run_benchmark": ret16, "snk5_batches": snk5_batches, "snk5_append_index": snk5,
    "ir1_precision_at_k": _metric("precision"), "ir2_recall_at_k": _metric("recall"), "ir3_mrr": _metric("mrr"), "ir4_ndcg_at_k": _metric("ndcg"), "ir5_hit_rate_at_k": _metric("hit_rate"),
    "ir6_no_relevant": ir6, "ir7_aggregate_scores": ir7, "ir8_aggregate_run": ir8, "ir9_pair_results": ir9,
}

_DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_TOP = f"""
    s AS (SELECT q.vec_id AS query_id, i.vec_id AS chunk_id, {_DOT.format('q.embedding', 'i.embedding')} AS score, q.label = i.label AS hit,
                 (SELECT count(*) - 1 FROM embeddings x WHERE x.label = q.label) AS n_relevant
          FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0
    ), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s QUALIFY rank <= 10)
"""
_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_SCORE = """
    p AS (SELECT token, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS token FROM c) GROUP BY ALL
    ), f AS (SELECT token, count(*) AS df FROM p GROUP BY token
    ), st AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, avg(length(text)) AS avg_chars, avg(len(t)) AS avg_tokens FROM c
    ), a AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest({0}) AS token FROM benchmark) GROUP BY ALL)
""".replace("{0}", _TOKENS)
_BM25 = "sum(ln(({n} - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / {avg})) * times)"
_CHUNKS = _PIECES.replace("SELECT doc_id || '_chunk_'", ", chunks AS (SELECT doc_id || '_chunk_'").rstrip() + f"), c AS (SELECT chunk_id, doc_id, content AS text, {_TOKENS.replace('text', 'content')} AS t FROM chunks), {_SCORE}"
_EMBED = r"""
    e0 AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS token FROM e_in
    ), e1 AS (SELECT id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS n FROM e0 GROUP BY ALL
    ), e2 AS (SELECT id, sqrt(sum(n * n)) AS norm FROM e1 GROUP BY id
    ), e AS (SELECT i.id, list(coalesce(e1.n / e2.norm, 0.0) ORDER BY d.b) AS embedding
             FROM e_in i CROSS JOIN (SELECT unnest(range(64)) AS b) d LEFT JOIN e1 ON e1.id = i.id AND e1.b = d.b LEFT JOIN e2 ON e2.id = i.id GROUP BY i.id)
"""
_OVERLAP = r"""
    WITH qw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')) AS w FROM benchmark
    ), dw AS (SELECT DISTINCT doc_id AS chunk_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\s+')) AS w FROM documents
    ), o AS (SELECT query_id, chunk_id, CAST(count(*) AS DOUBLE) AS score FROM qw JOIN dw USING (w) WHERE w <> '' GROUP BY ALL
    ), every AS (SELECT item_id AS query_id, doc_id AS chunk_id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN o ON o.query_id = item_id AND o.chunk_id = doc_id
    ), ov AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM every QUALIFY rank <= 5)
"""
_PER = """
    per AS (SELECT query_id, k, variant, max(n_relevant) AS rel, CAST(count(*) FILTER (hit AND rank <= k) AS DOUBLE) AS hits, count(*) FILTER (rank <= k) AS n,
                   coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= k), 0) AS gain
            FROM top, (SELECT unnest([1, 3, 5, 10]) AS k) ks, (SELECT unnest(['distinct', 'list']) AS variant) vs GROUP BY ALL
    ), m AS (SELECT *, (SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, 1 + CAST(CASE variant WHEN 'distinct' THEN least(k, rel) ELSE least(k, rel, n) END AS BIGINT))) AS t(i)) AS ideal FROM per WHERE variant = 'list' OR rel > 0)
"""


def _ir(value: str) -> str:
    return f"WITH {_TOP}, {_PER} SELECT query_id, k, variant, CAST(round({value}, 6) AS DOUBLE) AS value FROM m"


_LONG = """
    long AS (SELECT query_id, 'precision' AS metric, k, CASE variant WHEN 'distinct' THEN hits / k ELSE hits / least(k, n) END AS value, variant FROM m
             UNION ALL SELECT query_id, 'recall', k, hits / nullif(rel, 0), variant FROM m UNION ALL SELECT query_id, 'ndcg', k, coalesce(gain / ideal, 0), variant FROM m
             UNION ALL SELECT query_id, 'hit_rate', k, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END, variant FROM m
             UNION ALL SELECT query_id, 'mrr', 0, coalesce(1.0 / min(rank) FILTER (hit), 0), variant FROM top, (SELECT unnest(['distinct', 'list']) AS variant) vs GROUP BY query_id, variant)
"""
_AGGREGATE = f"""WITH {_TOP}, {_PER}, {_LONG}
    SELECT metric, k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_queries FROM long WHERE variant = 'distinct' AND k IN (0, 1, 3, 5) GROUP BY metric, k"""

ORACLE = {
    "emb1_embed": f"WITH e_in AS (SELECT doc_id AS id, text FROM documents), {_EMBED} SELECT id, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM e",
    "ret1_dense_topk": f"WITH {_TOP} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM top",
    "ret2_pair_cosine": f"""SELECT a.vec_id, round(greatest(0, least(1, {_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})))), 5) AS similarity
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "ret3_token_table": f"""WITH t AS (SELECT doc_id AS id, {_TOKENS} AS ts FROM documents), x AS (SELECT id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM t)
        SELECT token, count(*) AS n, count(DISTINCT id) AS n_docs, CAST(sum(pos) AS BIGINT) AS pos_sum FROM x GROUP BY token""",
    "ret4_build_postings": _CHUNKS + "SELECT token, df, n_docs, n_chunks, round(avg_chars, 6) AS avg_chars, round(avg_tokens, 6) AS avg_tokens FROM f, st",
    "ret5_bm25": _CHUNKS + f""", sc AS (
            SELECT query_id, chunk_id, round({_BM25.format(n='n_docs', avg='avg_chars')}, 6) AS score, 'reference' AS mode FROM a JOIN f USING (token) JOIN p USING (token), st GROUP BY ALL
            UNION ALL SELECT query_id, chunk_id, round({_BM25.format(n='n_chunks', avg='avg_tokens')}, 6), 'standard' FROM a JOIN f USING (token) JOIN p USING (token), st GROUP BY ALL)
        SELECT query_id, chunk_id, score, mode, CAST(row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM sc QUALIFY rank <= 10""",
    "ret6_hybrid_topk": f"""WITH e_in AS (SELECT -1 - item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents), {_EMBED},
        c AS (SELECT doc_id AS chunk_id, doc_id, text, {_TOKENS} AS t FROM documents), {_SCORE},
        sc AS (SELECT query_id, chunk_id, {_BM25.format(n='n_docs', avg='avg_chars')} AS score FROM a JOIN f USING (token) JOIN p USING (token), st GROUP BY ALL
        ), de AS (SELECT -1 - q.id AS query_id, i.id AS chunk_id, list_dot_product(q.embedding, i.embedding) AS score FROM e q JOIN e i ON q.id < 0 AND i.id >= 0
                  QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.embedding, i.embedding), 9) DESC, i.id) <= 20
        ), h AS (SELECT query_id, chunk_id, 0.7 * coalesce(de.score, 0) + 0.3 * coalesce(sc.score, 0) AS score FROM de FULL JOIN sc USING (query_id, chunk_id))
        SELECT query_id, chunk_id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(h.score, 9) DESC, chunk_id) AS INT) AS rank FROM h QUALIFY rank <= 10""",
    "ret7_overlap_topk": _OVERLAP + "SELECT * FROM ov",
    "ret13_pack_context": _OVERLAP + """, pt AS (SELECT query_id, rank, '[' || rank || '] ' || text AS part FROM ov JOIN documents ON doc_id = chunk_id
        ), run AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM pt)
        SELECT query_id, count(*) AS n_parts, sha256(string_agg(part, chr(10) || chr(10) ORDER BY rank)) AS context_sha256 FROM run WHERE total <= 3000 GROUP BY query_id""",
    "ret14_extractive_answer": _OVERLAP + """SELECT item_id AS query_id, coalesce('Based on the documents: ' || substr(string_agg(substr(d.text, 1, 200), ' ' ORDER BY rank), 1, 500), 'No relevant documents were found.') AS answer
        FROM benchmark LEFT JOIN (SELECT * FROM ov WHERE query_id % 3 > 0) o ON item_id = query_id LEFT JOIN documents d ON d.doc_id = o.chunk_id GROUP BY item_id""",
    "ret15_answer_defaults": _OVERLAP + """SELECT item_id AS query_id, coalesce('Based on the documents: ' || substr(string_agg(substr(d.text, 1, 200), ' ' ORDER BY rank), 1, 500), 'No answer.') AS answer
        FROM benchmark LEFT JOIN (SELECT * FROM ov WHERE query_id % 3 > 0) o ON item_id = query_id LEFT JOIN documents d ON d.doc_id = o.chunk_id GROUP BY item_id""",
    "ret16_run_benchmark": _AGGREGATE,
    "snk5_batches": "SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 5)) AS embedding FROM embeddings WHERE vec_id % 3 < 2",
    "snk5_append_index": "SELECT vec_id % 10 AS part, count(*) AS n, CAST(min(len(embedding)) AS INT) AS dim FROM embeddings GROUP BY 1",
    "ir1_precision_at_k": _ir("CASE variant WHEN 'distinct' THEN hits / k ELSE hits / least(k, n) END"),
    "ir2_recall_at_k": _ir("CASE WHEN rel > 0 THEN hits / rel ELSE 0 END"),
    "ir3_mrr": f"WITH {_TOP} SELECT query_id, 0 AS k, variant, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 6) AS value FROM top, (SELECT unnest(['distinct', 'list']) AS variant) vs WHERE variant = 'list' OR n_relevant > 0 GROUP BY query_id, variant",
    "ir4_ndcg_at_k": _ir("CASE WHEN ideal > 0 THEN gain / ideal ELSE 0 END"),
    "ir5_hit_rate_at_k": _ir("CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END"),
    "ir6_no_relevant": f"""WITH {_TOP}, {_PER}, {_LONG}
        SELECT metric, variant, round(avg(CASE WHEN query_id % 100 = 0 THEN 0 ELSE value END), 6) AS mean, count(*) AS n FROM long WHERE k IN (0, 5) AND (variant = 'list' OR query_id % 100 <> 0) GROUP BY metric, variant""",
    "ir7_aggregate_scores": _AGGREGATE,
    "ir8_aggregate_run": f"""WITH {_TOP}, {_PER}, {_LONG}, l AS (SELECT DISTINCT query_id, CAST(query_id % 97 AS DOUBLE) AS ms FROM top), v AS (SELECT * FROM long WHERE variant = 'list')
        SELECT {', '.join(f"round(avg(value) FILTER (metric = '{m}' AND k = {k}), 6) AS avg_{m}_at_{k}" for m in ('precision', 'recall', 'ndcg', 'hit_rate') for k in (1, 5))},
               round(avg(value) FILTER (metric = 'mrr'), 6) AS avg_mrr, round((SELECT avg(ms) FROM l), 6) AS avg_latency_ms, round((SELECT median(ms) FROM l), 6) AS median_latency_ms FROM v""",
    "ir9_pair_results": """SELECT 'paired' AS part, count(*) AS n FROM embeddings WHERE vec_id % 3 > 0 AND vec_id % 2 = 0 UNION ALL SELECT 'no_result', count(*) FROM embeddings WHERE vec_id % 3 > 0 AND vec_id % 2 > 0
        UNION ALL SELECT 'no_query', count(*) FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 0""",
}
