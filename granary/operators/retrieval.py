"""Embeddings, dense and lexical retrieval, fusion and context packing.

Retrieved frames have (query_id, chunk_id, score, rank); ranks count from 1 and ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import saved

from . import balls, block_max
from .text import strip

#: Queries and index rows that one task multiplies; every block of queries meets every block of the index.
QUERY_BLOCK, INDEX_BLOCK = 1024, 32768
#: Chunks whose scores against a block of queries are held at once.
SCORED = 1024
#: Texts of one shard of postings.
SHARD = 8192
#: Pivots of a ball partition at most; they are held by the driver and every task.
MAX_PIVOTS = 1024
#: Parts that a token's postings are dealt over.
SALTS = 32
TOKEN = r"[\p{L}\p{N}_]+"


def _ranked(df: DataFrame, k: int | None, score: str = "score") -> DataFrame:
    # Scores that differ by rounding noise only are ties.
    order = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "chunk_id")
    out = df.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def embed(df: DataFrame, dim: int = 64) -> DataFrame:
    """(id, embedding): unit-length hashed bag of words; blank texts are a vector of zeros."""
    tokens = token_table(df).withColumn("b", F.pmod(F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    counts = tokens.groupBy("id", "b").agg(F.count("*").cast("double").alias("n"))
    vectors = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.get(F.map_values(F.map_filter("m", lambda k, v: k == i)), F.lit(0)), F.lit(0.0)) / F.col("norm"))
    return df.select("id").join(vectors.select("id", dense.alias("embedding")), "id", "left").select(
        "id", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)).alias("embedding")
    )


def append_index(index: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """The index with ``new`` rows; a vector of another length fails the job."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"embedding must have {dim} values")).cast("array<float>")))
    return index.unionByName(checked)


def meet(queries: DataFrame, index: DataFrame, q_id: str, i_id: str, kernel, schema: str, q_block: int = QUERY_BLOCK, i_block: int = INDEX_BLOCK, pool: str | None = None, *, q_weight: Column | None = None, i_weight: Column | None = None) -> DataFrame:
    """``kernel(query rows, index rows)`` for every pair of blocks, of the same ``pool`` if one is named. Each side
    is dealt by a hash of its id and sent once for each block of the other; no side passes the driver. Blocks
    hold so many rows, or so much of a weight."""
    per = [pool] if pool else []

    def blocks(df: DataFrame, size: int, weight: Column | None) -> DataFrame:
        total = F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))
        return df.groupBy(*per).agg(F.ceil(total / size).cast("int").alias("n_blocks"))

    def dealt(df: DataFrame, own: DataFrame, other: DataFrame, id_: str, names: tuple[str, str]) -> DataFrame:
        both = own.withColumnRenamed("n_blocks", "own_blocks").join(other.withColumnRenamed("n_blocks", "other_blocks"), per) if pool else own.withColumnRenamed("n_blocks", "own_blocks").crossJoin(other.withColumnRenamed("n_blocks", "other_blocks"))
        # a row for each pool, or just one
        out = df.join(both, per) if pool else df.crossJoin(F.broadcast(both))
        return out.withColumn(names[0], F.expr(f"pmod(xxhash64({id_}), own_blocks)").cast("int")).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))).drop("own_blocks", "other_blocks")

    nq, ni = blocks(queries, q_block, q_weight), blocks(index, i_block, i_weight)
    q, i = dealt(queries, nq, ni, q_id, ("qb", "ib")), dealt(index, ni, nq, i_id, ("ib", "qb"))
    q, i = (df.toDF(*df.columns) for df in (q, i))  # new attributes, should both come from one frame
    keys = [*per, "qb", "ib"]
    return q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInArrow(lambda left, right: kernel(left.combine_chunks(), right.combine_chunks()), schema)


def best(score: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest valid scores of each row, with all that tie with the last but for rounding."""
    score = np.where(valid, score, -np.inf)
    if score.shape[1] > k:
        limit = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        valid = valid & (score >= limit[:, None] - 1e-8)
    return np.nonzero(valid)


def ball_partition(index: DataFrame, max_pivots: int = MAX_PIVOTS, part: int = INDEX_BLOCK) -> DataFrame:
    """(chunk_id, embedding, cell, part): rows by the nearest of some pivots, about the root of their number and at most
    ``max_pivots``, drawn by a hash of their ids. A cell of more than ``part`` rows is dealt into parts."""
    rows = index.select("chunk_id", "embedding")
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(min(max_pivots, math.isqrt(n) + 1)).select("embedding").toArrow()
    if not n:
        return rows.withColumns({"cell": F.lit(0), "part": F.lit(0)})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    cells = saved(rows.mapInArrow(balls.nearest(balls.matrix(drawn.column("embedding"))), f"{kinds}, cell int"), "cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("long").alias("parts"))  # a row for each pivot
    return cells.join(F.broadcast(sizes), "cell").select("chunk_id", "embedding", "cell", F.pmod(F.xxhash64("chunk_id"), "parts").alias("part"))


def dense_topk(queries: DataFrame, index: DataFrame, k: int, q_block: int = QUERY_BLOCK, i_block: int = INDEX_BLOCK) -> DataFrame:
    """The k largest dot products of each query (query_id, embedding) over the index (chunk_id, embedding), the query's
    own id left out. Blocks of queries meet blocks of whole cells of a ball partition; each pair of blocks keeps its own
    k best and skips the cells that cannot hold any."""

    def multiply(q: pa.Table, x: pa.Table) -> pa.Table:
        ids, chunk = q.column("query_id").to_numpy(), x.column("chunk_id").to_numpy()
        if not len(ids) or not len(chunk):
            return _SCORED.empty_table()
        row, at, score, _ = balls.top(balls.matrix(q.column("embedding")), ids, balls.matrix(x.column("embedding")), chunk, x.column("cell").to_numpy(), k)
        return pa.table([ids[row], chunk[at], score], schema=_SCORED)

    cells = ball_partition(index, part=i_block)
    found = meet(queries.select("query_id", "embedding"), cells, "query_id", "cell, part", multiply, "query_id long, chunk_id long, score double", q_block, i_block)
    return _ranked(found, k)


_SCORED = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])


def shared_words(q: pa.Table, x: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of SCORED index rows: (first row, cells, query-word rows, times a word stands in a chunk, chunks,
    shape), a cell being query * rows + chunk for each word that a query (words in list ``t``) and a chunk share."""
    asked = q.column("t").combine_chunks()
    n_q = len(q)
    word, owner = np.asarray(asked.flatten()), np.repeat(np.arange(n_q), np.asarray(asked.value_lengths()))
    order = np.argsort(word, kind="stable")
    vocabulary, first = np.unique(word[order], return_index=True)
    ends = np.append(first[1:], len(word))
    lists = x.column("t").combine_chunks()
    for lo in range(0, len(x), SCORED):
        part = lists.slice(lo, SCORED)
        chunk = np.repeat(np.arange(len(part)), np.asarray(part.value_lengths()))
        tokens = np.asarray(part.flatten())
        at = np.minimum(np.searchsorted(vocabulary, tokens), max(len(vocabulary) - 1, 0))
        hit = vocabulary[at] == tokens if len(vocabulary) else np.zeros(len(tokens), bool)
        pair, tf = np.unique(at[hit] * len(part) + chunk[hit], return_counts=True)
        v, c = pair // max(len(part), 1), pair % max(len(part), 1)
        many = ends[v] - first[v] if len(v) else np.zeros(0, np.int64)
        total = np.cumsum(many)
        step = np.arange(total[-1] if len(total) else 0) - np.repeat(total - many, many)
        row = order[np.repeat(first[v] if len(v) else v, many) + step]
        yield lo, owner[row] * len(part) + np.repeat(c, many), row, np.repeat(tf, many), np.repeat(c, many), np.array([n_q, len(part)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pair_cosine(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(on, similarity): cosine of the vectors that share a key, clamped to [0, 1]; 0 for a zero vector."""
    pairs = left.select(on, F.col("embedding").alias("a")).join(right.select(on, F.col("embedding").alias("b")), on)
    norm = F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b")))
    return pairs.select(on, F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(F.col("a"), F.col("b")) / norm))).otherwise(0.0).alias("similarity"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_table(df: DataFrame) -> DataFrame:
    """(id, pos, token): lower-case runs of letters, digits and underscores."""
    return df.select("id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def build_postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings: token, chunk_id, tf, dl; document frequencies: token, df; one row of n_docs, n_chunks,
    avg_chars, avg_tokens) of chunks (chunk_id, doc_id, text)."""
    listed = chunks.select("chunk_id", "doc_id", "text", tokens(F.col("text")).alias("t"))
    postings = listed.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("token")).groupBy("token", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    stats = listed.agg(
        F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.avg(F.length("text")).alias("avg_chars"), F.avg(F.size("t")).alias("avg_tokens")
    )
    return postings, df, stats


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _weights(queries: DataFrame, df: DataFrame, stats: DataFrame, words: Column | None = None) -> DataFrame:
    """(query_id, token, times, idf_reference, idf_standard): ``reference`` counts documents as the original
    does, ``standard`` chunks."""
    words = tokens(F.col("text")) if words is None else words
    asked = queries.select("query_id", F.explode(words).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    idf = {m: F.ln((F.col(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) for m, n in (("reference", "n_docs"), ("standard", "n_chunks"))}
    return asked.join(df, "token").crossJoin(F.broadcast(stats)).select("query_id", "token", "times", *(c.alias(f"idf_{m}") for m, c in idf.items()))  # stats is one row


_AVERAGE = {"reference": "avg_chars", "standard": "avg_tokens"}


def bm25(queries: DataFrame, postings: DataFrame, df: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.75, mode: str = "reference") -> DataFrame:
    """(query_id, chunk_id, score) of all chunks sharing a token with a query (query_id, text).

    ``reference`` mixes units as the original does: documents for N and characters for the average length;
    ``standard`` uses chunks and tokens. A token repeated in the query counts each time.
    """
    # A frequent token's postings are dealt over salts by chunk, so its pairs are summed where they arise.
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    asked = _weights(queries, df, stats).withColumn("salt", salts)
    postings = postings.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)))
    part = F.col(f"idf_{mode}") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col(_AVERAGE[mode]))) * F.col("times")
    met = asked.join(postings, ["token", "salt"]).crossJoin(F.broadcast(stats.select(_AVERAGE[mode])))  # one row
    return met.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def _term_norm(mode: str, k1: float, b: float) -> Column:
    """What a chunk's length adds to the count of a token."""
    return k1 * (1 - b + b * F.col("dl") / F.col(_AVERAGE[mode]))


class Bm25Index:
    """Chunks (chunk_id, doc_id, text) as lists of token hashes, saved, with document frequencies and averages."""

    def __init__(self, chunks: DataFrame, k1: float = 1.5, b: float = 0.75):
        self.k1, self.b = k1, b
        listed = chunks.select("chunk_id", "doc_id", F.length("text").alias("n_chars"), hashed(tokens(F.col("text"))).alias("t"))
        self.listed = saved(listed.withColumn("dl", F.size("t")), "tokens")
        self.stats = saved(self.listed.agg(
            F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.avg("n_chars").alias("avg_chars"), F.avg("dl").alias("avg_tokens")
        ), "stats")

    def weights(self, queries: DataFrame) -> DataFrame:
        words = hashed(tokens(F.col("text")))
        asked = queries.select(F.explode(words).alias("token")).distinct()
        df = self.listed.select(F.explode(F.array_distinct("t")).alias("token")).join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
        return _weights(queries, df, self.stats, words)

    def topk(self, queries: DataFrame, k: int, modes: tuple[str, ...] = ("reference", "standard")) -> DataFrame:
        """(mode, query_id, chunk_id, score, rank). Blocks of queries meet shards of chunks; a shard scores only what its
        block maxima let into a query's k best, and no pair of a query and a chunk is shuffled but these."""
        weight = {m: F.col(f"idf_{m}") * F.col("times") * (self.k1 + 1) for m in modes}
        asked = self.weights(queries).groupBy("query_id").agg(F.collect_list(F.struct(F.col("token").alias("w"), *(c.alias(m) for m, c in weight.items()))).alias("x"))
        asked = asked.select("query_id", F.col("x.w").alias("t"), *(F.col(f"x.{m}") for m in modes))
        index = self.listed.crossJoin(F.broadcast(self.stats.drop("n_docs"))).select("chunk_id", "t", *(_term_norm(m, self.k1, self.b).alias(m) for m in modes))  # stats is one row
        kinds = {c: f.schema[c].dataType.simpleString() for c, f in (("query_id", queries), ("chunk_id", self.listed))}

        def score(q: pa.Table, x: pa.Table) -> pa.Table:
            found = _matches(q, x, k, {m: (np.asarray(x.column(m)), np.asarray(q.column(m).combine_chunks().flatten())) for m in modes})
            return pa.concat_tables([t.append_column("mode", pa.array([m] * len(t), pa.string())) for m, (t, _, _) in found.items()])

        found = meet(asked, index, "query_id", "chunk_id", score, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, mode string", QUERY_BLOCK, SHARD)
        order = Window.partitionBy("mode", "query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("mode", "query_id", "chunk_id", "score", "rank")

    def scores(self, queries: DataFrame, pairs: DataFrame, mode: str = "reference") -> DataFrame:
        """(query_id, chunk_id, score) of the given ``pairs`` that share a token."""
        wanted = self.listed.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
        counts = wanted.select("chunk_id", "dl", F.explode("t").alias("token")).groupBy("chunk_id", "dl", "token").agg(F.count("*").alias("tf"))
        met = pairs.select("query_id", "chunk_id").join(self.weights(queries), "query_id").join(counts, ["chunk_id", "token"]).crossJoin(F.broadcast(self.stats.select(_AVERAGE[mode])))  # one row
        part = F.col(f"idf_{mode}") * F.col("times") * F.col("tf") * (self.k1 + 1) / (F.col("tf") + _term_norm(mode, self.k1, self.b))
        return met.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def _matches(q: pa.Table, x: pa.Table, k: int, settings: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[pa.Table, int, int]]:
    """For each setting (norms of the chunks, weights of the query words): the k best chunks of each query, postings scored, of how many."""
    lists, asked = x.column("t").combine_chunks(), q.column("t").combine_chunks()
    shard = block_max.Shard(np.asarray(lists.flatten()), np.asarray(lists.value_lengths()))
    word, owner = np.asarray(asked.flatten()), np.repeat(np.arange(len(q)), np.asarray(asked.value_lengths()))
    out = {}
    for name, (norm, weight) in settings.items():
        row, text, score, scored, of = shard.top(norm, owner, word, weight, len(q), k)
        out[name] = pa.table({"query_id": q.column("query_id").take(pa.array(row)), "chunk_id": x.column("chunk_id").take(pa.array(text)), "score": score}), scored, of
    return out


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, modes: tuple[str, ...] = ("reference", "standard")) -> DataFrame:
    """(mode, query_id, chunk_id, score, rank): the k best chunks (chunk_id, doc_id, text) of each query by BM25, in each mode."""
    return Bm25Index(chunks, k1, b).topk(queries, k, modes)


def bm25_hybrid_topk(queries: DataFrame, chunks: DataFrame, dense: DataFrame, k: int, w_dense: float = 0.7, w_sparse: float = 0.3, mode: str = "reference") -> DataFrame:
    """The best 2k dense candidates fused with BM25 scores. A chunk that is no candidate can only be among the k best if it
    is among the 3k best by BM25 (k, and as many as there are candidates); candidates are scored pair by pair."""
    candidates = saved(dense.where(F.col("rank") <= 2 * k).select("query_id", "chunk_id", "score", "rank"), "candidates")
    index = Bm25Index(chunks)
    top = index.topk(queries, 3 * k, (mode,)).select("query_id", "chunk_id", "score")
    own = index.scores(queries, candidates, mode)
    return hybrid_topk(candidates, own.unionByName(top.join(candidates, ["query_id", "chunk_id"], "left_anti")), k, w_dense, w_sparse)


def fuse(first: DataFrame, second: DataFrame, k: int | None, w_first: float, w_second: float) -> DataFrame:
    """Weighted sum of two score frames; a chunk missing from one scores 0 there. Weights must sum to 1."""
    if abs(w_first + w_second - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    a, b = first.select("query_id", "chunk_id", F.col("score").alias("s1")), second.select("query_id", "chunk_id", F.col("score").alias("s2"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    return _ranked(both.select("query_id", "chunk_id", (w_first * F.coalesce("s1", F.lit(0.0)) + w_second * F.coalesce("s2", F.lit(0.0))).alias("score")), k)


def hybrid_topk(dense: DataFrame, sparse: DataFrame, k: int, w_dense: float = 0.7, w_sparse: float = 0.3) -> DataFrame:
    """Dense candidates (the best 2k) and lexical scores fused."""
    return fuse(dense.where(F.col("rank") <= 2 * k), sparse, k, w_dense, w_sparse)


def graph_hybrid_topk(dense: DataFrame, graph: DataFrame, k: int, default_k: int = 5, w_dense: float = 0.6, w_graph: float = 0.4) -> DataFrame:
    """Dense and graph candidates, the best 2k of each, fused; k is at least ``default_k``."""
    k = max(k, default_k)
    return fuse(dense.where(F.col("rank") <= 2 * k), graph.where(F.col("rank") <= 2 * k), k, w_dense, w_graph)


def overlap_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k documents (chunk_id, text) sharing most distinct words with each query; places left over go
    to the smallest ids with score 0."""
    def distinct_words(df: DataFrame, id_: str) -> DataFrame:
        split = F.array_remove(F.array_distinct(F.split(F.lower(strip(F.coalesce("text", F.lit("")))), r"\s+", -1)), "")
        return df.select(id_, hashed(split).alias("t"))

    def count(q: pa.Table, x: pa.Table) -> pa.Table:
        ones = np.ones(len(q.column("t").combine_chunks().flatten()))
        return _matches(q, x, k, {"": (np.zeros(len(x)), ones)})[""][0]

    kinds = {c: f.schema[c].dataType.simpleString() for c, f in (("query_id", queries), ("chunk_id", docs))}
    found = meet(distinct_words(queries, "query_id"), distinct_words(docs, "chunk_id"), "query_id", "chunk_id", count, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double", QUERY_BLOCK, SHARD)
    top = saved(_ranked(found, k).drop("rank"), "overlap")
    # Queries with places left: any k of the 2k smallest ids are enough to fill up.
    lacking = queries.select("query_id").join(top.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "query_id", "left_anti")
    filler = docs.select("chunk_id").orderBy("chunk_id").limit(2 * k)
    padded = lacking.crossJoin(F.broadcast(filler)).join(top.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return _ranked(top.unionByName(padded), k)


def pack_context(retrieved: DataFrame, max_chars: int = 3000) -> DataFrame:
    """(query_id, context, n_parts): numbered chunk texts in rank order, up to the first that would pass
    ``max_chars``."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = retrieved.withColumn("part", part).withColumn("total", F.sum(F.length("part")).over(run)).where(F.col("total") <= max_chars)
    return kept.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda p: p["part"]), "\n\n").alias("context"), F.count("*").alias("n_parts")
    )


def extractive_answer(queries: DataFrame, retrieved: DataFrame, prefix: str = "Based on the documents: ", default: str = "No relevant documents were found.") -> DataFrame:
    """(query_id, answer): the first 200 characters of each retrieved text, joined and cut at 500."""
    parts = retrieved.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("t")))).alias("p"))
    joined = F.concat(F.lit(prefix), F.substring(F.array_join(F.transform("p", lambda x: x["t"]), " "), 1, 500))
    return queries.select("query_id").join(parts, "query_id", "left").select("query_id", F.coalesce(joined, F.lit(default)).alias("answer"))


def answer_defaults(queries: DataFrame, answers: DataFrame, default: str = "No answer.") -> DataFrame:
    """Every query's answer, the default where none was made."""
    return queries.select("query_id").join(answers, "query_id", "left").select("query_id", F.coalesce(F.nullif("answer", F.lit("")), F.lit(default)).alias("answer"))
