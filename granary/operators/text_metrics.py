"""Text metrics of predictions (id, text) against references (id, ref, text; ref 0 is the first one).

Per-row metrics return (id, value); batch figures are plain aggregates over them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.scratch import saved

from . import best_partner
from .best_partner import FLOOR
from .ir_metrics import judge
from .retrieval import dot, hashed, meet, pair_cosine, tokens
from .text import words

#: Texts that meet at once in Self-BLEU.
BLEU_BLOCK = 2048
# Grammar patterns with penalties.
GRAMMAR = (
    (r"[.!?]{2,}", 0.3, "repeated_punctuation"),
    (r"\s[,.!?;:]", 0.2, "missing_space_before_punctuation"),
    (r"[a-zA-Z][A-Z]{2,}[a-zA-Z]", 0.1, "unlikely_caps"),
    (r"\([^)]*\z", 0.4, "unbalanced_paren"),
    (r'"[^"]*\z', 0.4, "unbalanced_quote"),
    (r"\s{2,}", 0.1, "multiple_spaces"),
    (r"[\x{4e00}-\x{9fff}]", 0.0, "chinese_chars"),
)


def normal_words(c: Column) -> Column:
    """Lower-case white-space words without ASCII punctuation."""
    return words(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[!-/:-@\[-`{-~]", ""))


def metric_tokens(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode(normal_words(F.col("text"))).alias("pos", "token"))


def _grams(list_: str, n: int) -> Column:
    """n-grams of a word list: the list zipped with itself, moved by one word each time."""
    many = F.greatest(F.size(list_) - (n - 1), F.lit(0))
    made = F.slice(list_, F.lit(1), many)
    for i in range(1, n):
        made = F.zip_with(made, F.slice(list_, F.lit(i + 1), many), lambda a, b: F.concat_ws(" ", a, b))
    return made


def ngrams(df: DataFrame, n: int) -> DataFrame:
    """(id, gram, cnt)."""
    return df.select("id", normal_words(F.col("text")).alias("w")).select("id", F.explode(_grams("w", n)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("cnt"))


def _counted(df: DataFrame, keys: list[str], order: int, split: Callable[[Column], Column]) -> DataFrame:
    listed = df.select(*keys, split(F.col("text")).alias("w"))
    every = F.flatten(F.array(*(_tagged(n) for n in range(1, order + 1))))
    return listed.select(*keys, F.explode(every).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(F.count("*").alias("cnt"))


def _tagged(n: int) -> Column:
    return F.transform(_grams("w", n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))


#: Words of the pairs whose n-grams are counted at once.
COUNTED = 1 << 20


def _shared_some(pred: pa.Array, ref: pa.Array, order: int) -> np.ndarray:
    n = len(pred)
    owner = np.repeat(np.arange(2 * n), np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in (pred, ref)]))
    word = np.unique(np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in (pred, ref)]), return_inverse=True)[1]
    wide, at = int(word.max(initial=0)) + 1, np.arange(len(word))
    gram, out = owner % max(n, 1), np.zeros((n, order), np.int64)
    for i in range(order):
        # A gram is its row, or the gram of one word less, and the word after it.
        at = at[: np.searchsorted(at, len(word) - i)]
        at = at[owner[at] == owner[at + i]]
        _, first, kind = np.unique(gram[at] * wide + word[at + i], return_index=True, return_inverse=True)
        ours = owner[at] < n
        least = np.minimum(np.bincount(kind[ours], minlength=len(first)), np.bincount(kind[~ours], minlength=len(first)))
        out[:, i] = np.bincount(owner[at[first]] % max(n, 1), least, n)
        gram[at] = kind
    return out


def shared_grams(pred: pa.Array, ref: pa.Array, order: int) -> pa.Array:
    """For each row of two lists of word hashes, how many n-grams they share, clipped by the counts of the second, for n up to ``order``."""
    size = sum(x.value_lengths().to_numpy(zero_copy_only=False) for x in (pred, ref))
    part = np.cumsum(size) // COUNTED
    cut = [*np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(pred)].tolist(), len(pred)]
    found = [_shared_some(pred.slice(lo, hi - lo), ref.slice(lo, hi - lo), order) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    flat = np.concatenate(found).ravel() if found else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(pred) + 1, dtype=np.int32) * order), pa.array(flat))


def _shared(p: str, r: str, order: int) -> Column:
    return F.arrow_udf(lambda a, b: shared_grams(a, b, order), "array<long>")(p, r)


def text_pairs(preds: DataFrame, refs: DataFrame, how: str = "inner") -> DataFrame:
    """(id, ref, p, r, pw, rw, pn, rn): predictions with each of their references, as texts, hashes of their words and hashes of
    their normal words. Texts are what is joined; words and what is counted of them arise behind the join, pair by pair."""
    text = F.coalesce("text", F.lit(""))
    both = preds.select("id", text.alias("p")).join(refs.select("id", "ref", text.alias("r")), "id", how).withColumn("r", F.coalesce("r", F.lit("")))
    return both.select("id", "ref", "p", "r", *(hashed(f(F.col(c))).alias(c + k) for k, f in (("w", words), ("n", normal_words)) for c in "pr"))


def _bleu(n: int = 4) -> Column:
    """Brevity penalty times geometric mean precision of a pair, each precision at least the floor."""
    m, pl, rl = _shared("pw", "rw", n), F.size("pw"), F.size("rw")
    brevity = F.when(pl > rl, 1.0).when((pl == 0) | (rl == 0), 0.0).otherwise(F.exp(1 - rl / pl))
    logs = F.aggregate(F.zip_with(m, F.sequence(F.lit(0), F.lit(n - 1)), lambda x, i: F.ln(F.greatest(F.lit(FLOOR), x / F.greatest(pl - i, F.lit(1))))), F.lit(0.0), lambda a, x: a + x)
    return brevity * F.exp(logs / n)


def bleu_sentence(preds: DataFrame, refs: DataFrame, n: int = 4) -> DataFrame:
    """(id, value): the best over references of brevity penalty times geometric mean precision."""
    return text_pairs(preds, refs).select("id", _bleu(n).alias("v")).groupBy("id").agg(F.max("v").alias("value"))


def bleu_corpus(preds: DataFrame, refs: DataFrame, n: int = 4) -> DataFrame:
    """One row: pooled BLEU, counts clipped by the best reference, closest reference length, and zero
    precisions halved again and again as in exponential smoothing."""
    p = _counted(preds, ["id"], n, words)
    r = _counted(refs, ["id", "ref"], n, words).groupBy("id", "n", "gram").agg(F.max("cnt").alias("rcnt"))
    pooled = p.join(r, ["id", "n", "gram"], "left").groupBy("n").agg(F.sum(F.least("cnt", F.coalesce("rcnt", F.lit(0)))).alias("m"), F.sum("cnt").alias("t"))
    length = F.size(words(F.coalesce("text", F.lit(""))))
    lens = preds.select("id", length.alias("pl")).join(refs.select("id", length.alias("rl")), "id").groupBy("id", "pl").agg(F.min(F.struct(F.abs(F.col("pl") - F.col("rl")), F.col("rl").alias("rl"))).alias("c"))
    total = lens.agg(F.sum("pl").alias("pl"), F.sum("c.rl").alias("rl"))
    listed = F.array_sort(F.collect_list(F.struct("n", "m", "t")))
    fold = F.aggregate(
        "l", F.expr("struct(0D as logs, 1D as half)"),
        lambda a, x: F.when(x["m"] > 0, F.struct((a["logs"] + F.ln(x["m"] / x["t"])).alias("logs"), a["half"].alias("half"))).otherwise(
            F.struct((a["logs"] + F.ln(1 / (a["half"] * 2) / x["t"])).alias("logs"), (a["half"] * 2).alias("half"))),
        lambda a: a["logs"],
    )
    brevity = F.when(F.col("pl") >= F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.col("pl")))
    return pooled.agg(listed.alias("l")).crossJoin(total).select(F.when(F.size("l") == n, brevity * F.exp(fold / n)).otherwise(0.0).alias("bleu"))


def _rouge_n(n: int) -> Column:
    p, r = (F.greatest(F.size(c) - (n - 1), F.lit(0)) for c in ("pn", "rn"))
    return F.when(p + r > 0, 2 * F.get(_shared("pn", "rn", n), F.lit(n - 1)) / (p + r)).otherwise(0.0)


def rouge_n(preds: DataFrame, refs: DataFrame, n: int) -> DataFrame:
    """(id, value): F1 of n-gram overlap with the first reference."""
    return text_pairs(preds, refs.where("ref = 0")).select("id", _rouge_n(n).alias("value"))


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit per word of ``a``."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _rouge_l() -> Column:
    def lengths(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([_lcs(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.int64())

    sizes = F.size("pn") + F.size("rn")
    return F.when(sizes > 0, 2 * F.arrow_udf(lengths, "long")("pn", "rn") / sizes).otherwise(0.0)


def rouge_l(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, value): F1 of the longest common subsequence with the first reference."""
    return text_pairs(preds, refs.where("ref = 0")).select("id", _rouge_l().alias("value"))


def _aligned(pred: pa.Array, ref: pa.Array) -> pa.Array:
    """(matches, starts) of rows of two lists of word hashes: matches clipped by the counts of the second, and how many runs
    the words form that the second has at all. Words of all rows are sorted once, so the work is linear but for that."""
    sizes = [x.value_lengths().to_numpy(zero_copy_only=False) for x in (pred, ref)]
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    word = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in (pred, ref)])
    n = int(sizes[0].sum())
    order = np.lexsort((word, row))
    new = np.append(True, (row[order][1:] != row[order][:-1]) | (word[order][1:] != word[order][:-1]))[: len(order)]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    total = int(new.sum())
    ours, theirs = np.bincount(kind[:n], minlength=total), np.bincount(kind[n:], minlength=total)
    matches = np.bincount(row[order][new], np.minimum(ours, theirs), len(pred)).astype(np.int64)
    hit = theirs[kind[:n]] > 0
    after = np.append(False, hit[:-1] & (row[1:n] == row[: n - 1])) if n else hit
    starts = np.bincount(row[:n], hit & ~after, len(pred)).astype(np.int64)
    return pa.StructArray.from_arrays([pa.array(matches), pa.array(starts)], ["matches", "starts"])


def _synonym_matches(preds: DataFrame, first: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, more): words left over on both sides that are of one class of ``synonyms`` (word, class), clipped by their counts."""
    p, r = (_counted(x, ["id"], 1, normal_words).select("id", F.col("gram").alias("word"), "cnt") for x in (preds, first))
    classes = synonyms.select("word", "class").distinct()

    def left(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        met = own.join(other.withColumnRenamed("cnt", "used"), ["id", "word"], "left")
        over = met.withColumn("over", F.col("cnt") - F.least("cnt", F.coalesce("used", F.lit(0)))).where("over > 0")
        return over.join(classes, "word").groupBy("id", "class").agg(F.sum("over").alias(name))

    both = left(p, r, "ours").join(left(r, p, "theirs"), ["id", "class"])
    return both.groupBy("id").agg(F.sum(F.least("ours", "theirs")).alias("more"))


def _meteor(alpha: float, beta: float, gamma: float, more: Column | None = None) -> Column:
    """Weighted F of a pair's clipped matches, and ``more`` of them, less fragmentation."""
    aligned, pl, rl = F.arrow_udf(_aligned, "struct<matches:long,starts:long>")("pn", "rn"), F.size("pn"), F.size("rn")
    m = aligned["matches"] if more is None else aligned["matches"] + more
    precision, recall = m / pl, m / rl
    f = precision * recall / (alpha * precision + (1 - alpha) * recall)
    return F.when((pl > 0) & (rl > 0) & (m > 0), f * (1 - gamma * F.pow(aligned["starts"] / m, F.lit(beta)))).otherwise(0.0)


def meteor(preds: DataFrame, refs: DataFrame, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, synonyms: DataFrame | None = None) -> DataFrame:
    """(id, value): weighted F of clipped exact matches with the first reference, less fragmentation. With ``synonyms``
    (word, class; a word is in one class) words left over on both sides match by class."""
    first = refs.where("ref = 0")
    both, more = text_pairs(preds, first), None
    if synonyms is not None:
        both, more = both.join(_synonym_matches(preds, first, synonyms), "id", "left"), F.coalesce("more", F.lit(0))
    return both.select("id", _meteor(alpha, beta, gamma, more).alias("value"))


def bertscore(pred_vecs: DataFrame, ref_vecs: DataFrame) -> DataFrame:
    """(id, precision, recall, f1) from unit token vectors (id, pos, embedding): greedy best matches."""
    met = pred_vecs.select("id", F.col("pos").alias("p"), F.col("embedding").alias("a")).join(ref_vecs.select("id", F.col("pos").alias("r"), F.col("embedding").alias("b")), "id")
    met = met.select("id", "p", "r", dot(F.col("a"), F.col("b")).alias("s"))
    precision = met.groupBy("id", "p").agg(F.max("s").alias("s")).groupBy("id").agg(F.avg("s").alias("precision"))
    recall = met.groupBy("id", "r").agg(F.max("s").alias("s")).groupBy("id").agg(F.avg("s").alias("recall"))
    total = F.col("precision") + F.col("recall")
    return precision.join(recall, "id").withColumn("f1", F.when(total != 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def self_bleu(texts: DataFrame, n: int = 4, by: str = "group", block: int = BLEU_BLOCK) -> DataFrame:
    """(group, value, std, diversity, n_texts): for each text the best geometric mean precision against another text of its
    group; one that shares no word with any has the floor. One text scores 0.

    Blocks of texts meet blocks of their group's texts; groups smaller than a block are met together, the group
    being part of every word's hash. A meeting returns one value for each text, and no pair leaves it.
    """
    sizes = texts.groupBy(F.col(by).alias("g0")).agg(F.count("*").alias("n_texts"))
    pools = sizes.agg(F.greatest(F.ceil(F.sum("n_texts") / block), F.lit(1)).alias("pools"))
    small = F.concat(F.lit("small "), F.pmod(F.xxhash64("g0"), "pools").cast("string"))
    pool = sizes.crossJoin(F.broadcast(pools)).select("g0", F.when(F.col("n_texts") > block, F.concat(F.lit("group "), F.col("g0").cast("string"))).otherwise(small).alias("pool"))  # pools is one row
    listed = texts.select(F.col(by).alias("g1"), "id", normal_words(F.col("text")).alias("w")).join(pool, F.expr("g0 <=> g1"))
    listed = listed.select("pool", F.xxhash64("g0", F.col("g0").isNull(), "id").alias("own"), "g0", "id", F.transform("w", lambda w: F.xxhash64("g0", w)).alias("t"))
    listed = saved(listed, "words")
    kinds = {c: listed.schema[c].dataType.simpleString() for c in ("g0", "id")}

    def score(q: pa.Table, x: pa.Table) -> pa.Table:
        sides = [best_partner.Grams(np.asarray(t.column("t").combine_chunks().flatten()), np.asarray(t.column("t").combine_chunks().value_lengths()).astype(np.int64), n) for t in (q, x)]
        value, _ = best_partner.best(sides[0], q.column("own").to_numpy(), sides[1], x.column("own").to_numpy(), n)
        return pa.table({"g0": q.column("g0"), "id": q.column("id"), "b": value})

    met = meet(listed, listed.select("pool", "own", "t"), "own", "own", score, f"g0 {kinds['g0']}, id {kinds['id']}, b double", block, block, pool="pool")
    per = met.groupBy("g0", "id").agg(F.greatest(F.max("b"), F.lit(FLOOR)).alias("b"))
    out = per.groupBy("g0").agg(F.count("*").alias("n_texts"), F.avg("b").alias("value"), F.stddev_pop("b").alias("std"))
    alone = F.col("n_texts") < 2
    return out.select(F.col("g0").alias(by), F.when(alone, 0.0).otherwise(F.col("value")).alias("value"), F.when(alone, 0.0).otherwise(F.col("std")).alias("std"), F.when(alone, 0.0).otherwise(1 - F.col("value")).alias("diversity"), "n_texts")


def distinct_n(texts: DataFrame, n: int = 2, by: str = "group") -> DataFrame:
    """(group, unique, total, value): different n-grams over the texts' own distinct n-grams."""
    grams = texts.select(by, normal_words(F.col("text")).alias("w")).select(by, F.explode(F.array_distinct(_grams("w", n))).alias("gram"))
    per = grams.groupBy(by, "gram").agg(F.count("*").alias("c")).groupBy(by).agg(F.count("*").alias("unique"), F.sum("c").alias("total"))
    return per.withColumn("value", F.col("unique") / F.col("total"))


def grammar_score(text: Column) -> Column:
    penalty = sum((F.when(text.rlike(p), F.lit(w)).otherwise(0.0) for p, w, _ in GRAMMAR), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - penalty)


def grammar(texts: DataFrame) -> DataFrame:
    """(id, value, issues)."""
    t = F.coalesce("text", F.lit(""))
    issues = F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(name)) for p, _, name in GRAMMAR)))
    return texts.select("id", grammar_score(t).alias("value"), issues.alias("issues"))


def _bare(c: str) -> Column:
    return F.trim(F.lower(F.col(c)))


def _exact() -> Column:
    return (_bare("p") == _bare("r")).cast("double")


def _contains() -> Column:
    return (F.contains(_bare("p"), _bare("r")) | F.contains(_bare("r"), _bare("p"))).cast("double")


def exact_match(preds: DataFrame, refs: DataFrame) -> DataFrame:
    return text_pairs(preds, refs.where("ref = 0")).select("id", _exact().alias("value"))


def contains_answer(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """1 if either text contains the other; an empty one is contained in any."""
    return text_pairs(preds, refs.where("ref = 0")).select("id", _contains().alias("value"))


def semantic_similarity(pred_vecs: DataFrame, ref_vecs: DataFrame) -> DataFrame:
    both = pred_vecs.select("id", F.col("embedding").alias("a")).join(ref_vecs.select("id", F.col("embedding").alias("b")), "id")
    return both.select("id", dot(F.col("a"), F.col("b")).alias("value"))


def context_relevance(query_vecs: DataFrame, retrieved: DataFrame, chunk_vecs: DataFrame) -> DataFrame:
    """(query_id, value): mean similarity of a query to its retrieved chunks; 0 if none."""
    met = retrieved.join(query_vecs.select("query_id", F.col("embedding").alias("a")), "query_id").join(chunk_vecs.select("chunk_id", F.col("embedding").alias("b")), "chunk_id")
    per = met.groupBy("query_id").agg(F.avg(dot(F.col("a"), F.col("b"))).alias("v"))
    return query_vecs.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("v", F.lit(0.0)).alias("value"))


def faithfulness_vec(answer_vecs: DataFrame, context_vecs: DataFrame) -> DataFrame:
    """Similarity of an answer's vector to its context's, clamped."""
    return pair_cosine(answer_vecs, context_vecs, "id")


def faithfulness(answers: DataFrame, retrieved: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, value): share of an answer's distinct tokens found in its retrieved documents."""
    said = answers.select("query_id", F.explode(F.array_distinct(tokens(F.col("answer")))).alias("t"))
    known = retrieved.join(docs, "chunk_id").select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t")).distinct().withColumn("k", F.lit(1.0))
    per = said.join(known, ["query_id", "t"], "left").groupBy("query_id").agg(F.avg(F.coalesce("k", F.lit(0.0))).alias("v"))
    return answers.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("v", F.lit(0.0)).alias("value"))


def context_precision(retrieved: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, value): relevant share of what was retrieved."""
    return judge(retrieved, qrels).groupBy("query_id").agg(F.avg(F.col("hit").cast("double")).alias("value"))


def answer_overlap(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, bleu, rouge_l, n_words): overlap only where an expected answer exists, else 0."""
    some = refs.where("ref = 0 AND text IS NOT NULL AND trim(text) <> ''")
    scores = (F.when(F.col("ref").isNotNull(), c).otherwise(0.0).alias(name) for name, c in (("bleu", _bleu()), ("rouge_l", _rouge_l())))
    return text_pairs(preds, some, "left").select("id", *scores, F.size("pw").alias("n_words"))


METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "bleu": bleu_sentence, "rouge1": lambda p, r: rouge_n(p, r, 1), "rouge2": lambda p, r: rouge_n(p, r, 2), "rougeL": rouge_l, "meteor": meteor,
    "exact_match": exact_match, "contains": contains_answer, "grammar": lambda p, r: grammar(p).select("id", "value"),
}


#: Metrics of a pair of texts by the first reference.
_OF_PAIRS: dict[str, Callable[[], Column]] = {
    "rouge1": lambda: _rouge_n(1), "rouge2": lambda: _rouge_n(2), "rougeL": _rouge_l, "meteor": lambda: _meteor(0.9, 3.0, 0.5), "exact_match": _exact, "contains": _contains,
}


def compute_metrics(preds: DataFrame, refs: DataFrame, names: list[str]) -> DataFrame:
    """(id, metric_name, score) of registered metrics; an unknown name raises. Those of pairs of texts are taken from one
    join of them."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {unknown}")
    paired = [n for n in names if n == "bleu" or n in _OF_PAIRS]
    parts = [METRICS[n](preds, refs).select("id", F.lit(n).alias("metric_name"), F.col("value").alias("score")) for n in names if n not in paired]
    if paired:
        pairs = text_pairs(preds, refs if "bleu" in paired else refs.where("ref = 0"))
        pairs = pairs.withColumns({c: F.when(F.col("ref") == 0, F.col(c)).otherwise(F.array().cast("array<long>")) for c in ("pn", "rn")})
        scored = pairs.select("id", *((_bleu() if n == "bleu" else F.when(F.col("ref") == 0, _OF_PAIRS[n]())).alias(n) for n in dict.fromkeys(paired)))
        per = scored.groupBy("id").agg(*(F.max(n).alias(n) for n in dict.fromkeys(paired)))
        # An id without a first reference has no value of the metrics that need it.
        listed = F.explode(F.array(*(F.struct(F.lit(n).alias("metric_name"), F.col(n).alias("score")) for n in paired)))
        parts.append(per.select("id", listed.alias("x")).select("id", "x.metric_name", "x.score").where("score IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def compute_isolated(preds: DataFrame, refs: DataFrame, names: list[str]) -> DataFrame:
    """(id, metric_name, score, error): as compute_metrics, each metric run and saved on its own. One that fails, or is
    unknown, has a single row without id, of score 0 and its error, and the others go on."""
    out = None
    for n in names:
        try:
            part = saved(compute_metrics(preds, refs, [n]).withColumn("error", F.lit(None).cast("string")), "metric")
        except Exception as e:  # noqa: BLE001 a failure of any kind is this metric's result
            kind = preds.schema["id"].dataType.simpleString()
            part = preds.sparkSession.createDataFrame([(None, n, 0.0, f"{type(e).__name__}: {e}"[:500])], f"id {kind}, metric_name string, score double, error string")
        out = part if out is None else out.unionByName(part)
    return out


def batch_figures(scores: DataFrame) -> DataFrame:
    """(metric_name, n, mean, std) of (metric_name, score): mean and population deviation over the batch."""
    return scores.groupBy("metric_name").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def issue_counts(issues: DataFrame) -> DataFrame:
    """(issue, n) of ``grammar``'s (id, value, issues)."""
    return issues.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def score_violations(scores: DataFrame) -> DataFrame:
    """Scores outside [0, 1]."""
    return scores.where("score < 0 OR score > 1 OR isnan(score)")
