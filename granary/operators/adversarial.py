"""Adversarial variants, multi-hop benchmarks and multi-round retrieval.

questions: question_id, question, answer; variants: question_id, strategy, variant, adversarial_question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traversal import shortest_paths
from .text import words

# Name swaps, relation and superlative alternatives.
SWAPS = (("einstein", "newton"), ("newton", "einstein"), ("tesla", "edison"), ("edison", "tesla"), ("shakespeare", "dickens"), ("dickens", "shakespeare"))
RELATIONS = ("die", "study", "work", "live")
SUPERLATIVES = ("second tallest", "third tallest", "shortest", "smallest")


def _variants(rows: DataFrame, strategy: str, made) -> DataFrame:
    kept = F.filter(made, lambda x: x.isNotNull())
    return rows.select("question_id", F.lit(strategy).alias("strategy"), F.posexplode(kept).alias("variant", "adversarial_question"))


def adv_distractor(questions: DataFrame) -> DataFrame:
    """One variant for each listed name in the question, swapped for its rival."""
    low = F.lower("question")
    return _variants(questions, "distractor", F.array(*(F.when(low.contains(a), F.replace(low, F.lit(a), F.lit(b))) for a, b in SWAPS)))


def adv_negation(questions: DataFrame) -> DataFrame:
    """NOT as second word of questions that start with what, which or who."""
    w = words(F.col("question"))
    asks = F.lower("question").rlike("^(what|which|who)") & (F.size(w) > 1)
    return _variants(questions, "negation", F.array(F.when(asks, F.array_join(F.concat(F.slice(w, 1, 1), F.array(F.lit("NOT")), F.slice(w, 2, F.size(w))), " "))))


def adv_relation(questions: DataFrame) -> DataFrame:
    """``born`` replaced by other relations."""
    low = F.lower("question")
    return _variants(questions, "multihop_variation", F.array(*(F.when(low.contains("born"), F.replace(low, F.lit("born"), F.lit(r))) for r in RELATIONS)))


def adv_edge(questions: DataFrame) -> DataFrame:
    """Superlatives replaced one after the other on the changed text, and ``when`` made a bound."""
    low, out = F.lower("question"), []
    for s in SUPERLATIVES:
        text = low
        for old in ("tallest", "highest", "largest"):
            text = F.replace(text, F.lit(old), F.lit(s))
        out.append(F.when(low.rlike("tallest|highest|largest"), text))
    out.append(F.when(low.contains("when"), F.replace(low, F.lit("when"), F.lit("before what year"))))
    return _variants(questions, "edge_case", F.array(*out))


STRATEGIES = {"distractor": adv_distractor, "negation": adv_negation, "multihop_variation": adv_relation, "edge_case": adv_edge}


def adversarial_variants(questions: DataFrame, strategies: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    out = None
    for name in STRATEGIES:
        if name in strategies:
            part = STRATEGIES[name](questions)
            out = part if out is None else out.unionByName(part)
    return out


def robustness(adversarial: DataFrame, answers: DataFrame) -> DataFrame:
    """(strategy or overall, n, success_rate, attack_rate) of answers (question_id, strategy, variant,
    answer, expected): an answer succeeds if it contains the expected one; an empty answer fails."""
    ok = (F.coalesce("answer", F.lit("")) != "") & F.contains(F.lower("answer"), F.lower("expected"))
    marked = adversarial.join(answers, ["question_id", "strategy", "variant"], "left").withColumn("ok", F.coalesce(ok, F.lit(False)).cast("double"))
    rolled = marked.rollup("strategy").agg(F.count("*").alias("n"), F.avg("ok").alias("s"))
    return rolled.select(F.coalesce("strategy", F.lit("overall")).alias("strategy"), "n", F.bround("s", 4).alias("success_rate"), F.bround(1 - F.col("s"), 4).alias("attack_rate"))


def multihop_questions(edges: DataFrame, pairs: DataFrame, n: int, hops: int = 2, seed: int = 42) -> DataFrame:
    """n questions over reachable pairs at least two edges apart: question_id, question, answer, hops, chain."""
    best = shortest_paths(edges, pairs, hops).where("size(path) >= 3")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "start", "end"))
    chosen = best.orderBy(order, "start", "end").limit(n)
    return chosen.select(
        F.concat(F.lit("mh_"), F.substring(order, 1, 12)).alias("question_id"), F.concat(F.lit("Starting from "), "start", F.lit(", what is reached by "), (F.size("path") - 1).cast("string"), F.lit(" steps?")).alias("question"),
        F.col("end").alias("answer"), (F.size("path") - 1).alias("hops"), F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.concat_ws(" -> ", F.element_at("path", i), F.element_at("path", i + 1))).alias("chain"),
    )


def multihop_score(questions: DataFrame, answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question_id, answer_correct, chain_recall, fact_recall, latency_ms): facts found in any retrieved text.

    questions: question_id, answer, chain, facts (arrays); answers: question_id, generated, latency_ms;
    retrieved: question_id, text.
    """
    def recall(column: str, name: str) -> DataFrame:
        facts = questions.select("question_id", F.posexplode(column).alias("pos", "fact"))
        met = facts.join(retrieved.select("question_id", "text"), "question_id", "left").groupBy("question_id", "pos").agg(F.max(F.coalesce(F.contains(F.lower("text"), F.lower("fact")), F.lit(False))).alias("hit"))
        return met.groupBy("question_id").agg(F.avg(F.col("hit").cast("double")).alias(name))

    out = questions.join(answers, "question_id").join(recall("chain", "chain_recall"), "question_id", "left").join(recall("facts", "fact_recall"), "question_id", "left")
    return out.select(
        "question_id", F.contains(F.lower(F.coalesce("generated", F.lit(""))), F.lower("answer")).alias("answer_correct"),
        F.coalesce("chain_recall", F.lit(0.0)).alias("chain_recall"), F.coalesce("fact_recall", F.lit(0.0)).alias("fact_recall"), "latency_ms",
    )


def multihop_summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, accuracy, mean recalls and latency, over a cube of ``by`` if given."""
    grouped = scores.cube(*by) if by else scores.groupBy()
    return grouped.agg(
        F.count("*").alias("total"), F.avg(F.col("answer_correct").cast("double")).alias("accuracy"), F.bround(F.avg("chain_recall"), 4).alias("chain_recall"),
        F.bround(F.avg("fact_recall"), 4).alias("fact_recall"), F.bround(F.avg("latency_ms"), 2).alias("latency_ms"),
    )


def multi_round(queries: DataFrame, search, max_rounds: int = 5, per_round: int = 3, wanted: int = 3, sure: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(final state by query, collected chunks): retrieval in rounds with a rule planner.

    ``search(queries, round)`` returns ranked (query_id, chunk_id, rank). A query retrieves while it has
    fewer than ``wanted`` chunks and rounds are left before the draft; then it drafts an answer
    (confidence .6, .1 without chunks), and reflection raises it to .85, then the answer adds .1. Rounds
    are unrolled; queries that reached ``sure`` are done.
    """
    got = None
    state = queries.select("query_id", F.lit(0).alias("n"), F.lit(0.0).alias("confidence"), F.lit(0).alias("rounds"))
    for r in range(1, max_rounds + 1):
        active = state.where(F.col("confidence") < sure)
        hungry = active.where((F.col("n") < wanted) & F.lit(r <= 3))
        found = search(queries.join(hungry.select("query_id"), "query_id", "left_semi"), r).where(F.col("rank") <= per_round).select("query_id", "chunk_id") if r <= 3 else None
        if found is not None:
            new = found.distinct() if got is None else found.distinct().join(got.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
            new = new.withColumn("round", F.lit(r))
            got = new if got is None else got.unionByName(new)
            counts = got.groupBy("query_id").agg(F.count("*").cast("int").alias("m"))
            state = state.drop("n").join(counts, "query_id", "left").withColumn("n", F.coalesce("m", F.lit(0))).drop("m")
        # a query with enough chunks, or out of retrieval rounds, drafts, reflects and answers in turn
        drafted = F.when(F.col("confidence") == 0, F.when(F.col("n") > 0, 0.6).otherwise(0.1)).when(F.col("confidence") == 0.6, 0.85).otherwise(F.least(F.lit(1.0), F.col("confidence") + 0.1))
        moves = (F.col("confidence") < sure) & ((F.col("n") >= wanted) & F.lit(r > 1) | F.lit(r > 3))
        state = state.select("query_id", "n", F.when(moves, drafted).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("confidence") < sure, r).otherwise(F.col("rounds")).alias("rounds"))
    return state, got
