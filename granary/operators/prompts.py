"""Few-shot selection, prompt datasets and completion clean-up.

examples: ex_id, knowledge, question, question_type, strategy; knowledge rows: source_id, content,
question_type, strategy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import saved

from .retrieval import INDEX_BLOCK, QUERY_BLOCK, meet, shared_words
from .text import strip, words

# Reasoning instructions of self-consistency prompts, in order.
VARIATIONS = (
    "Let's think step by step. Start by listing the entities, then identify relations, and finally compose the question.",
    "Approach this from the perspective of a student trying to understand the material. Break down the reasoning.",
    "First, summarize the knowledge in your own words. Then, identify what makes a good question from this summary.",
    "Consider multiple angles: factual recall, relational inference, and structural understanding. Pick the strongest angle.",
    "Analyze the subject-predicate-object structure. Then reframe one component as a question.",
)
MARKERS = {
    "chain_of_thought": ("最终问题：", "最终问题:", "Final question:", "问题：", "问题:"),
    "self_consistency": ("最终选择", "最终选择:", "Final answer:", "最终答案:", "最佳问题:"),
}
DEFAULT_EXAMPLES = (
    ("factual", "(Paris, capital, France)", "Which city is the capital of France?"),
    ("factual", "(Albert Einstein, born, 14 March 1879)", "In which year was Einstein born?"),
    ("schema", "Class: Person | Relations: worksAt (Company)", "What is the range of worksAt of class Person?"),
    ("schema", "Class: Organization | SubClassOf: Agent", "Which class does Organization inherit from?"),
)


def filter_examples(examples: DataFrame, question_type: str | None = None, strategy: str | None = None, limit: int | None = None) -> DataFrame:
    for column, value in (("question_type", question_type), ("strategy", strategy)):
        if value is not None:
            examples = examples.where(F.col(column) == value)
    return examples if limit is None else examples.orderBy("ex_id").limit(limit)


def candidates(knowledge: DataFrame, examples: DataFrame) -> DataFrame:
    """(source_id, ex_id, content, knowledge): examples of the row's type and strategy, else of its type.

    The bank is divided into exact and typed candidates first, so rows meet only the part they use.
    """
    ex = examples.select("ex_id", F.col("knowledge").alias("ex_knowledge"), "question_type", "strategy")
    kinds = examples.select("question_type", "strategy").distinct().withColumn("exact", F.lit(True))
    asked = knowledge.select("source_id", "content", "question_type", "strategy").join(kinds, ["question_type", "strategy"], "left")
    exact = asked.where("exact").join(ex, ["question_type", "strategy"])
    typed = asked.where("exact IS NULL").drop("strategy").join(ex.drop("strategy"), "question_type")
    return exact.select("source_id", "ex_id", "content", "ex_knowledge").unionByName(typed.select("source_id", "ex_id", "content", "ex_knowledge"))


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pools(knowledge: DataFrame, examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Knowledge rows and examples with ``pool``: rows of a type and strategy that examples have share a pool
    with those, other rows one with all examples of their type. Rows of an unknown type have no pool."""
    exact, typed = F.to_json(F.struct("question_type", "strategy")), F.to_json(F.struct("question_type"))
    kinds = examples.select(exact.alias("pool")).distinct().withColumn("known", F.lit(True))
    rows = knowledge.withColumn("pool", exact).join(kinds, "pool", "left").withColumn("pool", F.when(F.col("known"), F.col("pool")).otherwise(typed)).drop("known")
    bank = examples.withColumn("pool", F.explode(F.array_distinct(F.array(exact, typed))))
    return rows.where("question_type IS NOT NULL"), bank.where("question_type IS NOT NULL")


def select_random(knowledge: DataFrame, examples: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(source_id, ex_id, rank): k different examples of each row's pool, the next ones in an order by seeded
    md5 from a place that the row's seeded md5 names; a row meets no more than these."""
    rows, bank = _pools(knowledge.select("source_id", "question_type", "strategy"), examples.select("ex_id", "question_type", "strategy"))

    def number(id_: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"))), 1, 13), 16, 10).cast("long")

    order = Window.partitionBy("pool").orderBy(number("ex_id"), "ex_id")
    placed = bank.select("pool", "ex_id", (F.row_number().over(order) - 1).cast("long").alias("place"))
    sizes = bank.groupBy("pool").agg(F.count("*").alias("m"))
    draws = rows.join(sizes, "pool").withColumn("rank", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("m")).cast("int"))))
    draws = draws.select("source_id", "pool", "rank", F.pmod(number("source_id") + F.col("rank") - 1, F.col("m")).alias("place"))
    return draws.join(placed, ["pool", "place"]).select("source_id", "ex_id", "rank")


def _bag(c: Column) -> Column:
    """Distinct lower-case words, as 64-bit hashes."""
    return F.array_distinct(F.transform(words(F.lower(F.coalesce(c, F.lit("")))), lambda w: F.xxhash64(w)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def select_similar(knowledge: DataFrame, examples: DataFrame, k: int) -> DataFrame:
    """(source_id, ex_id, sim, rank): the k examples of each row's pool whose words are most similar to the
    content's. Blocks of rows meet blocks of their pool's examples; only the k best of a block are shuffled."""
    rows, bank = _pools(knowledge.select("source_id", "content", "question_type", "strategy"), examples.select("ex_id", "knowledge", "question_type", "strategy"))
    rows, bank = rows.select("pool", "source_id", _bag(F.col("content")).alias("t")), bank.select("pool", "ex_id", _bag(F.col("knowledge")).alias("t"))

    def compare(q: pa.Table, x: pa.Table) -> pa.Table:
        x = x.sort_by("ex_id").combine_chunks()
        ids, ex, out = q.column("source_id"), x.column("ex_id"), []
        n_q, n_x = (np.asarray(t.column("t").combine_chunks().value_lengths(), np.float64) for t in (q, x))
        for lo, cell, _, _, _, shape in shared_words(q, x):
            n = np.bincount(cell, minlength=shape.prod()).reshape(shape)
            sim = n / np.maximum(n_q[:, None] + n_x[None, lo : lo + shape[1]] - n, 1)
            col = np.argsort(-np.round(sim, 9), axis=1, kind="stable")[:, :k]  # of equal ones the smallest ids
            row = np.repeat(np.arange(len(col)), col.shape[1])
            out.append(pa.table({"source_id": ids.take(pa.array(row)), "ex_id": ex.take(pa.array(lo + col.ravel())), "sim": sim[row, col.ravel()]}))
        return pa.concat_tables(out) if out else pa.table({"source_id": ids.slice(0, 0), "ex_id": ex.slice(0, 0), "sim": pa.array([], pa.float64())})

    kinds = {c: f.schema[c].dataType.simpleString() for c, f in (("source_id", rows), ("ex_id", bank))}
    met = meet(rows, bank, "source_id", "ex_id", compare, f"source_id {kinds['source_id']}, ex_id {kinds['ex_id']}, sim double", pool="pool")
    return _top(met, k, F.desc(F.round("sim", 9)), F.col("ex_id")).select("source_id", "ex_id", "sim", "rank")


def _round_value(sim: float, near: float, lam: float, first: bool) -> float:
    # Values that differ by rounding noise only are ties.
    return round(sim if first else lam * sim - (1 - lam) * near, 9)


def lazy_greedy(sim: np.ndarray, bags: list[set], chosen: list[set], taken: set[int], rounds: int, lam: float) -> list[tuple[int, float]]:
    """(place, value) of the examples that ``rounds`` more rounds of maximal marginal relevance choose, places in order of id.

    The similarity to what is chosen only lowers a value, so examples are tried in order of their similarity to the row,
    and a round ends where that alone is less than the best value. Similarities to chosen ones are made when asked for.
    """
    order = np.lexsort((np.arange(len(sim)), -sim)).tolist()
    near, known, out = {}, {}, []
    chosen, taken = list(chosen), set(taken)
    for _ in range(rounds):
        best, first = None, not chosen
        for i in order:
            if i in taken:
                continue
            if best and _round_value(sim[i], 0.0, lam, first) < best[0]:
                break
            for other in chosen[known.get(i, 0) :]:
                shared = len(bags[i] & other)
                near[i] = max(near.get(i, 0.0), shared / (len(bags[i]) + len(other) - shared) if bags[i] and other else 0.0)
            known[i] = len(chosen)
            value = _round_value(sim[i], near.get(i, 0.0), lam, first)
            if best is None or (value, -i) > (best[0], -best[1]):
                best = (value, i)
        if best is None:
            break
        out.append((best[1], best[0]))
        taken.add(best[1])
        chosen.append(bags[best[1]])
    return out


#: Rows whose similarities to a block of examples are held at once.
_ROWS = 64


def select_diverse(knowledge: DataFrame, examples: DataFrame, k: int, lam: float = 0.5, block: int = INDEX_BLOCK) -> DataFrame:
    """(source_id, ex_id, rank), maximal marginal relevance: the most similar first, then lam * similarity - (1 - lam) *
    largest similarity to those chosen.

    A pool of examples that fits a block is met once, and all k rounds are made there. For a larger pool each round
    meets its blocks, each giving its best example, and the best of these is the round's.
    """
    rows, bank = _pools(knowledge.select("source_id", "content", "question_type", "strategy"), examples.select("ex_id", "knowledge", "question_type", "strategy"))
    rows, bank = rows.select("pool", "source_id", _bag(F.col("content")).alias("t")), saved(bank.select("pool", "ex_id", _bag(F.col("knowledge")).alias("t")), "bank")
    kinds = {c: f.schema[c].dataType.simpleString() for c, f in (("source_id", rows), ("ex_id", bank))}
    bags = "array<array<bigint>>"
    rows = rows.withColumns({"chosen": F.array().cast(bags), "taken": F.array().cast(f"array<{kinds['ex_id']}>")})

    def choose(rounds: int):
        def kernel(q: pa.Table, x: pa.Table) -> pa.Table:
            x = x.sort_by("ex_id").combine_chunks()
            out: list[tuple] = []
            sets = [set(b) for b in x.column("t").to_pylist()]
            ids, place = x.column("ex_id"), {e: i for i, e in enumerate(x.column("ex_id").to_pylist())}
            n_x = np.array([len(b) for b in sets], np.float64)
            for lo in range(0, len(q) if len(x) else 0, _ROWS):
                part = q.slice(lo, _ROWS).combine_chunks()
                n_q = np.asarray(part.column("t").combine_chunks().value_lengths(), np.float64)
                shared = np.zeros((len(part), len(x)))
                for at, cell, _, _, _, shape in shared_words(part, x):
                    shared[:, at : at + shape[1]] = np.bincount(cell, minlength=shape.prod()).reshape(shape)
                sim = shared / np.maximum(n_q[:, None] + n_x[None] - shared, 1)
                for i, (source, chosen, taken) in enumerate(zip(*(part.column(c).to_pylist() for c in ("source_id", "chosen", "taken")), strict=True)):
                    found = lazy_greedy(sim[i], sets, [set(b) for b in chosen], {place[e] for e in taken if e in place}, rounds, lam)
                    out += [(source, i_x, n + 1, value) for n, (i_x, value) in enumerate(found)]
            source, at, rank, value = zip(*out, strict=True) if out else ((), (), (), ())
            at = pa.array(at, pa.int64())
            return pa.table({
                "source_id": pa.array(source, q.schema.field("source_id").type), "ex_id": ids.take(at), "rank": pa.array(rank, pa.int32()), "value": pa.array(value, pa.float64()),
                "bag": x.column("t").take(at) if rounds == 1 else pa.nulls(len(at), pa.list_(pa.int64())),
            })

        return kernel

    schema = f"source_id {kinds['source_id']}, ex_id {kinds['ex_id']}, rank int, value double, bag array<bigint>"
    large = saved(bank.groupBy("pool").agg(F.count("*").alias("n")).where(F.col("n") > block).select("pool"), "pools")
    k = max(1, k)
    whole = bank.join(large, "pool", "left_anti").withColumn("all", F.lit(0))
    # The pool is the block: no example of it is dealt elsewhere.
    out = meet(rows.join(large, "pool", "left_anti"), whole, "source_id", "all", choose(k), schema, QUERY_BLOCK, block, pool="pool").select("source_id", "ex_id", "rank")
    if large.isEmpty():
        return out
    rows, bank = rows.join(large, "pool", "left_semi"), bank.join(large, "pool", "left_semi")
    for rank in range(1, k + 1):
        met = meet(rows, bank, "source_id", "ex_id", choose(1), schema, QUERY_BLOCK, block, pool="pool")
        best = met.groupBy("source_id").agg(F.min(F.struct((-F.col("value")).alias("v"), "ex_id", "bag")).alias("b"))
        best = saved(best.select("source_id", F.col("b.ex_id").alias("ex_id"), F.col("b.bag").alias("bag")), "round")
        out = out.unionByName(best.select("source_id", "ex_id", F.lit(rank).alias("rank")))
        rows = saved(rows.join(best, "source_id").select("pool", "source_id", "t", F.concat("chosen", F.array("bag")).alias("chosen"), F.concat("taken", F.array("ex_id")).alias("taken")), "rows")
    return out


def resolve_templates(matrix: DataFrame, templates: DataFrame, builtin: str = "Ask a question about: {knowledge}") -> DataFrame:
    """``matrix`` with its template: exact (strategy, question_type), else the strategy's default (null type)."""
    exact = templates.where("question_type IS NOT NULL").select("strategy", "question_type", F.col("template").alias("t1"))
    default = templates.where("question_type IS NULL").select("strategy", F.col("template").alias("t2"))
    joined = matrix.join(exact, ["strategy", "question_type"], "left").join(default, "strategy", "left")
    return joined.withColumn("template", F.coalesce("t1", "t2", F.lit(builtin))).drop("t1", "t2")


def examples_block(selected: DataFrame, examples: DataFrame) -> DataFrame:
    """(source_id, examples): chosen examples rendered in rank order."""
    line = F.concat(F.lit("Knowledge: "), "knowledge", F.lit("\nQuestion: "), "question")
    rows = selected.join(examples.select("ex_id", "knowledge", "question"), "ex_id").select("source_id", "rank", line.alias("line"))
    return rows.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("examples"))


def build_prompts(matrix: DataFrame, templates: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``matrix`` with ``prompt``: its template with knowledge, type and examples filled in; empty content
    gives an empty prompt."""
    rows = resolve_templates(matrix, templates)
    rows = rows.withColumn("examples", F.lit("")) if blocks is None else rows.join(blocks, "source_id", "left").withColumn("examples", F.coalesce("examples", F.lit("")))
    text = F.replace(F.replace(F.replace("template", F.lit("{question_type}"), F.col("question_type")), F.lit("{examples}"), F.col("examples")), F.lit("{knowledge}"), F.coalesce("content", F.lit("")))
    return rows.withColumn("prompt", F.when(F.coalesce("content", F.lit("")) == "", "").otherwise(text)).drop("template", "examples")


def expand_self_consistency(prompts: DataFrame, n: int = 5) -> DataFrame:
    """n prompts for each, cycling the reasoning instructions; one already in the prompt is not repeated."""
    listed = F.array(*map(F.lit, VARIATIONS))
    rows = prompts.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("instruction", F.get(listed, F.pmod(F.col("sample") - 1, F.lit(len(VARIATIONS)))))
    added = F.concat("prompt", F.lit("\n\nReasoning variation "), F.col("sample").cast("string"), F.lit(": "), "instruction")
    return rows.withColumn("prompt", F.when(F.contains("prompt", "instruction"), F.col("prompt")).otherwise(added)).drop("instruction")


def default_examples(rows: DataFrame) -> DataFrame:
    """Rows (source_id, question_type) with the built-in examples of their type."""
    bank = F.array(*(F.struct(F.lit(t).alias("question_type"), F.lit(k).alias("knowledge"), F.lit(q).alias("question")) for t, k, q in DEFAULT_EXAMPLES))
    own = F.filter(bank, lambda e: e["question_type"] == F.col("question_type"))
    return rows.select("source_id", "question_type", F.posexplode(own).alias("pos", "e")).select("source_id", "question_type", "pos", "e.knowledge", "e.question")


def clean_completion(raw: Column, strategy: Column) -> Column:
    """The question in a model's raw output."""
    text = strip(F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"(?s)<think>.*?</think>", ""))

    def after(markers: tuple[str, ...]) -> Column:
        out = None
        for m in markers:
            rest = strip(F.substring(text, F.instr(text, m) + len(m), F.length(text)))
            out = F.when(text.contains(m), rest) if out is None else out.when(text.contains(m), rest)
        return out.otherwise(text)

    cut = F.when(strategy == "chain_of_thought", after(MARKERS["chain_of_thought"])).when(strategy == "self_consistency", after(MARKERS["self_consistency"])).otherwise(text)
    bare = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, '^"+|"+$', ""), "^'+|'+$", ""), "^`+|`+$", ""))
    lines = F.filter(F.transform(F.split(bare, r"\r\n|\n|\r", -1), strip), lambda x: x != "")
    asking = F.filter(lines, lambda x: x.endswith("?") | x.endswith("？"))
    first = F.coalesce(F.get(asking, F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    return F.when((first != "") & ~first.endswith("?") & ~first.endswith("？"), F.concat(first, F.lit("？"))).otherwise(first)


def clean_completions(df: DataFrame) -> DataFrame:
    """(source_id, question, copies) of (source_id, strategy, raw_output): one row per question of a source."""
    return df.select("source_id", clean_completion(F.col("raw_output"), F.col("strategy")).alias("question")).groupBy("source_id", "question").agg(F.count("*").alias("copies"))


def confidence(question: Column, question_type: Column, completion_tokens: Column, max_tokens: int = 512) -> Column:
    n = F.length(question)
    score = (
        F.when(n < 10, 0.5).when(n > 200, 0.8).when(n.between(20, 100), 1.05).otherwise(1.0)
        * F.when(question.endswith("?") | question.endswith("？"), 1.0).otherwise(0.7)
        * F.when(question_type == "schema", 0.95).otherwise(1.0)
        * F.when(completion_tokens >= 0.95 * max_tokens, 0.85).otherwise(1.0)
    )
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def rank_by_confidence(df: DataFrame, n: int) -> DataFrame:
    """The n most confident questions of each source (source_id, question, question_type, completion_tokens)."""
    scored = df.withColumn("confidence", confidence(F.col("question"), F.col("question_type"), F.col("completion_tokens")))
    return _top(scored, n, F.desc("confidence"), F.col("question"))


def rag_prompt(queries: DataFrame, packed: DataFrame, system: str = "Answer from the context only.") -> DataFrame:
    """(query_id, prompt): system text, packed context and question."""
    text = F.concat(F.lit(system + "\n\nContext:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.coalesce("text", F.lit("")))
    return queries.join(packed, "query_id", "left").select("query_id", text.alias("prompt"))
