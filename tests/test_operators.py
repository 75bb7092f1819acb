"""Known answers on literal frames, and brute force where SQL has no counterpart."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import student
from granary.operators import adversarial, experiments, extract, graph, ir_metrics, prompts, quality, retrieval, text, text_metrics, validate
from granary.sources import files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ranking_metrics(spark):
    got = spark.createDataFrame([("q", "d1", 1.0, 1), ("q", "d2", 0.9, 2), ("q", "d3", 0.8, 3)], "query_id string, chunk_id string, score double, rank int")
    rel = spark.createDataFrame([("q", "d1"), ("q", "d2")], "query_id string, chunk_id string")
    m = {(r.metric, r.k): r.value for r in ir_metrics.retrieval_metrics(ir_metrics.judge(got, rel), (1, 3)).collect()}
    assert m["precision", 1] == 1 and m["recall", 1] == 0.5 and m["recall", 3] == 1 and m["mrr", 0] == 1 and m["ndcg", 3] == 1 and m["hit_rate", 1] == 1
    none = rel.limit(0)
    assert ir_metrics.retrieval_metrics(ir_metrics.judge(got, none), (1,), "distinct").count() == 0
    assert {r.value for r in ir_metrics.retrieval_metrics(ir_metrics.judge(got, none), (1,), "list").collect()} == {0.0}


def test_repeated_hits_differ_by_variant(spark):
    got = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "a", 0.9, 2)], "query_id string, chunk_id string, score double, rank int")
    judged = ir_metrics.judge(got, spark.createDataFrame([("q", "a")], "query_id string, chunk_id string"))
    value = lambda v, m: next(r.value for r in ir_metrics.retrieval_metrics(judged, (5,), v).collect() if r.metric == m)
    assert value("distinct", "precision") == pytest.approx(0.2) and value("list", "precision") == 1
    assert value("distinct", "recall") == 1 and value("list", "recall") == 2


def test_dense_topk_against_all_pairs(spark):
    r = random.Random(1)
    v = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, [1.0] * 8), (201, [1.0] * 8)]
    index = spark.createDataFrame(v, "chunk_id long, embedding array<double>")
    queries = index.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    want = set()
    for q, a in v:
        if q % 10 == 0:
            best = sorted(((-round(sum(x * y for x, y in zip(a, b)), 9), c) for c, b in v if c != q))[:5]
            want |= {(q, c, n + 1) for n, (_, c) in enumerate(best)}
    for block in (4096, 3):
        assert set(rows(retrieval.dense_topk(queries, index.repartition(5), 5, block), "query_id", "chunk_id", "rank")) == want


def test_triples_and_entities(spark):
    df = spark.createDataFrame([("a", "(Alice, knows, Bob)"), ("b", "Alice | knows | Bob"), ("c", "(A, r, B) (C, s, D) (A, r, B)"), ("d", "x, y, z, u, v, w, q"), ("e", None)], "source_id string, content string")
    assert rows(extract.extract_triples(df), "source_id", "pos", "subject", "predicate", "object") == [
        ("a", 0, "Alice", "knows", "Bob"), ("b", 0, "Alice", "knows", "Bob"), ("c", 0, "A", "r", "B"), ("c", 1, "C", "s", "D"), ("d", 0, "x", "y", "z"), ("d", 1, "u", "v", "w"),
    ]
    e = spark.createDataFrame([("a", "Alice [Person] {age: 30, city: NYC}"), ("b", "[odd]")], "source_id string, content string")
    got = {r.source_id: (r.name, r.type, dict(r.properties)) for r in extract.extract_entities(e).collect()}
    assert got == {"a": ("Alice", "Person", {"age": "30", "city": "NYC"}), "b": ("[odd]", None, {})}
    s = spark.createDataFrame([("a", "Person:age -> 30\nnothing; Person:name -> x")], "source_id string, content string")
    assert rows(extract.extract_schema(s), "entity_type", "property", "value") == [("Person", "age", "30"), ("Person", "name", "x")]


def test_detection_and_validation(spark):
    texts = ["(A, b, C)", "a | b | c", "Person:age -> 30", "Alice [Person]", "This is a long sentence with many words in it."]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_id string, content string")
    assert [r.input_type for r in extract.detect_input_type(df).orderBy("source_id").collect()] == ["triple", "triple", "schema", "entity", "text"]
    raw = spark.createDataFrame([("a", "triple", "x | y | z", ""), ("b", "triple", "x", ""), ("", "odd", " none ", "m" * 10001)], "source_id string, input_type string, content string, metadata string")
    ok, rejected = validate.split_valid(raw)
    assert ok.count() == 1 and rows(rejected, "error") == [("format:source_id",), ("semantic:content",)]
    assert validate.split_valid(raw, strict=False)[0].count() == 3


def _greedy_chunks(t, size, overlap):
    import re

    chunks, open_, length = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", t):
        if length + len(s) > size and open_:
            chunks.append(" ".join(open_))
            keep, used = [], 0
            for o in reversed(open_):
                if used + len(o) > overlap:
                    break
                keep.insert(0, o)
                used += len(o) + 1
            open_, length = keep, used
        open_.append(s)
        length += len(s) + 1
    return [*chunks, " ".join(open_)]


def test_sentence_chunks(spark):
    r = random.Random(3)
    texts = [" ".join("w" * r.randrange(1, 30) + r.choice(".!? ") for _ in range(r.randrange(1, 40))) for _ in range(20)]
    got = text.chunk_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80, 20)
    assert rows(got, "doc_id", "chunk_index", "content") == sorted((i, n, c) for i, t in enumerate(texts) for n, c in enumerate(_greedy_chunks(t, 80, 20)))


def test_graph(spark):
    t = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d")], "subject string, predicate string, object string")
    nodes, edges = graph.graph_from_triples(t)
    paths = graph.find_paths(edges, spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a")], "start string, end string"))
    assert [r.path for r in paths.collect()] == [["a", "b", "c", "d"]]
    assert {r.id for r in graph.ego_nodes(edges, spark.createDataFrame([("a",)], "seed string"), 2).collect()} == {"a", "b", "c"}
    one = graph.graph_summary(*graph.graph_from_triples(t.limit(1))).first()
    assert one.density == 0.5
    s = spark.createDataFrame([("a", "x", "b"), ("a", "x", "c")], "subject string, predicate string, object string")
    assert round(graph.graph_summary(*graph.graph_from_triples(s)).first().avg_degree, 2) == 1.33
    d = spark.createDataFrame([(1, "Paris is the capital of France. Marie Curie won the Nobel Prize! nothing here")], "doc_id long, text string")
    assert rows(graph.extract_relations(d), "subject", "predicate", "object") == [("Marie Curie", "won", "Nobel Prize"), ("Paris", "capital_of", "France")]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_rouge_l_against_dynamic_programme(spark):
    r = random.Random(5)
    pairs = [([r.choice("abcdef") for _ in range(r.randrange(0, 90))], [r.choice("abcdef") for _ in range(r.randrange(0, 90))]) for _ in range(60)] + [(list("abc"), list("ac"))]
    assert all(text_metrics._lcs(a, b) == _lcs(a, b) for a, b in pairs)
    preds = spark.createDataFrame([(i, " ".join(a)) for i, (a, _) in enumerate(pairs)], "id long, text string")
    refs = spark.createDataFrame([(i, 0, " ".join(b)) for i, (_, b) in enumerate(pairs)], "id long, ref int, text string")
    got = dict(rows(text_metrics.rouge_l(preds, refs), "id", "value"))
    assert all(got[i] == pytest.approx(2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 0) for i, (a, b) in enumerate(pairs))


def test_text_metric_facts(spark):
    one = spark.createDataFrame([("g", 1, "a b c")], "group string, id long, text string")
    assert text_metrics.self_bleu(one).first().value == 0
    q = spark.createDataFrame([(1, "What is this??!")], "id long, text string")
    assert text_metrics.grammar(q).first().value == pytest.approx(0.7)
    same = spark.createDataFrame([(1, 0, "the cat sat on the mat")], "id long, ref int, text string")
    p = same.select("id", "text")
    assert text_metrics.bleu_sentence(p, same).first().value == pytest.approx(1)
    assert text_metrics.bleu_corpus(p, same).first().bleu == pytest.approx(1)
    assert text_metrics.exact_match(p, same).first().value == 1
    with pytest.raises(KeyError):
        text_metrics.compute_metrics(p, same, ["nonsense"])


def test_student():
    assert student.two_sided_p(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    assert student.two_sided_p(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert student.quantile(0.95, 4) == pytest.approx(2.776445, abs=1e-5)
    assert student.two_sided_p(math.nan, 4) is None and student.two_sided_p(1.0, 0) is None


def test_comparisons(spark):
    data = [(m, i, s + i / 100) for m, s in (("a", 0.5), ("b", 0.6), ("c", 0.9)) for i in range(5)]
    scores = spark.createDataFrame(data, "strategy string, source long, score double")
    assert experiments.compare_all(scores, "strategy").count() == 3
    flat = experiments.compare(scores, "strategy", "a", "b", ["source"]).first()
    assert flat.test == "paired" and flat.difference == pytest.approx(0.1)
    noisy = scores.withColumn("score", F.col("score") + (F.col("source") * F.col("source") % 3) / 50.0 * (F.col("strategy") == "c").cast("int"))
    far = experiments.compare(noisy, "strategy", "a", "c", ["source"]).first()
    assert far.significant and far.p < 0.001


def test_quality_weights(spark):
    q = spark.createDataFrame([(1, "What is the capital of France in 2024?", "factual", "France capital Paris", "")], "id long, question_text string, question_type string, knowledge string, structured string")
    assert quality.q_type_consistency(q).first().score == pytest.approx(0.3 + 0.3 * 2 / 3)
    assert quality.q_fluency(q).first().score == pytest.approx(1.0)
    assert quality.q_fluency(q.withColumn("question_text", F.lit("Is the the cat here now?"))).first().score == pytest.approx(0.4 + 0.4 * 0.6 + 0.2)
    long = spark.createDataFrame([(1, "relevance", 1.0), (1, "fluency", None)], "id long, dimension string, score double")
    assert quality.quality(long).first().overall == pytest.approx(0.25 / 0.4)


def test_completions(spark):
    cases = [("chain_of_thought", "<think>x\ny</think> Final question: Who is it", "Who is it？"), ("zero_shot", '"first\nIs it so?\nand more?"', "Is it so?"), ("self_consistency", "a\nFinal answer: `What?`", "What?"), ("zero_shot", None, "")]
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(cases)], "source_id long, strategy string, raw_output string")
    assert dict(rows(prompts.clean_completions(df), "source_id", "question")) == {i: w for i, (_, _, w) in enumerate(cases)}
    conf = df.limit(1).select(*(prompts.confidence(F.lit(q), F.lit(t), F.lit(n)).alias(f"c{i}") for i, (q, t, n) in enumerate([("Who?", "factual", 5), ("What is the capital of it?", "schema", 5), ("x" * 201, "factual", 500)]))).first()
    assert tuple(conf) == (0.5, 0.997, 0.476)


def test_adversarial(spark):
    q = spark.createDataFrame([(1, "What did Einstein win?", "x"), (2, "Which is the tallest mountain?", "y"), (3, "Who", "z")], "question_id long, question string, answer string")
    got = rows(adversarial.adversarial_variants(q), "question_id", "strategy", "adversarial_question")
    assert (1, "negation", "What NOT did Einstein win?") in got and (1, "distractor", "what did newton win?") in got
    assert (2, "edge_case", "which is the second tallest mountain?") in got and not [g for g in got if g[0] == 3]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text('{"source_id": "a", "content": "x"}\nnot json\n[{"content": "y"}, {"source_id": "no content"}]\n')
    assert rows(files.read_knowledge(spark, str(tmp_path / "k.jsonl")), "content") == [("x",), ("y",)]
    assert files.read_knowledge(spark, str(tmp_path / "k.jsonl"), "text").where("input_type = 'text'").first().content == "not json"
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question_text": "Q?"}\n[{"id": "2", "question_text": "R?"}]\n')
    assert rows(files.read_questions(spark, str(tmp_path / "q.jsonl")), "id") == [("1",), ("2",)]
    (tmp_path / "r.txt").write_text('{"reference": "one"}\n"two"\nthree\n')
    assert [r.reference for r in files.read_references(spark, str(tmp_path / "r.txt")).orderBy("pos").collect()] == ["one", "two", "three"]
    (tmp_path / "d.txt").write_text("T | body | more\n\njust text\n")
    assert rows(files.read_document_lines(spark, str(tmp_path / "d.txt")), "doc_id", "title", "content") == [("doc-001", "T", "body | more"), ("doc-002", "Doc 2", "just text")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x/m1_results.json").write_text(json.dumps({"score": 0.5}))
    (tmp_path / "x/m2_eval.json").write_text(json.dumps({"score": 0.7}))
    assert rows(files.read_result_dir(spark, str(tmp_path / "x"), "score double"), "group", "score") == [("m1", 0.5), ("m2", 0.7)]
    (tmp_path / "x/p_result.json").write_text(json.dumps({"project_id": "p", "name": "n", "models": ["a", "b"], "questions": ["q"]}))
    assert rows(files.list_experiments(spark, str(tmp_path / "x")), "project_id", "models", "n_questions") == [("p", "a,b", 1)]
    (tmp_path / "h.json").write_text(json.dumps([{"question": "q", "answer": "a"}, {"_id": "z", "question": "r", "answer": "b", "level": "hard"}]))
    assert rows(files.read_hotpot(spark, str(tmp_path / "h.json")), "hops", "difficulty") == [(2, "hard"), (2, "medium")]
    stats = spark.createDataFrame([("g", "m", 1)], "group string, metric_name string, n long")
    files.write_stats_csv(stats, str(tmp_path / "s"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "s")).columns) == files.STATS_COLUMNS
    files.write_json(stats, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    with pytest.raises(ValueError):
        files.save_tables({"rag_runs": spark.createDataFrame([("1",), ("1",)], "run_id string")}, str(tmp_path / "t"))
    files.save_tables({"rag_runs": spark.createDataFrame([("1",), ("2",)], "run_id string")}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/rag_runs")).count() == 2


def test_index_append_checks_length(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert retrieval.append_index(v, v, 2).count() == 2
    with pytest.raises(Exception, match="must have 3 values"):
        retrieval.append_index(v, v, 3).collect()


def test_stream_chunks(spark, tmp_path):
    from granary.streaming.ingest import stream_chunks

    docs = spark.createDataFrame([(1, "word " * 300, "en", "s", 1500)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    stream_chunks(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == text.chunk_fixed(docs).count()


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_bm25_topk_against_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    vocab = ["a", "b", "cc", "dd", "Été", "x_1", "the"]
    chunks = [(i, i // 3, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 12)))) for i in range(60)] + [(60, 20, ""), (61, 20, None)]
    queries = [(i, " ".join(r.choice([*vocab, "none"]) for _ in range(4))) for i in range(7)] + [(7, ""), (8, None)]
    split = lambda t: [w.lower() for w in (t or "").split()]
    df = {w: sum(w in split(t) for _, _, t in chunks) for w in map(str.lower, vocab)}
    texts = [t for _, _, t in chunks if t is not None]
    setting = {"reference": (len({d for _, d, _ in chunks}), sum(map(len, texts)) / len(texts)), "standard": (len(chunks), sum(len(split(t)) for _, _, t in chunks) / len(chunks))}
    want = set()
    for mode, (n, average) in setting.items():
        for q, asked in queries:
            found = []
            for c, _, t in chunks:
                words = split(t)
                shared = [w for w in split(asked) if w in words]
                if shared:
                    value = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / average)) for w in shared)
                    found.append((-round(value, 9), c, value))
            want |= {(mode, q, c, n + 1, round(v, 6)) for n, (_, c, v) in enumerate(sorted(found)[:5])}
    frames = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(chunks, "chunk_id long, doc_id long, text string")
    for blocks in ((1024, 32768), (2, 7)):
        monkeypatch.setattr(retrieval.meet, "__defaults__", (*blocks, None))
        got = retrieval.bm25_topk(*frames, 5).collect()
        assert {(x["mode"], x.query_id, x.chunk_id, x["rank"], round(x.score, 6)) for x in got} == want


def test_overlap_topk_against_all_pairs(spark, monkeypatch):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 6)))) for i in range(40)]
    queries = [(100 + i, " ".join(r.choice("abcdefghxyz") for _ in range(3))) for i in range(12)] + [(200, "zz"), (201, None)]
    want = set()
    for q, asked in queries:
        order = sorted((-len(set((asked or "").split()) & set(t.split())), c) for c, t in docs)[:4]
        want |= {(q, c, float(-n), i + 1) for i, (n, c) in enumerate(order)}
    for blocks in ((1024, 32768), (3, 5)):
        monkeypatch.setattr(retrieval.meet, "__defaults__", (*blocks, None))
        got = retrieval.overlap_topk(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "chunk_id long, text string"), 4)
        assert set(rows(got, "query_id", "chunk_id", "score", "rank")) == want


def test_example_selection(spark, monkeypatch):
    r = random.Random(5)
    bank = [(i, " ".join(r.choice("abcdef") for _ in range(4)), "q", r.choice(("factual", "schema")), r.choice(("cot", "plain"))) for i in range(15)]
    asked = [(100 + i, " ".join(r.choice("abcdefxy") for _ in range(5)), r.choice(("factual", "schema", "odd")), r.choice(("cot", "plain", "none"))) for i in range(30)] + [(200, None, "schema", "cot")]
    examples = spark.createDataFrame(bank, "ex_id long, knowledge string, question string, question_type string, strategy string")
    knowledge = spark.createDataFrame(asked, "source_id long, content string, question_type string, strategy string")
    want, pools = set(), {}
    for s, content, kind, strategy in asked:
        exact = [e for e in bank if e[3] == kind and e[4] == strategy]
        pools[s] = exact or [e for e in bank if e[3] == kind]
        words = set((content or "").split())
        sims = sorted((-round(len(words & set(e[1].split())) / max(len(words | set(e[1].split())), 1), 9), e[0]) for e in pools[s])
        want |= {(s, e, n + 1) for n, (_, e) in enumerate(sims[:3])}
    for blocks in ((1024, 32768), (4, 3)):
        monkeypatch.setattr(retrieval.meet, "__defaults__", (*blocks, None))
        assert set(rows(prompts.select_similar(knowledge, examples, 3), "source_id", "ex_id", "rank")) == want
    chosen = prompts.select_random(knowledge, examples, 3, seed=1).collect()
    for s, pool in pools.items():
        own = [x.ex_id for x in chosen if x.source_id == s]
        assert len(own) == len(set(own)) == min(3, len(pool)) and set(own) <= {e[0] for e in pool}
    assert {tuple(x) for x in chosen} != {tuple(x) for x in prompts.select_random(knowledge, examples, 3, seed=2).collect()}


def test_entities_inside_words(spark):
    nodes = spark.createDataFrame([("a", "Art"), ("b", "new york"), ("c", "y"), ("d", "")], "id string, label string")
    queries = spark.createDataFrame([(1, "A party in NEW YORK"), (2, "nothing"), (3, None)], "query_id long, text string")
    assert rows(graph.link_entities(queries, nodes), "query_id", "id", "place") == [(1, "a", 4), (1, "b", 12), (1, "c", 7)]


def test_last_label_stays(spark):
    triples = spark.createDataFrame([("Bob", "knows", "ann", 1), ("ANN", "knows", "bob", 2), ("BOB", "is", "Bob", 3)], "subject string, predicate string, object string, pos int")
    assert rows(graph.graph_from_triples(triples)[0], "id", "label") == [("ann", "ANN"), ("bob", "Bob")]


def test_multi_round(spark):
    """A query finds one chunk a round until it has three; then it drafts, reflects and answers."""
    queries = spark.createDataFrame([("many", "x"), ("few", "x")], "query_id string, text string")

    def search(asked, number):
        return asked.select("query_id", F.when(F.col("query_id") == "many", number * 10).otherwise(1).cast("long").alias("chunk_id"), F.lit(1).alias("rank"))

    state, found = adversarial.multi_round(queries, search)
    assert rows(found, "query_id", "chunk_id") == [("few", 1), ("many", 10), ("many", 20), ("many", 30)]
    got = {r.query_id: (r.n, round(r.confidence, 2)) for r in state.collect()}
    assert got["many"][0] == 3 and got["few"][0] == 1 and got["many"][1] >= got["few"][1] > 0


def test_failed_stage_does_not_stop_the_rest(spark, tmp_path):
    def broken():
        raise KeyError("no such metric")

    told = experiments.evaluate(spark, {"one": lambda: spark.range(3), "planned": broken, "run": lambda: spark.range(2).select(F.raise_error(F.lit("x"))), "last": lambda: spark.range(1)}, str(tmp_path))
    got = {r.stage: (r.n, r.error) for r in told.collect()}
    assert got["one"] == (3, None) and got["last"] == (1, None) and got["planned"] == (None, "KeyError") and got["run"][0] is None and got["run"][1]
    assert spark.read.parquet(str(tmp_path / "one")).count() == 3


def test_answer_overlap(spark):
    preds = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a b"), (3, None)], "id long, text string")
    refs = spark.createDataFrame([(1, 0, "the cat sat on the mat"), (2, 0, " "), (3, 0, "x")], "id long, ref int, text string")
    got = {r.id: (round(r.bleu, 6), round(r.rouge_l, 6), r.n_words) for r in text_metrics.answer_overlap(preds, refs).collect()}
    assert got == {1: (1.0, 1.0, 6), 2: (0.0, 0.0, 2), 3: (0.0, 0.0, 0)}


def test_running_numbers(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question": "a"}, {"_id": "own", "question": "b", "level": "hard"}, {"question": "c"}]))
    assert rows(files.read_hotpot(spark, str(tmp_path / "q.json")), "question_id", "question", "difficulty") == [("own", "b", "hard"), ("q_0", "a", "medium"), ("q_2", "c", "medium")]
    (tmp_path / "r.txt").write_text('{"reference": "x"}\n"y"\nz\n')
    assert rows(files.read_references(spark, str(tmp_path / "r.txt")), "pos", "reference") == [(1, "x"), (2, "y"), (3, "z")]
