"""Edges of nodes, labels in document order, validation that stops, metrics that fail alone."""

import pytest

from granary.operators import graph, text_metrics, validate


def test_later_document_names_a_node(spark):
    docs = spark.createDataFrame([(2, "Ann works at Bank"), (1, "Hello there. ANN works at Bank")], "doc_id long, text string")
    nodes, _ = graph.graph_from_documents(docs)
    assert {r.id: r.label for r in nodes.collect()} == {"ann": "Ann", "bank": "Bank"}


def test_edges_from_and_to(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), ("c", "a")], "src string, dst string")
    ids = spark.createDataFrame([("a",), ("a",), ("x",)], "id string")
    assert sorted(map(tuple, graph.edges_from(edges, ids).collect())) == [("a", "b"), ("a", "b")]
    assert sorted(map(tuple, graph.edges_to(edges, ids).collect())) == [("c", "a")]


def test_fail_fast_stops_at_a_bad_row(spark):
    rows = [("s1", "text", "fine", "", 1), ("", "text", "no id", "", 2)]
    df = spark.createDataFrame(rows, "source_id string, input_type string, content string, metadata string, row_id int")
    ok, rejected = validate.split_valid(df)
    assert (ok.count(), rejected.count()) == (1, 1)
    with pytest.raises(Exception, match="invalid row"):
        validate.split_valid(df, fail_fast=True)[0].collect()
    assert validate.split_valid(df.where("source_id <> ''"), fail_fast=True)[0].count() == 1


def test_a_failing_metric_scores_zero_alone(spark, monkeypatch):
    from pyspark.sql import functions as F

    broken = lambda p, r: p.select("id", F.raise_error(F.lit("no luck")).cast("double").alias("value"))
    monkeypatch.setitem(text_metrics.METRICS, "broken", broken)
    preds = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
    refs = spark.createDataFrame([(1, 0, "a b"), (2, 0, "d")], "id long, ref int, text string")
    got = {(r.id, r.metric_name): (r.score, r.error) for r in text_metrics.compute_isolated(preds, refs, ["exact_match", "broken", "unheard of"]).collect()}
    assert (got[1, "exact_match"], got[2, "exact_match"]) == ((1.0, None), (0.0, None))
    assert got[None, "broken"][0] == 0 and "no luck" in got[None, "broken"][1]
    assert got[None, "unheard of"][0] == 0 and "unknown" in got[None, "unheard of"][1]


def test_batch_figures(spark):
    scores = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("n", 3.0), ("n", None)], "metric_name string, score double")
    assert {tuple(r) for r in text_metrics.batch_figures(scores).collect()} == {("m", 2, 1.5, 0.5), ("n", 1, 3.0, 0.0)}
