"""Metrics of text pairs against plain counts; their n-grams are counted pair by pair and are no rows of a plan."""

import math
import random
from collections import Counter

import pytest
from test_hubs import most_rows

from granary.operators import text_metrics as M


def _bleu(p, r):
    if not p:
        return 0.0
    logs = 0
    for n in range(1, 5):
        a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (p, r))
        logs += math.log(max(1e-10, sum((a & b).values()) / max(len(p) - n + 1, 1)))
    return math.exp(logs / 4) * (1 if len(p) > len(r) else math.exp(1 - len(r) / len(p)))


def _texts(spark, n=60, long=30):
    r = random.Random(5)
    some = lambda: " ".join(r.choice("a b c D e f".split()) for _ in range(r.randrange(0, long)))
    preds = {i: some() for i in range(n)}
    refs = {(i, k): some() for i in range(n) for k in range(3) if (i + k) % 7 and not (i % 5 == 1 and k == 0)}
    return preds, refs, spark.createDataFrame(list(preds.items()), "id long, text string"), spark.createDataFrame([(i, k, t) for (i, k), t in refs.items()], "id long, ref int, text string")


@pytest.mark.parametrize("counted", [1 << 20, 40])
def test_sentence_bleu_against_plain_counts(spark, counted, monkeypatch):
    monkeypatch.setattr(M, "COUNTED", counted)
    preds, refs, p, r = _texts(spark)
    want = {}
    for (i, _), t in refs.items():
        want[i] = max(want.get(i, 0), _bleu(preds[i].split(), t.split()))
    got = {x.id: x.value for x in M.bleu_sentence(p, r).collect()}
    assert got == pytest.approx(want)


def test_shared_grams_of_blocks_and_empty_lists():
    import pyarrow as pa

    lists = lambda x: pa.array(x, pa.list_(pa.int64()))
    assert M.shared_grams(lists([]), lists([]), 2).to_pylist() == []
    assert M.shared_grams(lists([[], [7, 7, 7], [1, 2]]), lists([[1], [7, 7], [2, 1]]), 3).to_pylist() == [[0, 0, 0], [2, 1, 0], [2, 0, 0]]


def test_sentence_bleu_makes_no_row_for_an_ngram(spark):
    _, refs, p, r = _texts(spark, 20, 300)
    found, most = most_rows(spark, lambda: M.bleu_sentence(p, r))
    assert len(found) == 20 and most <= len(refs)  # thousands before


def test_answer_overlap_from_one_join(spark):
    """Each text is read once; those without an expected answer stay, with zeros."""
    preds, refs, p, r = _texts(spark)
    (found, most) = most_rows(spark, lambda: M.answer_overlap(p, r))
    some = {i: t for (i, k), t in refs.items() if k == 0 and t.strip()}
    assert {x.id: x.bleu for x in found} == pytest.approx({i: _bleu(t.split(), some[i].split()) if i in some else 0.0 for i, t in preds.items()})
    assert {x.id: x.n_words for x in found} == {i: len(t.split()) for i, t in preds.items()}
    assert all(x.rouge_l == 0 for x in found if x.id not in some) and any(x.rouge_l > 0 for x in found)
    assert most <= len(refs)
    plan = M.answer_overlap(p, r)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_metrics_come_from_one_join(spark):
    """As each metric on its own; an id without a first reference has only what needs none."""
    preds, refs, p, r = _texts(spark)
    names = ["bleu", "rouge1", "rouge2", "rougeL", "meteor", "exact_match", "contains", "grammar"]
    both = M.compute_metrics(p, r, names)
    got = {(x.id, x.metric_name): x.score for x in both.collect()}
    assert len(got) == both.count()
    assert got == pytest.approx({(x.id, n): x.value for n in names for x in M.METRICS[n](p, r).collect()})
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    first = {i for i, k in refs if k == 0}
    assert {i for i, n in got if n == "meteor"} == first and {i for i, n in got if n == "bleu"} == {i for i, _ in refs} and {i for i, n in got if n == "grammar"} == set(preds)


def test_isolated_metrics_make_no_row_for_an_ngram(spark):
    """A metric that runs out of room is told as failed, so the counts of a good one must not need any."""
    _, refs, p, r = _texts(spark, 20, 300)
    found, most = most_rows(spark, lambda: M.compute_isolated(p, r, ["bleu", "no such metric", "exact_match"]))
    first = sum(k == 0 for _, k in refs)
    assert [(n, sum(x.metric_name == n and (x.error is not None) == failed for x in found)) for n, failed in (("bleu", False), ("no such metric", True), ("exact_match", False))] == [("bleu", 20), ("no such metric", 1), ("exact_match", first)]
    assert most <= len(refs)  # thousands before


def test_metrics_of_an_evaluation_make_no_row_for_an_ngram(spark, tmp_path):
    """The stage of exp21_evaluate, run and exported by it."""
    from granary.operators import experiments

    _, refs, p, r = _texts(spark, 20, 300)
    make = {"metrics": lambda: M.compute_metrics(p, r, ["bleu", "rouge1", "exact_match"])}
    found, most = most_rows(spark, lambda: experiments.evaluate(spark, make, str(tmp_path)))
    n = 20 + 2 * sum(k == 0 for _, k in refs)
    assert [(x.stage, x.n, x.error) for x in found] == [("metrics", n, None)] and most <= 3 * len(refs)
