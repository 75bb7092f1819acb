"""Entity linking by an automaton against brute force."""

import random

import numpy as np
import pytest

from granary.functions import automaton
from granary.operators import graph


def _joined(texts):
    raw = [t.encode() for t in texts]
    return raw, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


@pytest.mark.parametrize("alphabet", ["ab", " abcé日", "aé"])
def test_automaton_finds_each_pattern_first(alphabet, monkeypatch):
    r = random.Random(alphabet)
    for _ in range(60):
        monkeypatch.setattr(automaton, "HEAD", r.choice([3, 5, 256]))
        monkeypatch.setattr(automaton, "GATHERED", r.choice([5, 1 << 20]))
        patterns = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 3, 5, 9]))).encode() for _ in range(r.choice([0, 1, 3, 20]))]
        raw, data, offsets = _joined(["".join(r.choice(alphabet + "x") for _ in range(r.choice([0, 1, 5, 50, 700]))) for _ in range(r.choice([0, 1, 4, 9]))])
        got = set(zip(*(x.tolist() for x in automaton.Automaton(patterns).places(data, offsets)), strict=True))
        assert got == {(i, j, int(offsets[i]) + t.find(p)) for i, t in enumerate(raw) for j, p in enumerate(patterns) if p and p in t}


def test_automaton_walks_long_texts_in_lanes():
    """A text of some megabytes takes a few thousand steps, and matches across the ends of lanes are found."""
    r = random.Random(4)
    body = "".join(r.choice("abcdefgh ") for _ in range(300_000)) * 10
    labels = [body[i : i + 40] for i in range(0, 290_000, 9973)] + ["no such label"]
    raw, data, offsets = _joined([body, "short", body[5:]])
    text, label, place = automaton.Automaton([x.encode() for x in labels]).places(data, offsets)
    assert set(zip(text.tolist(), label.tolist(), place.tolist(), strict=True)) == {(t, i, int(offsets[t]) + raw[t].find(x.encode())) for t in (0, 2) for i, x in enumerate(labels[:-1])}


@pytest.mark.parametrize("blocks", [{}, {"text_bytes": 200, "label_bytes": 30}])
def test_linking_against_brute_force(spark, blocks):
    r = random.Random(7)
    syllables = ["An", "na", "ÄN", " ", "日本", "bank", "a", "."]
    labels = ["".join(r.choice(syllables) for _ in range(r.choice([1, 2, 3, 6]))) for _ in range(60)] + ["", None, "anna", "ANNA", "x" * 400]
    texts = ["".join(r.choice(syllables) for _ in range(r.choice([0, 3, 30]))) for _ in range(40)] + [None, "", "y" * 50 + "X" * 500]
    nodes = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(labels)], "id string, label string")
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    want = {(q, f"n{i}", t.lower().find(x.lower()) + 1, x) for q, t in enumerate(texts) if t for i, x in enumerate(labels) if x and x.lower() in t.lower()}
    assert {tuple(x) for x in graph.link_entities(queries, nodes, **blocks).collect()} == want
    assert graph.link_entities(queries.limit(0), nodes, **blocks).collect() == graph.link_entities(queries, nodes.limit(0), **blocks).collect() == []
