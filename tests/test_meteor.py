"""METEOR against the definition, with synonyms and long texts."""

import collections
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from granary.operators import text_metrics


def _words(t):
    return re.sub(r"[!-/:-@\[-`{-~]", "", (t or "").lower()).split()


def _meteor(pred, ref, classes=None):
    p, r = _words(pred), _words(ref)
    if not p or not r:
        return 0.0
    cp, cr = collections.Counter(p), collections.Counter(r)
    m = sum((cp & cr).values())
    if classes:
        ours, theirs = (collections.Counter(classes[w] for w in x.elements() if w in classes) for x in (cp - cr, cr - cp))
        m += sum((ours & theirs).values())
    if not m:
        return 0.0
    starts = sum(w in cr and (i == 0 or p[i - 1] not in cr) for i, w in enumerate(p))
    precision, recall = m / len(p), m / len(r)
    return precision * recall / (0.9 * precision + 0.1 * recall) * (1 - 0.5 * (starts / m) ** 3)


def test_meteor_against_definition(spark):
    r = random.Random(1)
    vocab = ["a", "b", "big", "large", "huge", "cat", "dog", "hound", "The,", "é"]
    text = lambda: " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 12])))
    rows = [(i, text(), text()) for i in range(80)] + [(80, None, "a"), (81, "a", None), (82, "big dog", "large hound"), (83, "big big", "large")]
    preds = spark.createDataFrame([(i, p) for i, p, _ in rows], "id long, text string")
    refs = spark.createDataFrame([(i, n, t) for i, _, f in rows for n, t in ((0, f), (1, "a b cat"))], "id long, ref int, text string")
    classes = {"big": 1, "large": 1, "huge": 1, "dog": 2, "hound": 2}
    table = spark.createDataFrame([*classes.items(), ("big", 1)], "word string, class int")
    for more, known in (({}, None), ({"synonyms": table}, classes)):
        got = {x.id: x.value for x in text_metrics.meteor(preds, refs, **more).collect()}
        assert got == pytest.approx({i: _meteor(p, f, known) for i, p, f in rows})


def test_alignment_is_linear():
    r = np.random.default_rng(1)
    took = []
    for n in (40_000, 320_000):
        lists = [pa.array([r.integers(0, 5000, n).tolist()]) for _ in range(2)]
        began = time.perf_counter()
        text_metrics._aligned(*lists)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.5
