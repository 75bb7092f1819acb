"""Self-BLEU by best partners against all pairs."""

import collections
import math
import random

import numpy as np
import pytest

from granary.operators import best_partner, text_metrics


def _value(p, r, order=4):
    logs = 0.0
    for n in range(1, order + 1):
        a, b = (collections.Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, r))
        logs += math.log(max(sum((a & b).values()) / max(len(p) - n + 1, 1), best_partner.FLOOR))
    return math.exp(logs / order)


def _texts(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(r.choice([6, 60, 600]))]
    out = []
    for _ in range(n):
        if out and r.random() < 0.3:
            t = list(r.choice(out))
            if t:
                t[r.randrange(len(t))] = "edit"
        else:
            t = [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 5, 30]))] + (["one", "shared", "passage", "of", "words"] if r.random() < 0.3 else [])
        out.append(t)
    return out


@pytest.mark.parametrize("seed, cells", [(1, 1 << 22), (2, 40), (3, 1 << 22), (4, 1000)])
def test_best_partners_against_all_pairs(seed, cells, monkeypatch):
    monkeypatch.setattr(best_partner, "CELLS", cells)
    texts = _texts(seed, 60)
    code = {w: i * 7919 + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
    make = lambda part: best_partner.Grams(np.array([code[w] for t in part for w in t], np.int64), np.array([len(t) for t in part], np.int64), 4)
    q, x = texts[:40], texts[20:]
    got, _ = best_partner.best(make(q), np.arange(40), make(x), np.arange(20, 60), 4)
    for i, t in enumerate(q):
        want = max(_value(t, o) for j, o in enumerate(x, 20) if j != i)
        assert max(got[i], best_partner.FLOOR) == pytest.approx(want, rel=1e-9)


def test_most_pairs_are_not_scored():
    texts = _texts(11, 1500)
    code = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
    side = best_partner.Grams(np.array([code[w] for t in texts for w in t], np.int64), np.array([len(t) for t in texts], np.int64), 4)
    _, scored = best_partner.best(side, np.arange(1500), side, np.arange(1500), 4)
    assert scored < 1500 * 1499 / 10


@pytest.mark.parametrize("block", [2048, 5])
def test_self_bleu_against_all_pairs(spark, block):
    groups = {"a": _texts(5, 23), "b": _texts(6, 4), "alone": [["x", "y"]], None: _texts(7, 3), "e": [[], [], ["z"]]}
    rows = [(g, i, " ".join(t)) for g, texts in groups.items() for i, t in enumerate(texts)]
    got = {r.group: r for r in text_metrics.self_bleu(spark.createDataFrame(rows, "group string, id int, text string"), block=block).collect()}
    assert set(got) == set(groups)
    for g, texts in groups.items():
        best = [max((_value(t, o) for j, o in enumerate(texts) if j != i), default=0.0) for i, t in enumerate(texts)]
        assert got[g].n_texts == len(texts) and got[g].value == pytest.approx(np.mean(best) if len(texts) > 1 else 0.0, rel=1e-9)
        assert got[g].std == pytest.approx(np.std(best) if len(texts) > 1 else 0.0, abs=1e-9)
