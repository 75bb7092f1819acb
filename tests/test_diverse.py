"""Maximal marginal relevance by lazy greedy rounds against the plain rule."""

import random

import pytest

from granary.operators import prompts


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("block", [32768, 3])
def test_selection_against_the_plain_rule(spark, block):
    r = random.Random(6)
    text = lambda n: " ".join(r.choice("abcdefghij") for _ in range(n))
    bank = [(i, text(r.choice([0, 2, 5])), "q", r.choice(("factual", "schema")), r.choice(("cot", "plain"))) for i in range(24)]
    asked = [(100 + i, text(r.choice([0, 3, 6])), r.choice(("factual", "schema", "odd")), r.choice(("cot", "plain", "none"))) for i in range(20)] + [(200, None, "schema", "cot")]
    examples = spark.createDataFrame(bank, "ex_id long, knowledge string, question string, question_type string, strategy string")
    knowledge = spark.createDataFrame(asked, "source_id long, content string, question_type string, strategy string")
    want, k = set(), 10 if block > 3 else 3
    for s, content, kind, strategy in asked:
        pool = [e for e in bank if e[3] == kind and e[4] == strategy] or [e for e in bank if e[3] == kind]
        left, chosen = {e[0]: set(e[1].split()) for e in pool}, []
        own = set((content or "").split())
        for rank in range(1, min(k, len(pool)) + 1):
            def value(e):
                sim = _jaccard(own, left[e])
                return round(sim if rank == 1 else 0.5 * sim - 0.5 * max(_jaccard(left[e], c) for c in chosen), 9)

            best = min(left, key=lambda e: (-value(e), e))
            want.add((s, best, rank))
            chosen.append(left.pop(best))
    got = prompts.select_diverse(knowledge, examples, k, block=block).collect()
    assert {(x.source_id, x.ex_id, x["rank"]) for x in got} == want and len(got) == len(want)
