"""Weighted word matches by block maxima against all pairs."""

import random

import numpy as np
import pytest

from granary.operators import block_max


def _all_pairs(texts, norm, queries, k):
    out = set()
    for r, words in enumerate(queries):
        scored = []
        for t, text in enumerate(texts):
            shared = [(w, x) for w, x in words if w in text]
            if shared:
                scored.append((sum(x * text.count(w) / (text.count(w) + norm[t]) for w, x in shared), t))
        scored.sort(reverse=True)
        if scored:
            last = scored[min(k, len(scored)) - 1][0]
            out |= {(r, t) for s, t in scored if s >= last - block_max.NOISE}
    return out


@pytest.mark.parametrize("block, cells", [(1, 1 << 22), (4, 1 << 22), (4, 50), (64, 1)])
def test_top_against_all_pairs(block, cells, monkeypatch):
    monkeypatch.setattr(block_max, "CELLS", cells)
    r = random.Random(block)
    for _ in range(25):
        vocabulary = list(range(-5, r.choice([0, 3, 40])))
        texts = [[r.choice(vocabulary) for _ in range(r.choice([0, 1, 4, 20]))] for _ in range(r.choice([0, 1, 9, 60]))]
        texts += texts[:3]  # ties
        norm = [r.choice([0.0, 0.5, 1.5]) for _ in texts]
        queries = [[(w, r.choice([-1.0, 0.1, 1.0, 3.0])) for w in {r.randrange(-8, 45) for _ in range(r.choice([0, 1, 5]))}] for _ in range(r.choice([0, 1, 7]))]
        shard = block_max.Shard(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts], np.int64), block)
        flat = [(i, w, x) for i, q in enumerate(queries) for w, x in q]
        row, word, weight = (np.array([f[i] for f in flat], kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
        got_row, got_text, score, _, _ = shard.top(np.array(norm), row, word, weight, len(queries), 3)
        assert set(zip(got_row.tolist(), got_text.tolist(), strict=True)) == _all_pairs(texts, norm, queries, 3)
        for q, t, s in zip(got_row.tolist(), got_text.tolist(), score.tolist(), strict=True):
            assert s == pytest.approx(sum(x * texts[t].count(w) / (texts[t].count(w) + norm[t]) for w, x in queries[q] if w in texts[t]))


def test_common_words_are_not_read():
    """A query of rare and common words reads few of the common words' postings."""
    r = np.random.default_rng(1)
    n = 20_000
    common, rare = r.integers(0, 10, (n, 6)), r.integers(1_000, 4_000, (n, 4))
    words = np.concatenate([common, rare], axis=1)
    shard = block_max.Shard(words.ravel(), np.full(n, 10))
    asked = np.concatenate([np.arange(5), np.unique(words[77, 6:])])
    weight = np.where(asked < 10, 0.3, 5.0)
    row, text, score, read, of = shard.top(np.full(n, 1.5), np.zeros(len(asked), np.int64), asked, weight, 1, 3)
    assert text[0] == 77 and read < of / 10


def test_bm25_over_many_shards(spark, monkeypatch):
    """Any number of shards and query blocks gives the same k best, alone and fused with dense candidates."""
    from granary.operators import retrieval

    r = random.Random(8)
    text = lambda n: " ".join(r.choice(["a", "b", "cc", "Été", "x_1", "rare1", "rare2", "the"]) for _ in range(n))
    chunks = spark.createDataFrame([(i, i // 3, text(r.randrange(1, 12))) for i in range(80)], "chunk_id long, doc_id long, text string")
    queries = spark.createDataFrame([(i, text(4)) for i in range(9)], "query_id long, text string")
    dense = spark.createDataFrame([(q, c, r.random(), n + 1) for q in range(9) for n, c in enumerate(r.sample(range(80), 10))], "query_id long, chunk_id long, score double, rank int")
    postings = retrieval.build_postings(chunks)
    key = lambda rows: sorted((x.query_id, x.chunk_id, x["rank"], round(x.score, 9)) for x in rows)
    want = key(retrieval.hybrid_topk(dense, retrieval.bm25(queries, *postings), 4).collect())
    alone = key(retrieval._ranked(retrieval.bm25(queries, *postings), 4).collect())
    for block, shard in ((1024, 8192), (2, 7)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "SHARD", shard)
        assert key(retrieval.bm25_topk(queries, chunks, 4, modes=("reference",)).collect()) == alone
        assert key(retrieval.bm25_hybrid_topk(queries, chunks, dense, 4).collect()) == want
