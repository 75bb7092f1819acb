"""Hard negatives, fill-in-the-middle and substring dedup against brute force, with the defined edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import fill_middle, hard_negatives, substring_dedup

TOKEN = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
WORD = re.compile(r"[^ \t-\r]+")
#: Names that the operators give to columns of their own.
CLASHES = "d key anchor stretch no whole single kept w1 w2 at first open n_words n_removed n form prefix_chars middle_chars fim_text fim_digest fim_made substring_d substring_key".split()


def docs(spark, rows):
    base = spark.createDataFrame(rows, "doc_id long, text string")
    return base.select("*", *(F.lit("x").alias(c) for c in CLASHES))


def cut(doc_id, text, seed=42):
    """A text transformed by the definition."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def cuttable(seed=3, n=300):
    r = random.Random(seed)
    pieces = ["word", "ÄÖ", "日本語", " ", "  ", "\n", "\t", "<", "P>", "<P", ">", "😀", "S>", " ", "x" * 40]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.choice((0, 1, 2, 7, 40))))) for i in range(n)]
    rows += [(i, t) for i in range(400, 440) for t in ("<", "P> begins where a text may end with <", "a<P>b", " \n ", "M>")]
    rows += [(500, None), (501, ""), (None, "no id here, but words"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (6, "another text of the id"), (502, "long é " * 300_000)]
    r.shuffle(rows)
    return rows


def test_fill_in_middle_against_brute_force(spark):
    rows = cuttable()
    made = fill_middle.fill_in_middle(docs(spark, rows))
    assert made.columns == ["doc_id", "text", *(c for c in CLASHES if c not in ("n", "form", "prefix_chars", "middle_chars", "fim_text")), "n", "form", "prefix_chars", "middle_chars", "fim_text"]
    got = made.withColumn("back", fill_middle.restore_middle("fim_text", "form")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) for r in got), key=key) == sorted(((i, *cut(i, t)) for i, t in rows), key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(spark):
    empty = fill_middle.fill_in_middle(docs(spark, []))
    assert empty.withColumn("back", fill_middle.restore_middle("fim_text", "form")).collect() == []


def test_sentinels_do_not_reach_across_documents():
    data = np.frombuffer("<P>a<".encode() + b"P>b", np.uint8)
    places, owner = fill_middle._sentinels(data, np.array([0, 5, 8]))
    assert places.tolist() == [0] and owner.tolist() == [0]


def removed(rows, window):
    """Kept words of each row, by the definition."""
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    first = {}
    for i, ws in zip(ids, words, strict=True):
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in zip(ids, words, strict=True):
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def repetitive(seed, window, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ä", "a"]
    rare = lambda k: [r.choice(vocab) for _ in range(k)]
    shared = [rare(r.choice((window - 1, window, window + 1, 2 * window + 3, 5 * window))) for _ in range(12)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.15 and rows:  # copies and near copies
            ws = WORD.findall(r.choice(rows)[1] or "")
            if ws and r.random() < 0.6:
                ws[r.randrange(len(ws))] = "edit"
        else:
            ws = rare(r.choice((0, 3, window, 4 * window)))
            for _ in range(r.choice((0, 1, 1, 2))):
                k = r.randrange(len(ws) + 1)
                ws[k:k] = r.choice(shared)
        rows.append((r.randrange(3 * n), r.choice((" ", "\n", "  ")).join(ws)))
    run = "a " * (3 * window)
    rows += [(900, run), (901, run + "b"), (902, "b " + run), (903, None), (904, ""), (905, " \n"), (None, rows[1][1]), (None, rows[1][1]), rows[2], rows[2], (907, " ".join(shared[-1])), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [1, 2, 5, 50])
def test_substring_dedup_against_brute_force(spark, window):
    rows = repetitive(window, max(window, 3))
    got = substring_dedup.dedup_substrings(docs(spark, rows), window)
    assert got.columns == ["doc_id", "text", *(c for c in CLASHES if c not in ("n_words", "n_removed")), "n_words", "n_removed"]
    want = [(i, n, k, kept if t is not None else None) for (i, t), (n, k, kept) in zip(rows, removed(rows, window), strict=True)]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=key) == sorted(want, key=key)


def test_substring_dedup_of_nothing_and_long_texts(spark):
    assert substring_dedup.dedup_substrings(docs(spark, [])).collect() == []
    long = " ".join(f"t{i}" for i in range(200_000))
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs(spark, [(1, long), (2, "x " + long + " y")])).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].text) == (0, 200_000, "x y")


def test_equal_windows_have_equal_anchors():
    """Words of a window alone choose its anchor, wherever the window stands."""
    r = random.Random(1)
    ws = [f"v{r.randrange(30)}" for _ in range(200)]
    inside = lambda before: substring_dedup.stretches(*_bytes(" ".join([*before, *ws])), 50)[1]
    for before in ([], ["other"] * 7):
        s = inside(before)
        anchors = {k - len(before): a for f, t, a in zip(s["from"], s["to"], s["anchor"], strict=True) for k in range(f, t + 1)}
        if not before:
            want = anchors
    assert all(anchors[k] == a for k, a in want.items())


def _bytes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").select("*", *(F.lit("x").alias(c) for c in ("q", "tile", "slab", "part", "cuts", "v0", "name", "id", "score", "windows", "anchor_id")))


def mined(rows, anchors, k=5):
    """Positives and negatives by comparing all with all."""
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        best[i] = min(best.get(i, (label, q)), (label, q))
    out = set()
    for a in (i for i in best if anchors(i)):
        label, q = best[a]
        scored = sorted((-sum(x * y for x, y in zip(q, o, strict=False)), i, lab) for i, (lab, o) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            near = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out |= {(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(near, 1)}
    return out


def cloud(seed=5, n=600, dim=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        rows.append((i, r.randrange(3), [x + r.gauss(0, 0.1) for x in c]))
    same = [0.5] * dim
    rows += [(1000 + i, i % 2, same) for i in range(150)]  # equal vectors: ties by id
    rows += [(2000, 0, []), (2001, 0, [1.0]), (2002, None, same), (2003, 1, None), (2004, 1, [None] * dim), (2005, 1, [float("nan")] * dim), (2006, 1, [float("inf")] * dim), (None, 1, same)]
    rows += [(7, 2, same), (7, 2, same), (20, 1, [-1.0] * dim), (-20, 0, [-0.2] * dim), (2010, 1, [0.0] * dim)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile, leaf", [(4096, 64), (40, 4)])
def test_hard_negatives_against_brute_force(spark, tile, leaf):
    rows = cloud()
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, tile=tile, leaf=leaf)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r) for r in got.collect()} == mined(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(vectors(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, [(10, 1, []), (11, 1, []), (12, 2, [])]), F.col("vec_id") % 10 == 0).collect() == [(10, 11, 1, 12, 0, 0)]
    assert hard_negatives.hard_negatives(vectors(spark, [(1, 1, [1.0]), (2, 2, [1.0])]), F.col("vec_id") % 10 == 0).collect() == []


def packed(x, ids, labels, leaf):
    table = pa.table({"q": x.tolist(), "vec_id": ids, "label": labels})
    return hard_negatives._packer(x.shape[1], leaf)((pa.scalar(0),), table).to_pylist()


def test_boxes_bound_scores_and_prune():
    """Bounds hold for every row; clustered vectors let the queue skip most boxes."""
    r = np.random.default_rng(2)
    centres = r.integers(-200, 200, (32, 4))
    x = (centres[np.arange(4096) % 32] + r.integers(-4, 5, (4096, 4))).astype(np.int64)
    ids, labels = np.arange(4096), np.arange(4096) % 7 % 3
    tiles = packed(x, ids, labels, 32)
    window = [{"name": 0, "lo": -(1 << 62), "hi": 1 << 62, "bar": -(1 << 62), "bar_id": (1 << 63) - 1}]
    asked = hard_negatives.Requests(pa.table({"anchor_id": ids[:64], "label": labels[:64], "q": x[:64].tolist(), "windows": [window] * 64}), 4)
    lo, hi = (np.frombuffer(tiles[0][c], np.int32).reshape(-1, 4) for c in ("lo", "hi"))
    low, high = asked.bounds(lo, hi)
    order, at = np.frombuffer(tiles[0]["ids"], np.int64), 0
    for i, n in enumerate(np.frombuffer(tiles[0]["sizes"], np.int64)):
        s = x[:64] @ x[order[at : at + n]].T
        assert (low[:, i] <= s.min(axis=1)).all() and (s.max(axis=1) <= high[:, i]).all()
        at += n
    found, scored, of = hard_negatives.search(asked, tiles, 4, 5, True)
    assert len(found) == 64 * 5 and scored < of / 4
