"""The corpus operators against brute force, with the defined edge cases."""

import collections
import hashlib
import math
import random
import re
import statistics
import tracemalloc
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import bytetext as bt
from granary.llm import chat, decontaminate, exact_dedup, html_text, jaccard_join, line_dedup, mixing, secret_scan, toxicity, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators give to columns of their own.
CLASHES = (
    "keep_id h id sha m level name block pos b text_sha best_id best_sha copy shuffle_key mix_source rate pieces cdf mix_rate mix_u mix_count mix_salt "
    "row_key cut_id cut_key cuts cut_text line_row_key removed_chunks removed_lines removed_chars quality toxic label_id y0 y1 rejected p_toxic copy_id "
    "n node comp component c sig class hits items n_words spans contaminated postings folded slot rules kinds n_assign"
).split()
BASE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
DOCS = ", ".join([BASE_COLUMNS, *(f"{n} string" for n in CLASHES)])


def make(spark, rows):
    """Rows of (doc_id, text), with columns whose names clash with the operators' own."""
    base = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 5 else None, 1) for i, t in rows], BASE_COLUMNS)
    return base.select("*", *(F.lit("x").alias(n) for n in CLASHES))


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocab = [a + b for a in "bcdfgklm" for b in ("a", "e", "io", "ÉÑ", "ö")]
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice((0, 1, 2, 5, 12, 30, 90)))) for _ in range(n)]
    for _ in range(n // 3):
        w = r.choice(texts).split(" ")
        if len(w) > 4 and r.random() < 0.7:
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "  \n "), (903, "x" * 9000), (904, "é" * 9000 + "a"), (905, "é" * 9000 + "b"), (5, texts[5]), (None, texts[5]), (None, None)]
    r.shuffle(rows)
    return rows


def test_exact_dedup(spark):
    rows = corpus()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda i: (i != keep, str(i)))):  # of repeated rows one is kept
            want[i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    weak = {"block_key": lambda c: F.pmod(F.xxhash64(c), F.lit(5))}
    for how in ({}, {"block_chars": 7}, {"block_chars": 7} | weak):
        got = exact_dedup.exact_dedup(make(spark, rows), **how).collect()
        assert collections.Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_dedup(make(spark, [])).count() == 0
    repeated = exact_dedup.exact_dedup(make(spark, [(1, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b")])).where("kept").collect()
    assert sorted((r.doc_id or 0, r.group_size) for r in repeated) == [(0, 2), (2, 3)]


def test_drop_exact_copies(spark):
    kept = exact_dedup.drop_exact_copies(make(spark, [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (5, "b")]))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]


def _sets(rows, k=3):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        out.append((i, frozenset(grams)))
    return out


def _components(sets):
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and None not in (a, b) and 100 * len(s & t) >= 90 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root} | {None: None}


@pytest.mark.parametrize("boundary", [None, 0, 26])
def test_ngram_jaccard(spark, boundary):
    rows = corpus(3)
    base = [f"w{i}" for i in range(200)]
    rows += [(2000 + j, " ".join(base[: 180 + j])) for j in range(15)] + [(2100 + j, " ".join(f"v{i}" for i in range(12 + j))) for j in range(14)]
    sets = _sets(rows)
    want = _components(sets)
    got = jaccard_join.ngram_jaccard_components(make(spark, rows), boundary=boundary).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter((i, len(s), want[i]) for i, s in sets)
    assert jaccard_join.ngram_jaccard_components(make(spark, [])).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_ELEMENTS", 900)
    base = [f"w{i}" for i in range(300)]
    rows = [(j, " ".join(base[j % 7 : 280 + j])) for j in range(18)] + [(99, "other words here entirely")]
    want = _components(_sets(rows))
    got = jaccard_join.ngram_jaccard_components(make(spark, rows), boundary=0).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: want[i] for i, _ in rows}


def test_size_classes_cover_linked_sizes():
    ends = jaccard_join.size_groups(500)
    cls = lambda s: sum(1 for e in ends if e <= s) - 1
    assert all(cls(s2) - cls(s) <= 1 for s in range(1, 400) for s2 in range(s, 10 * s // 9 + 1))


def _contaminated(rows, items):
    windows = collections.defaultdict(set)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for j in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[j : j + 13])].add(i)
    out = collections.Counter()
    for i, t in rows:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for size in {len(k) for k in windows}:
            for j in range(len(w) - size + 1):
                if x := windows.get(tuple(w[j : j + size])):
                    found |= x
                    hit.update(range(j, j + size))
        out[i, len(w), len(hit), tuple(sorted(x for x in found if x is not None)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_contamination(spark, block_bytes):
    rows = corpus(5)
    texts = [t for _, t in rows if t and len(t.split()) > 20]
    items = [(1, texts[0]), (2, texts[1].upper()), (3, "ba"), (4, "ba be"), (5, None), (6, "..."), (2, texts[2]), (None, texts[3])]
    rows += [(3000, "Zz! " + texts[1] + " zz " + texts[1]), (3001, "ba" * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(make(spark, rows), bench, block_bytes=block_bytes).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in got) == _contaminated(rows, [(None if i is None else str(i), t) for i, t in items])
    text = dict(rows)[3000]
    for s in next(r.spans for r in got if r.doc_id == 3000):
        assert len(text[s.start : s.end].split()) == s.last - s.word + 1
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(make(spark, rows), empty).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(make(spark, []), bench).count() == 0


def test_suffix_array_and_wavelet():
    r = random.Random(2)
    text = np.array([r.randrange(1, 4) if r.random() < 0.9 else 0 for _ in range(300)] + [0])
    index = decontaminate.FmIndex(text, 3)
    rows = np.array([[1, 2, 0], [3, 0, 0], [2, 2, 1]], np.int32)
    lo, hi = index.search(rows, np.array([2, 1, 3]))
    for row, n, a, b in zip(rows, (2, 1, 3), lo, hi, strict=True):
        places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == row[:n]).all()]
        assert sorted(index.locate(np.arange(a, b))) == places


def test_mixing(spark):
    rows = [(i, "w" * (1 + i % 7)) for i in range(3000)] + [(7, "w"), (None, "x"), (4000, None)]
    docs = make(spark, rows)
    out = mixing.mix_sources(docs, temperature=1.0)
    assert out.columns == [c for c in docs.columns if c not in ("copy", "shuffle_key")] + ["copy", "shuffle_key"]
    assert 0.9 < out.count() / len(rows) < 1.1  # every rate is 1
    again = mixing.mix_sources(docs.repartition(7), temperature=1.0)
    key = ("doc_id", "copy")
    assert out.select(*key).exceptAll(again.select(*key)).count() == 0
    tripled = mixing.mix_sources(docs, weights={"s1": 3.0, "s2": 1.0}).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    n = {r.source: r.n for r in tripled}
    assert set(n) == {"s1", "s2"} and 2.6 < n["s1"] / n["s2"] < 3.4
    assert mixing.mix_sources(make(spark, [])).count() == 0


def test_toxicity_held_out(spark):
    r = random.Random(4)
    clean, bad = [f"c{i}" for i in range(300)], ["nasty", "vile", "rotten"]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(clean) for _ in range(r.randrange(5, 60))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(("", "ly", "er"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0), int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "nasty vile rotten nastyer vilely")]
    assert toxicity.toxicity(make(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    docs, known = make(spark, rows), spark.createDataFrame([x for x in labels if x[0] < 500], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    truth = {i: bool(t) for i, _, t in labels if i >= 500}
    right = sum(r.rejected == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert right >= 0.97 * len(truth)
    assert not any(r.rejected for r in got if r.doc_id in (5000, 5001))
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert not any(r.rejected for r in none) and none[0].p_toxic is None
    assert toxicity.drop_toxic(docs, known).columns == docs.columns
    one_class = toxicity.toxicity(docs, known.withColumn("quality", F.lit(1))).collect()
    assert all(r.p_quality is None for r in one_class) and sum(r.rejected for r in one_class) > 50
    assert not any(r.rejected or r.p_toxic is not None for r in toxicity.toxicity(docs, known.withColumn("toxic", F.lit(0))).collect())


def _chain_by_hand(rows, labels):
    """Probabilities of the classifier chain, feature by feature and weight by weight."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def features(text):
        seen = collections.Counter()
        for w in word.findall((text or "").translate(LOWER)):
            raw = w.encode()
            seen[raw, 0] += 1
            seen.update((raw[:n], n) for n in toxicity.PREFIXES if len(raw) > n)
        return {(f, r) for f, n in seen.items() for r in (1, *toxicity.REPEATS) if n >= r}

    marks = collections.defaultdict(list)
    for i, *y in labels:
        if i is not None and None not in y:
            marks[i].append(y)
    marks = {i: [max(c) for c in zip(*ys)] for i, ys in marks.items()}
    known = sorted((i, features(t), marks[i]) for i, t in rows if i in marks)
    met = collections.Counter(f for _, fs, _ in known for f in fs)
    keep = {f for f, n in met.items() if n >= toxicity.MIN_DOCS}
    sigmoid = lambda z: 1 / (1 + math.exp(-min(max(z, -40), 40)))

    def fit(some):
        """some: (features, earlier probabilities, label)."""
        mean = sum(y for *_, y in some) / len(some)
        w, first, second = collections.defaultdict(float), collections.defaultdict(float), collections.defaultdict(float)
        names = [*keep, *(("p", j) for j in range(len(some[0][1]))), "bias"]
        value = lambda fs, extra: sum(w[f] for f in fs if f in keep) + sum(w["p", j] * p for j, p in enumerate(extra)) + w["bias"]
        for t in range(1, 251):
            grad = {n: 1e-3 * w[n] for n in names}
            grad["bias"] = 0.0
            for fs, extra, y in some:
                d = (sigmoid(value(fs, extra)) - y) * (0.5 / mean if y else 0.5 / (1 - mean)) / len(some)
                for f in fs & keep:
                    grad[f] += d
                for j, p in enumerate(extra):
                    grad["p", j] += d * p
                grad["bias"] += d
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grad[n]
                second[n] = 0.99 * second[n] + 0.01 * grad[n] ** 2
                w[n] -= 0.1 * (first[n] / (1 - 0.9**t)) / (math.sqrt(second[n] / (1 - 0.99**t)) + 1e-8)
        return lambda fs, extra: sigmoid(value(fs, extra))

    fold = [int(bt.mix(np.array([i + 7], np.uint64))[0] % np.uint64(toxicity.FOLDS)) for i, *_ in known]
    extra, links = [[] for _ in known], []
    for c in range(2):
        every = [(fs, e, y[c]) for (_, fs, y), e in zip(known, extra)]
        outer = [0.0] * len(known)
        for f in range(toxicity.FOLDS if c == 0 else 0):
            predict = fit([x for x, g in zip(every, fold) if g != f])
            outer = [predict(x[0], x[1]) if g == f else o for x, g, o in zip(every, fold, outer)]
        links.append(fit(every))
        extra = [[*e, o] for e, o in zip(extra, outer)]
    out = []
    for i, t in rows:
        p = []
        for link in links:
            p.append(link(features(t), p[:]))
        out.append((i, *p))
    return out


def test_toxicity_against_brute_force(spark):
    r = random.Random(8)
    vocab = ["plain", "plainly", "words", "of", "text", "vile", "vilest", "Ünsinn", "x", "ra", "rant"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 9))) + (" nasty nasty" if i % 3 == 0 else "")) for i in range(70)] + [(3, "nasty words"), (900, None), (None, "nasty vile")]
    labels = [(i, int(i % 4 < 2), int(i % 3 == 0)) for i in range(50)] + [(5, 1, 1), (60, None, 1), (None, 1, 1)]
    got = toxicity.toxicity(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for mine, slow in zip(sorted(((x.doc_id, x.p_quality, x.p_toxic) for x in got), key=key), sorted(_chain_by_hand(rows, labels), key=key), strict=True):
        assert mine[0] == slow[0] and abs(mine[1] - slow[1]) < 1e-6 and abs(mine[2] - slow[2]) < 1e-6


def test_toxicity_fit_is_lean(spark):
    """The driver holds the sample's features as flat arrays: a few bytes a pair, whatever it is fitted on."""
    r = random.Random(9)
    vocab = [f"{i:03d}words" for i in range(600)]
    rows = [(i, " ".join(r.sample(vocab, 120))) for i in range(1500)]
    docs, known = make(spark, rows), spark.createDataFrame([(i, i % 2, i % 3 % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    with mock.patch.object(toxicity, "Chain", wraps=toxicity.Chain) as chain:
        tracemalloc.start()
        try:
            toxicity.fit_chain(docs, known, ["quality", "toxic"])
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
    sample = chain.call_args.args[2]
    assert sample.n == 1500 and len(sample.feat) > 300_000
    assert peak < 40 * len(sample.feat)


def test_toxicity_rows_by_blocks(spark):
    """Sums over pairs are the same for every size of block, down to the last bit, also where a row spans several."""
    r = np.random.default_rng(3)
    size = np.array([0, 5, 0, 40, 1, 17, 0])
    rows = toxicity.Rows.of(r.integers(0, 9, size.sum()), size)
    w, d = r.normal(size=9), r.normal(size=7)
    row = np.repeat(np.arange(7), size)
    for block in (1, 4, 1000):
        with mock.patch.object(toxicity, "BLOCK_PAIRS", block):
            assert (rows.by_row(w) == np.bincount(row, w[rows.feat], 7)).all()
            assert (rows.by_feature(d, 9) == np.bincount(rows.feat, d[row], 9)).all()
    part = rows.take(np.array([True, False, False, True, False, True, True]))
    assert part.n == 4 and np.bincount(part.row, minlength=4).tolist() == [0, 40, 17, 0]
    assert (part.by_row(w) == rows.by_row(w)[[0, 3, 5, 6]]).all()


def test_rows_with_null_or_shared_ids(spark):
    """Rows are judged by their own text where ids say nothing."""
    bench = spark.createDataFrame([("q1", " ".join(f"w{i}" for i in range(15)))], "item_id string, text string")
    dirty, clean = " ".join(f"W{i}" for i in range(15)), " ".join(f"z{i}" for i in range(15))
    docs = make(spark, [(None, dirty), (None, clean), (7, dirty), (7, clean)])
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, clean), (7, clean)]
    assert {r["items"][0] for r in decontaminate.contamination(docs, bench).where("contaminated").collect()} == {"q1"}
    train = [(i, "nasty vile words" if i % 2 else "kind good words") for i in range(60)]
    docs = make(spark, [*train, (None, "nasty vile"), (None, "kind good"), (1, "kind good")])
    known = spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in range(2, 60)], "doc_id long, quality int, toxic int")
    left = sorted((r.doc_id or -1, r.text) for r in toxicity.drop_toxic(docs, known).collect())
    assert left == sorted([(i or -1, t) for i, t in train if not i % 2] + [(-1, "kind good"), (1, "kind good")])
    copies = make(spark, [(1, clean), (None, clean), (2, clean), (None, None), (3, "")])
    assert sorted((r.doc_id or 0, r.text or "") for r in jaccard_join.drop_near_copies(copies).collect()) == [(0, ""), (0, clean), (1, clean), (3, "")]


def test_secret_scan(spark):
    texts = [
        None, "", "token=short", "x Password : 'abcdefgh12' AKIAABCDEFGHIJKL é api_key=zzzzzzzzzz", "token=api_key: abcdefghij", "é😀 " + "a1" * 16 + " " + "f" * 33 + "g",
        "AKIA" + "A" * 11 + " AKIAAKIA" + "B" * 12, "secret=token=abcdefgh ſecret=abcdefghij TOKEN=\"ABCDEFGH", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcdefghijk", "-----BEGIN RSA PRIVATE KEY-----",
    ]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3]), (50, "pad " * 20000 + "secret: hunter2hunter2")]
    kinds = [
        ("assign", re.compile(secret_scan.BASE[0].pattern, re.I | re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    want = collections.Counter()
    for i, t in rows:
        spans = [(m.start(), n, m.end(), k) for n, (k, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m.group(g)) >= least]
        want[i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))] += 1
    got = secret_scan.secret_spans(make(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.base_spans) for r in got) == want
    plain = secret_scan.secret_spans(make(spark, rows), indexed=False).collect()
    assert collections.Counter((r.doc_id, r.spans) for r in got) == collections.Counter((r.doc_id, r.spans) for r in plain)
    assert {r.doc_id: r.spans for r in got}[8].startswith("jwt:0:")
    assert secret_scan.trigram_query(secret_scan.BASE[2]) is None
    assert secret_scan.secret_spans(make(spark, [])).count() == 0


def test_trigram_index(spark):
    """Postings, and the candidates left by their intersection, against the texts themselves."""
    rules = secret_scan.RULES
    texts = {1: "my PASSWORD is long", 2: "pass the word", 3: "AKIAX", 4: "akia", 5: "xoxb-", 6: "api key api_key", 7: ""}
    keyed = spark.createDataFrame(list(texts.items()), "key long, text string")
    named = {t for r in rules for way in secret_scan.folded_query(r) or () for t in way}
    postings = secret_scan.build_index(keyed, rules)
    assert {(r.trigram, r.key) for r in postings.collect()} == {(t, k) for t in named for k, text in texts.items() if t in text.lower()}
    want = {(k, r.kind) for k, text in texts.items() for r in rules if any(all(t in text.lower() for t in way) for way in secret_scan.folded_query(r) or ())}
    assert {(r.key, kind) for r in secret_scan.candidates(postings, rules).collect() for kind in r.kinds} == want
    assert (1, "assign") in want and (2, "assign") not in want


def test_trigram_queries_hold_for_matches():
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule)
        for text in ("api_key = abcdefghi", "PASSWD:abcdefgh", "AKIA" + "Z" * 14, "ghp_" + "a" * 40, "xoxb-1234567890ab", "AIza" + "x" * 35, "eyJaaaaaaaaa.eyJbbbbbbbb.cccccccc"):
            m = re.search(rule.pattern, text, re.I | re.A if rule.ignore_case else re.A)
            if m and query is not None:
                told = m[0].lower() if rule.ignore_case else m[0]
                assert any(all(t in told for t in way) for way in query)


def test_url_filter(spark):
    urls = ["https://A.Example.NET/en/1?x", "http://net", None, "nothing", "x://example.com/de/5#f", "http://a.org/fr/1", "http://a.org/fr", "http://example.net?/en/", "http://xnet/a", "http://b.net/" + "a/" * 50]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path[:8], r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("net", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("example.com", "/de/5", "example.com/de/", "block"),
        5: ("a.org", "/fr/1", "org/fr/", "allow"), 6: ("a.org", "/fr", None, "allow"), 7: ("example.net", "", None, "allow"), 8: ("xnet", "/a", None, "allow"), 9: ("b.net", "/a/a/a/a"[:8], "net/", "block"),
    }
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def _tree_verdicts(pages, rules):
    """Verdicts of (host, path) pages by the template tree, one page and one branch at a time."""
    U = url_filter
    rows = []
    for host, path in pages:
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        label = max(fits, key=lambda r: len(r.target)).verdict if fits else None
        rows.append([host, tuple(re.sub("[0-9]+", "*", re.sub("^/", "", path)).split("/")), label])
    z = lambda x, y: abs(statistics.mean(x) - statistics.mean(y)) / math.sqrt(max(statistics.pvariance(x + y), 1e-9) * (1 / len(x) + 1 / len(y)))
    for k in range(max((len(t) for _, t, _ in rows), default=0)):
        families = collections.defaultdict(lambda: collections.defaultdict(list))
        for row in rows:
            if len(row[1]) > k:
                families[row[0], row[1][:k]][row[1][k]].append(row)
        for branches in families.values():
            if len(branches) >= U.FANOUT and (len(branches) >= U.FANOUT_SHARE * sum(map(len, branches.values())) or len(branches) > U.NAMED):
                groups = [("*", list(branches))]
            else:
                length = lambda s: [len("/".join(r[1][k + 1 :])) for r in branches[s]]
                depth = lambda s: [len(r[1]) - k - 1 for r in branches[s]]
                runs = []
                for seg in sorted(branches, key=lambda s: (statistics.mean(length(s)), s)):
                    blocked = lambda s: [float(r[2] == "block") for r in branches[s] if r[2]]
                    alike = bool(runs) and all(z(f(seg), f(runs[-1][-1])) < U.SIMILAR_Z for f in (length, depth))
                    if alike and blocked(seg) and blocked(runs[-1][-1]):
                        x, y = blocked(seg), blocked(runs[-1][-1])
                        p = (sum(x) + sum(y) + 1) / (len(x) + len(y) + 2)
                        alike = abs(statistics.mean(x) - statistics.mean(y)) / math.sqrt(p * (1 - p) * (1 / len(x) + 1 / len(y))) < U.SIMILAR_Z
                    if alike:
                        runs[-1].append(seg)
                    else:
                        runs.append([seg])
                groups = [("~" + min(run) if len(run) > 1 else run[0], run) for run in runs]
            for name, segs in groups:
                for seg in segs:
                    for row in branches[seg]:
                        row[1] = (*row[1][:k], name, *row[1][k + 1 :])

    def rate(some, prior):
        known = [r[2] == "block" for r in some if r[2]]
        weight = U.PRIOR_WEIGHT + (len(some) - len(known)) / U.UNLABELLED
        return (sum(known) + prior * weight) / (len(known) + weight)

    out = []
    for host, t, label in rows:
        prior = rate([r for r in rows if r[1] == t], U.PRIOR)
        out.append(label or ("block" if rate([r for r in rows if r[:2] == [host, t]], prior) >= U.REJECT else "allow"))
    return out


def test_url_tree_against_brute_force(spark):
    r = random.Random(6)
    rules = (url_filter.UrlRule("block", "a.test/x/"), url_filter.UrlRule("allow", "a.test/y/"), url_filter.UrlRule("block", "b.test/"), url_filter.UrlRule("allow", "b.test/y/q"))
    pages = []
    for _ in range(900):
        host = r.choice(("a.test", "w.a.test", "b.test", "c.test", "d.test"))
        top = r.choice(("x", "y", "z", "zz", "v", "long-name"))
        tail = {"x": f"{r.randrange(99)}/{r.choice('pqr')}", "y": f"q{r.randrange(40)}.html", "z": f"{r.randrange(99)}/{r.choice('pqr')}", "zz": "".join(r.choice("abcdefgh") for _ in range(4)), "v": "p/" * r.randrange(1, 5), "long-name": ""}[top]
        pages.append((host, f"/{top}/{tail}"))
    pages += [("e.test", "/" + "a/" * 60 + s) for s in ("b", "c")] + [("", ""), ("e.test", "")]
    pages += [("f.test", f"/{a}{b}/") for a in "abcdefghijkl" for b in "mnopqrst" for _ in range(3)]  # more than NAMED children
    urls = spark.createDataFrame([(i, f"http://{h}{p}" if h else None) for i, (h, p) in enumerate(pages)], "page_id long, url string")
    got = {x.page_id: x for x in url_filter.filter_urls(urls, rules).collect()}
    want = _tree_verdicts(pages, rules)
    assert [got[i].verdict for i in range(len(pages))] == want
    free = collections.Counter(want[i] for i in range(len(pages)) if got[i].rule is None)
    assert free["block"] > 20 and free["allow"] > 20  # the tree decides either way


def test_url_branches_join_labelled_ones(spark):
    """A branch without labels is blocked with one that is built alike, and allowed where the structure differs."""
    rules = (url_filter.UrlRule("block", "x.test/spam/"), url_filter.UrlRule("allow", "x.test/news/"))
    urls = [f"http://x.test/spam/{i}/win" for i in range(60)] + [f"http://x.test/news/{i}/story/in/full.html" for i in range(60)]
    free = [f"http://x.test/offers/{i}/win" for i in range(9)] + [f"http://x.test/world/{i}/story/in/full.html" for i in range(9)]
    pages = spark.createDataFrame(list(enumerate(urls + free)), "page_id long, url string")
    got = {(urls + free)[x.page_id]: x for x in url_filter.filter_urls(pages, rules).collect()}
    assert [got[u].rule for u in free] == [None] * 18
    assert [got[u].verdict for u in free] == ["block"] * 9 + ["allow"] * 9
    assert got[free[0]].template == got[urls[0]].template == "~offers/*/win"


def test_html_text():
    page = """<!DOCTYPE html><html><head><title>T</title><script>if(a<b)document.write("<p>x</p>")</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <article><h1>Title</h1><p><b>First &amp; foremost.<br><p>a < b&nbsp;c <i>in</i>line</p><aside>See also</aside><ul><li>one<li>two</ul><div class="comments"><p>I disagree</p></div></article><footer>&copy; me</footer></body>"""
    assert html_text.main_text(page) == "Title First & foremost. a < b c inline one two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    soup = "<div class=menu><a>Home</a></div><div><h2>Head</h2><p>A paragraph that is long enough to count as text.</p><p>Short.</p><div class='ad'>Buy</div><p>More text follows in this paragraph, too.</p></div><div id=footer>c</div>"
    assert html_text.main_text(soup) == "Head A paragraph that is long enough to count as text. Short. More text follows in this paragraph, too."
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    assert html_text.main_text(long) == " ".join(["word"] * 20000)


def test_html_text_outside_of_articles():
    words = lambda s, n=12: " ".join(f"{s}{i} words of this sentence" for i in range(n)) + "."
    teaser = f"<article><p>A teaser.</p></article><div><p>{words('a')}</p><p>{words('b')}</p></div>"
    assert f"{words('a')} {words('b')}" in html_text.main_text(teaser)
    page = f"<p>Some notes.</p><article><h1>Head</h1><p>{words('a')}</p><ul><li><a>Link</a></ul><p>End.</p></article><div><a>More</a></div><p>By us.</p><article>{words('b')}</article>"
    assert html_text.main_text(page) == f"Head {words('a')} Link End. {words('b')}"


def test_html_text_around_links():
    words = lambda s, n=12: " ".join(f"{s}{i} words of this sentence" for i in range(n)) + "."
    link = "<p><a href=x>A link of some length</a> x</p>"
    menu = "<div><a href=x>Home page of ours</a></div>" * 4
    text = "A link of some length x"
    for n in (1, 3, 6):
        page = f"{menu}<p>{words('a', 30)}</p>{link * n}<p>{words('b', 9)}</p>{menu}<p>(c) us</p>"
        assert html_text.main_text(page) == " ".join([words("a", 30), *[text] * n, words("b", 9)])
    page = f"{menu}<p>{words('a')}</p>{link}<p>So.</p>{link * 4}<p>{words('b')}</p>"
    assert html_text.main_text(page) == " ".join([words("a"), text, "So.", *[text] * 4, words("b")])


def test_html_attributes():
    for plain in ('style="overflow:hidden"', 'data-hidden="false"', "data-id=menu", "data-class='ad'", 'title="class=ad id=menu hidden"', "x-role=banner", 'title=hidden', 'alt = " hidden "', "onclick='a(\"x\") hidden'"):
        assert html_text.main_text(f"<article><div {plain}>Text of it</div></article>") == "Text of it", plain
        assert html_text.main_text(f"<div {plain}>Text of it</div>") == "Text of it", plain
    for gone in ("hidden", "HIDDEN=''", 'a="b"hidden', "data-x hidden", "class=ad", 'Class = "big ad"', "id='menu'", "role=banner", 'aria-hidden="true"', "title='hidden' class=ad"):
        assert html_text.main_text(f"<article>a <div {gone}>Text of it</div></article>") == "a", gone


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x"), (None, None, None), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]


def test_line_dedup(spark):
    long = "word " * 60
    block = "\n".join(f"line {i} of it" for i in range(12))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, f"head\n{block}\ntail"), (4, f"other\nstart\n{block}\nend"), (5, None), (6, ""), (7, "solo"), (8, "solo"), (9, f"x\n{long}"), (9, f"x\n{long}")]
    got = collections.defaultdict(list)
    for r in line_dedup.dedup_lines(make(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert got[1][0].text == rows[0][1] and got[3][0].text == rows[2][1]
    assert got[2][0].text == "c\nd" and got[2][0].removed_chunks == 1
    assert got[4][0].removed_lines >= 4 and got[4][0].text.startswith("other\nstart") and got[4][0].text.endswith("end")
    assert got[5][0].text is None and got[6][0].text == "" and got[7][0].text == got[8][0].text == "solo"
    assert [r.text for r in got[9]] == ["x", "x"]
    assert line_dedup.dedup_lines(make(spark, [])).count() == 0


def test_line_dedup_sorts_no_texts(spark):
    """Whole texts meet their cuts without a sort of the texts, and chunks are grouped by their hash alone."""
    rows = [(i, "One shared line here.\nAnother shared line.\nOwn line %d." % i) for i in range(4)]
    seen = []
    with mock.patch.object(line_dedup.Scratch, "save", autospec=True, side_effect=lambda self, df, save=line_dedup.Scratch.save: seen.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df)):
        out = line_dedup.dedup_lines(make(spark, rows))
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.removed_lines for r in out.collect()) == [0, 2, 2, 2]
    assert not any("SortMergeJoin" in plan for plan in seen) and sum("ShuffledHashJoin" in plan for plan in seen) >= 4
    assert not any("keys=[h#" in line and "chunk#" in line.split("functions")[0] for plan in seen for line in plan.split("\n"))


def test_line_dedup_planted_passages(spark):
    """Passages of 3 to 8 sentences and 50 words and more go whole, wherever they stand in later documents."""
    r = random.Random(3)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)) + "."
    rows, want = [], {}
    for k in range(60):
        sentences = [say(18) for _ in range(3 + k % 6)]
        gap = " " if k % 2 else "\n"
        passage, blank = gap.join(sentences), "\n\n" if k % 3 == 0 else " "
        rows.append((k, f"{say(7)} {passage} {say(9)}"))
        before, after = say(5), say(6)
        rows.append((1000 + k, f"{before}{blank}{passage} {after}"))
        want[1000 + k] = (f"{before}{blank}{after}", 1, len(sentences))
        rows.append((2000 + k, f"begun {passage} {after}"))  # pasted into a sentence: its first line differs
        # The first occurrence has the first sentence inside its run of repeated chunks, so it is not compared.
        want[2000 + k] = (f"begun {sentences[0]}", 1, len(sentences))
    r.shuffle(rows)
    got = {x.doc_id: x for x in line_dedup.dedup_lines(make(spark, rows)).collect()}
    for i, t in rows:
        assert (got[i].text, got[i].removed_chunks, got[i].removed_lines) == want.get(i, (t, 0, 0))
    # Single short lines and pairs from different places are no passage.
    apart = [(1, "One here. Two there."), (2, "Three more. Four else."), (3, "One here. Three more.\nTwo there.\nOne here."), (4, "x. x. x. x. x.")]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(make(spark, apart)).collect()}
    assert got == dict(apart[:3]) | {4: "x."}


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://net/a", "<p>x"), (1, "http://net/a", "<p>x"), (None, None, None), (2, "http://a.org/fr/1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.select("*", *(F.lit("x").alias(n) for n in ("host", "path", "rule", "verdict", "shape", "label", "template", "purity", "rejected", "n", "d", "text", "n_chars", "parent", "seg", "to")))
    got = url_filter.filter_urls(pages).collect()
    assert sorted((r.page_id or 0, r.host, r.rule or "", r.verdict) for r in got) == [(0, "", "", "allow"), (1, "net", "net/", "block"), (1, "net", "net/", "block"), (2, "a.org", "org/fr/", "allow")]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def _dedup_by_bytes(rows):
    """(text, removed lines) of each row: pairs of lines with words, and lines of 50 words, that stood in an earlier place go, grown by words."""
    docs = []
    for i, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, _row_hash(x[1]))):
        lines, at = [], 0
        for m in re.finditer(r"\n|(?<=[.!?]) ", t or ""):
            lines.append((at, m.start()))
            at = m.end()
        lines.append((at, len(t or "")))
        full = [n for n, (a, b) in enumerate(lines) if re.search(r"[^\x20\x09-\x0d]", t[a:b])] if t else []
        pairs = [(x, y) for x, y in zip(full, full[1:])] + [(x, x) for x in full if len((t[lines[x][0] : lines[x][1]]).split()) >= line_dedup.LONG_WORDS]
        docs.append((i, t, lines, sorted(pairs)))
    many = collections.Counter(rows)
    times = collections.Counter(t[lines[x][0] : lines[y][1]] for i, t, lines, pairs in docs for x, y in pairs for _ in range(many[i, t]))
    first, out = {}, {}
    for i, t, lines, pairs in docs:
        passages = []  # [first line, last line, what stands before, and before the first occurrence, and the same after]
        again = [(x, y) for x, y in pairs if times[t[lines[x][0] : lines[y][1]]] > 1]
        for n, (x, y) in enumerate(again):
            chunk = t[lines[x][0] : lines[y][1]]
            # Only where a run of repeated chunks ends in either place is the line beside it compared.
            before = t[lines[x - 1][0] : lines[x][0]] if x and (n == 0 or x > again[n - 1][1] + 1) else ""
            after = t[lines[y][1] : lines[y + 1][1]] if y + 1 < len(lines) and (n + 1 == len(again) or again[n + 1][0] > y + 1) else ""
            if chunk not in first:
                first[chunk] = (before, after)
            elif passages and x <= passages[-1][1] + 1:
                p = passages[-1]
                passages[-1] = [p[0], y, *p[2:4], after, first[chunk][1]] if y >= p[1] else p
            else:
                passages.append([x, y, before, first[chunk][0], after, first[chunk][1]])
        merged = []
        for x, y, before, old_before, after, old_after in passages:
            left = max(n for n in range(min(len(before), len(old_before)) + 1) if before[len(before) - n :] == old_before[len(old_before) - n :]
                       and (n == 0 or all(n == len(s) or s[len(s) - n - 1].isspace() for s in (before, old_before))))
            right = max(n for n in range(min(len(after), len(old_after)) + 1) if after[:n] == old_after[:n] and (n == 0 or all(n == len(s) or s[n].isspace() for s in (after, old_after))))
            a, b = lines[x][0] - left, lines[y][1] + right
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b), merged[-1][2], y)
            else:
                merged.append((a, b, x, y))
        kept, at = "", 0
        for a, b, *_ in merged:
            kept += t[at:a]
            at = b + 1
        if t is not None:
            kept = kept[:-1] if at > len(t) else kept + t[at:]
        out[i, t] = (t if t is None else kept, sum(y - x + 1 for *_, x, y in merged))
    return out


def _row_hash(text):
    return _HASHES[text or ""]


_HASHES = {}


@pytest.mark.parametrize("hash_bits", [64, 5])
def test_line_dedup_against_brute_force(spark, monkeypatch, hash_bits):
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(("la", "le", "lé", "li", "lo")) + r.choice("bcdfg") for _ in range(n)) + r.choice((".", "!", "", "?"))
    pool = [say(r.choice((1, 3, 6, 9, 55))) for _ in range(60)]
    rows = []
    for i in range(90):
        parts = [r.choice(pool) if r.random() < 0.3 else say(r.randrange(1, 8)) for _ in range(r.randrange(0, 9))]
        if r.random() < 0.6:
            at = r.randrange(len(pool) - 6)
            parts[r.randrange(len(parts) + 1) : 0] = pool[at : at + r.randrange(2, 6)]
        rows.append((i if i % 9 else None, "".join(p + r.choice(("\n", " ", "\n\n")) for p in parts)[: r.choice((None, -1))]))
    rows += [(200, None), (201, ""), (3, rows[3][1]), (202, "\n\n"), (203, rows[5][1] + rows[6][1])]
    for x in make(spark, rows).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect():
        _HASHES[x.text or ""] = x.k
    want = _dedup_by_bytes(rows)
    if hash_bits < 64:  # chunks of other bytes share their hashes
        spell = line_dedup._texts

        def weak(batches):
            import pyarrow as pa

            for b in spell(batches):
                at = b.schema.get_field_index("h")
                yield b.set_column(at, "h", pa.array(b.column(at).to_numpy() % (1 << hash_bits)))

        monkeypatch.setattr(line_dedup, "_texts", weak)
    keyed = make(spark, rows).withColumn("lang", F.col("text"))  # an extra column tells the old text
    got = collections.Counter((x.doc_id, x.lang, x.text, x.removed_lines) for x in line_dedup.dedup_lines(keyed).collect())
    assert got == collections.Counter((i, t, *want[i, t]) for i, t in rows)
    assert sum(w[1] > 0 for w in want.values()) > 20


def test_line_dedup_recall(spark):
    """Of passages of over 50 words pasted at random words of random documents, 90 % of the later copies' characters go."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 8)))
    prose = lambda n: " ".join(word() + (r.choice((".", ".\n")) if r.random() < 0.12 else "") for _ in range(n)).replace("\n ", "\n")
    rows, spans = [], []
    for k in range(120):
        passage = prose(r.randrange(51, 120)).strip()
        for c in range(3):
            host = prose(r.randrange(60, 200)).split(" ")
            at = r.randrange(1, len(host))
            rows.append((1000 * c + k, " ".join([*host[:at], passage, *host[at:]])))
            if c:
                spans.append((1000 * c + k, len(passage), len(" ".join(host))))
    got = {x.doc_id: x.removed_chars for x in line_dedup.dedup_lines(make(spark, rows)).collect()}
    assert sum(min(got[i], n) for i, n, _ in spans) >= 0.9 * sum(n for _, n, _ in spans)
    assert all(got[k] == 0 for k in range(120)) and all(got[i] <= n + 1 for i, n, _ in spans)


def test_chat_round_trip(spark):
    digest = F.pandas_udf(chat.read_back, chat.READ_BACK)
    odd = ["<|im_end|>\n<|im_start|>assistant\nhi", "\\", "<\\|", "a<", "|b", None, "", "é😀\n"]
    turns = [(c, t, ("user", "assistant", "role\nx<|im_end|>", None)[(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(4) for t in range(9)] + [(7, t, "assistant", f"m{t}") for t in range(300)] + [(None, 0, "user", "nobody's"), (None, 1, "assistant", "ok"), (8, None, "user", "a"), (8, 1, "user", "b"), (8, 1, "user", "b")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").select("*", *(F.lit("x").alias(n) for n in ("tree", "node", "parent", "leaf", "t", "start", "end", "pos")))
    assert chat.format_conversations(chat.linear_messages(frame.limit(0))).count() == 0
    got = {r.tree: r for r in chat.format_conversations(chat.linear_messages(frame)).withColumn("d", digest("conversation", "loss")).collect()}
    for c in {x[0] for x in turns}:
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in turns if x[0] == c), key=lambda x: -1 if x[1] is None else x[1])]
        assert chat.parse_turns(got[c].conversation) == want
        masked = "".join(t for r, t in want if r == "assistant")
        assert (got[c].d.n_turns, got[c].d.loss_chars, got[c].d.loss_sha256) == (len(want), len(masked), hashlib.sha256(masked.encode()).hexdigest())


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 3, -5.0), (1, 5, 3, 0.5), (2, 1, 9, None), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (1, 2, 1, 1.0)]
    messages = spark.createDataFrame([(t, n, p, s, "user", f"{t}.{n}") for t, n, p, s in rows], "tree long, node long, parent long, score double, role string, text string")
    got = {(r.tree, r.branch): [t for _, t in chat.parse_turns(r.conversation)] for r in chat.format_conversations(messages, top=2).collect()}
    assert got == {(1, 1): ["1.1", "1.3", "1.5"], (1, 2): ["1.1", "1.2"], (2, 1): ["2.1"]}


def test_words_of_long_documents(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bt, "CHUNK", 64)
    bt._tables.clear()
    texts = ["Ab cd " * 40, "ab", None, "", "cd ab"]
    hashes = []
    for _, _, data, offsets in bt.chunks(pa.array(texts), 64):
        w = bt.words(data, offsets, bt.ALNUM)
        hashes += [list(w.hash[w.first[i] : w.first[i + 1]]) for i in range(len(offsets) - 1)]
    bt._tables.clear()
    ab, cd = hashes[1][0], hashes[4][0]
    assert hashes == [[ab, cd] * 40, [ab], [], [], [cd, ab]] and ab != cd
