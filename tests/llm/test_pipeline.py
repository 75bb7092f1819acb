"""The pipeline against its stages' contracts on a small table."""

import collections
import hashlib
import math

import corpus_pipeline
from test_corpus_operators import _components, _contaminated, _sets, make

SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_and_drops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"start": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == out["start"].columns
        out[name] = docs
    texts = [r.text or "" for r in out["exact dedup"].select("text").collect()]
    assert len(texts) == len(set(texts))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in out["toxicity"].select("doc_id").collect()}
    gone = {r.doc_id for r in out["start"].select("doc_id").collect()} - kept
    assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(labels)
    final = corpus_pipeline.run(spark, SF)
    assert final.columns == [*out["start"].columns, "copy"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} <= ids


def _mixed(rows):
    """(doc_id, copy) counts by Poisson quantiles at md5-seeded numbers; targets are square roots of characters."""
    mass = collections.Counter()
    for r in rows:
        mass[r.source] += len(r.text or "")
    mass = {s: n for s, n in mass.items() if n}
    total, roots = sum(mass.values()), sum(math.sqrt(n) for n in mass.values())
    out = collections.Counter()
    for r in rows:
        if r.source not in mass:
            continue
        rate = math.sqrt(mass[r.source]) / roots * total / mass[r.source]
        pieces = math.ceil(rate / 64)
        key = str(r.doc_id) if r.doc_id is not None else "text:" + (r.text or "")
        n = 0
        for piece in range(1, pieces + 1):
            u = (int(hashlib.md5(f"42:{key}:{piece}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            p = below = math.exp(-rate / pieces)
            k = 0
            while below < u:
                k += 1
                p *= rate / pieces / k
                below += p
            n += k
        out.update((r.doc_id, copy) for copy in range(n))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    given = [r for r in docs.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 70]
    items = [r.text for r in bench.orderBy("item_id").collect() if len(r.text.split()) >= 13]
    planted = []
    for n, r in enumerate(given[:24]):
        words, i, source = r.text.split(), 100_000 + 10 * n, ("web", "books", None)[n % 3]
        planted.append((i, r.text, r.lang, source, len(r.text)))  # an exact copy
        for k in (1, 2):  # copies with a changed word, linked or not by their length
            near = " ".join([*words[: len(words) // k - 1], "qqq", *words[len(words) // k :]])
            planted.append((i + k, near, r.lang, source, len(near)))
        dirty = f"{items[n % len(items)]} {' '.join(words[:40])} zz{n}"
        planted.append((i + 3, dirty, r.lang, source, len(dirty)))
        diluted = f"{items[n % len(items)]} {' '.join(f'u{n}x{j}' for j in range(600))}"  # below 5 %
        planted.append((i + 4, diluted, r.lang, source, len(diluted)))
    planted += [(200_000, None, "en", "web", 0), (200_001, "", "en", "web", 0), (None, "no id here", "en", "web", 10)]
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{sf}/documents.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")

    start = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.toxicity(spark, start, sf).collect()  # the classifier's verdicts are taken as given
    sizes = [start.count(), len(rows)]
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert toxic and len(toxic - {r.doc_id for r in rows}) >= 0.8 * len(toxic)
    best = {}
    for r in rows:
        t = r.text or ""
        if t not in best or best[t].doc_id is None or r.doc_id is not None and r.doc_id > best[t].doc_id:
            best[t] = r
    rows = list(best.values())
    sizes.append(len(rows))
    component = _components(_sets([(r.doc_id, r.text) for r in rows]))
    rows = [r for r in rows if component[r.doc_id] == r.doc_id]
    sizes.append(len(rows))
    found = _contaminated([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in bench.collect()])
    dirty = {i for i, *_, contaminated in found if contaminated}
    rows = [r for r in rows if r.doc_id not in dirty]
    sizes.append(len(rows))
    assert all(a > b > 0 for a, b in zip(sizes, sizes[1:])), sizes  # every stage has something to drop
    want = _mixed(rows)
    assert {copy for _, copy in want} > {0, 1}
    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter((r.doc_id, r.copy) for r in got) == want
    text = {r.doc_id: (r.text, r.source) for r in rows}
    assert all((r.text, r.source) == text[r.doc_id] for r in got)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[-1] == "copy" and out.collect() == []


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    """Every stage keeps the columns as they are, and repeated rows and null ids and texts pass or go by their text."""
    text = " ".join(f"word{i}" for i in range(60))
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 13)
    rows = [(1, text), (1, text), (2, text), (3, f"{text} more"), (4, item), (4, "clean text of the same id"), (None, item), (None, None), (None, None), (5, None), (6, ""), (7, "other words here")]
    docs = make(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        own = [c for c in docs.columns if c not in ("copy", "shuffle_key")] + ["copy"]  # mixing replaces these
        assert out.columns == (own if stage is corpus_pipeline.mix else docs.columns)
        assert {r.keep_id for r in out.collect()} <= {"x"}  # a column of the input, not the stage's own

    def kept(stage):
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)

    exact = kept(corpus_pipeline.exact)
    assert len(exact) == len({t or "" for _, t in rows}) and {(2, text)} <= set(exact)
    clean = kept(corpus_pipeline.decontaminate)
    assert clean == sorted(((i, t) for i, t in rows if t != item), key=str)
    near = kept(corpus_pipeline.near)
    assert (3, f"{text} more") not in near and {(7, "other words here"), (5, None), (6, "")} <= set(near)
