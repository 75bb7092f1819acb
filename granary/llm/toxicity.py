"""Toxicity by a classifier chain of linear models.

Label columns are predicted in order. Each link is a logistic regression over the presence of words and
word beginnings; later links also see the probabilities of the earlier ones. They are trained on
out-of-fold probabilities, so a link never learns from scores its predecessor gave to its own
training rows.

Training takes a bounded sample of labelled rows (SAMPLE_ROWS, by a hash of doc_id) and the VOCABULARY
features per label that differ most between its classes; the fit itself is a few thousand weights on the
driver, over the sample's features as flat arrays read in blocks. Scoring covers every document and whole text in one pass without a shuffle.

Defined cases: null text counts as empty; rows without a label are scored only; labels of a repeated
doc_id are combined by maximum, and all its rows train; a null doc_id has no label; rows with a null label
do not train; a label column with one class only is left out of the chain and has null probabilities, and
without a last link nothing is rejected; repeated rows each get their row; long texts are read whole; an
empty table gives an empty one; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import Scratch, row_key, without

SAMPLE_ROWS = 12_000
VOCABULARY = 1_500
PREFIXES = (3, 4, 5, 6)
#: A feature found this often in a document is a feature of its own.
REPEATS = (2, 4)
FOLDS = 3
MIN_DOCS = 3
#: Bytes of text whose features are held at once.
CHUNK = 2 << 20
#: (row, feature) pairs that a step of the fit widens to 64 bits at once, on the driver.
BLOCK_PAIRS = 1 << 16
_BASE = np.uint64(2**64 - 4)  # the low bits tell the repeats


def _features(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, distinct; with ``keep`` (sorted hashes) features are indices into it.

    Features are words and word beginnings that occur, and the same occurring REPEATS times or more.
    """
    w = bt.words(data, offsets, bt.ALNUM)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    size = w.end - w.start
    docs, feats = [], []
    for length in (0, *PREFIXES):
        which = np.arange(len(size)) if not length else np.flatnonzero(size > length)
        h = w.prefix_hash(which, length) if length else w.hash
        o = owner[which]
        docs.append(o)
        feats.append(h)
    doc, feat = np.concatenate(docs), np.concatenate(feats)
    if keep is not None:
        bases = np.unique(keep & _BASE)
        at = np.minimum(np.searchsorted(bases, feat & _BASE), max(len(bases) - 1, 0))
        hit = bases[at] == feat & _BASE
        doc, feat = doc[hit], feat[hit]
    order = np.lexsort((feat, doc))
    doc, feat = doc[order], feat[order] & _BASE
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (feat[1:] != feat[:-1]))) if len(doc) else np.zeros(0, np.int64)
    many = np.diff(np.append(at, len(doc)))
    doc, feat = doc[at], feat[at]
    parts = [(doc, feat)] + [(doc[many >= r], feat[many >= r] | np.uint64(i + 1)) for i, r in enumerate(REPEATS)]
    doc, feat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if keep is not None:
        at = np.minimum(np.searchsorted(keep, feat), len(keep) - 1)
        hit = keep[at] == feat
        doc, feat = doc[hit], at[hit]
    order = np.argsort(doc, kind="stable")
    return doc[order], feat[order]


def _count_features(labels: list[str]):
    """For each task: feature, documents, and per label the positive documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in labels]
            for lo, hi, data, offsets in bt.chunks(batch.column("text"), CHUNK):
                doc, feat = _features(data, offsets)
                value, inverse = np.unique(feat, return_inverse=True)
                cols = [pa.array(value.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(value)).astype(np.int64))]
                for v in y:
                    cols.append(pa.array(np.bincount(inverse, np.nan_to_num(v[lo:hi])[doc], len(value)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, ["feature", "n", *(f"pos_{c}" for c in labels)])

    return run


def _rows(keep: np.ndarray, labels: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bt.chunks(batch.column("text"), CHUNK):
                doc, feat = _features(data, offsets, keep)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(feat.astype(np.int32)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in labels), lists], ["doc_id", *labels, "features"])

    return run


@dataclass
class Rows:
    """Features of the sample's rows, eight bytes a pair: pair p says that row row[p] has feature feat[p]; rows ascend."""

    row: np.ndarray
    feat: np.ndarray
    n: int

    @classmethod
    def of(cls, feat: np.ndarray, size: np.ndarray) -> Rows:
        return cls(np.repeat(np.arange(len(size), dtype=np.int32), size), feat.astype(np.int32, copy=False), len(size))

    def take(self, which: np.ndarray) -> Rows:
        """The rows where ``which`` is true, numbered anew."""
        pairs, new = which[self.row], (np.cumsum(which) - 1).astype(np.int32)
        return Rows(new[self.row[pairs]], self.feat[pairs], int(which.sum()))

    def _blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(self.row), BLOCK_PAIRS):
            yield self.row[at : at + BLOCK_PAIRS], self.feat[at : at + BLOCK_PAIRS]

    def by_row(self, w: np.ndarray) -> np.ndarray:
        """For each row the sum of its features' ``w``."""
        out = np.zeros(self.n)
        for row, feat in self._blocks():
            lo, hi = row[0], row[-1] + 1
            # What the block before left of its last row is added first, so sums don't depend on the blocks.
            out[lo:hi] = np.bincount(np.append(0, row - lo), np.append(out[lo], w[feat]), hi - lo)
        return out

    def by_feature(self, d: np.ndarray, width: int) -> np.ndarray:
        """For each feature the sum of its rows' ``d``."""
        out, own = np.zeros(width), np.arange(width)
        for row, feat in self._blocks():
            out = np.bincount(np.append(own, feat), np.append(out, d[row]), width)
        return out


class Link:
    """Logistic regression over sparse presence features and the dense probabilities of earlier links."""

    def __init__(self, rows: Rows, extra: np.ndarray, y: np.ndarray, width: int, steps: int = 250, l2: float = 1e-3):
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        w, v, b = np.zeros(width), np.zeros(extra.shape[1]), 0.0
        state = [np.zeros(width + len(v) + 1) for _ in range(2)]
        for t in range(1, steps + 1):
            p = self._sigmoid(rows.by_row(w) + extra @ v + b)
            d = (p - y) * weight
            grad = np.concatenate([rows.by_feature(d, width) + l2 * w, extra.T @ d + l2 * v, [d.sum()]])
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
            w, v, b = w - step[:width], v - step[width:-1], b - step[-1]
        self.w, self.v, self.b = w, v, b

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def predict(self, doc: np.ndarray, feat: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
        return self._sigmoid(np.bincount(doc, self.w[feat.astype(np.int64)], n) + extra @ self.v + self.b)

    def predict_rows(self, rows: Rows, extra: np.ndarray) -> np.ndarray:
        return self._sigmoid(rows.by_row(self.w) + extra @ self.v + self.b)


class Chain:
    """Vocabulary and links, in the order of ``labels``."""

    def __init__(self, labels: list[str], keep: np.ndarray, rows: Rows, y: np.ndarray, fold: np.ndarray):
        self.labels, self.keep, self.links = labels, keep, []
        extra = np.zeros((rows.n, 0))
        for c in range(y.shape[1]):
            out = np.zeros(rows.n)
            if c + 1 < y.shape[1]:
                for f in range(FOLDS):
                    inside, outside = fold != f, fold == f
                    link = Link(rows.take(inside), extra[inside], y[inside, c], len(keep))
                    out[outside] = link.predict_rows(rows.take(outside), extra[outside])
            self.links.append(Link(rows, extra, y[:, c], len(keep)))
            extra = np.column_stack([extra, out])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        doc, feat = _features(data, offsets, self.keep)
        n = len(offsets) - 1
        extra = np.zeros((n, 0))
        for link in self.links:
            extra = np.column_stack([extra, link.predict(doc, feat, n, extra)])
        return dict(zip(self.labels, extra.T, strict=True))


def fit_chain(docs: DataFrame, labels: DataFrame, order: list[str], sample_rows: int = SAMPLE_ROWS) -> Chain | None:
    """The chain over those label columns of ``order`` that have two classes, fitted on at most ``sample_rows``
    labelled ids' documents; None if there are none."""
    known = (
        labels.where(" AND ".join(f"{c} IS NOT NULL" for c in ["doc_id", *order])).groupBy("doc_id").agg(*(F.max(c).cast("double").alias(f"y{i}") for i, c in enumerate(order)))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    ys = [f"y{i}" for i in range(len(order))]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Read once; at most sample_rows ids are broadcast.
    sample = Scratch(docs.sparkSession, "toxicity").save(texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", *ys))
    totals = sample.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ys)).first()
    used = [i for i, c in enumerate(ys) if totals["n"] and 0 < totals[c] < totals["n"]]
    if not used:
        return None
    ys = [ys[i] for i in used]
    counts = (
        sample.mapInArrow(_count_features(ys), f"feature long, n long, {', '.join(f'pos_{c} long' for c in ys)}")
        .groupBy("feature").agg(F.sum("n").alias("n"), *(F.sum(f"pos_{c}").alias(f"pos_{c}") for c in ys)).where(F.col("n") >= MIN_DOCS)
    )
    total, chosen = float(totals["n"]), None
    for c in ys:
        pos = float(totals[c])
        share = F.col("n") / total
        gap = F.col(f"pos_{c}") / pos - (F.col("n") - F.col(f"pos_{c}")) / (total - pos)
        z = F.abs(gap) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)))
        top = counts.orderBy(z.desc(), "feature").limit(VOCABULARY).select("feature")
        chosen = top if chosen is None else chosen.union(top)
    keep = np.unique(np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64))  # at most VOCABULARY a label
    if not len(keep):
        return None
    rows = sample.mapInArrow(_rows(keep, ys), f"doc_id long, {', '.join(f'{c} double' for c in ys)}, features array<int>").toArrow()
    ids, y = rows.column("doc_id").to_numpy(), np.column_stack([rows.column(c).to_numpy() for c in ys])
    features = rows.column("features").combine_chunks()
    first, feat = features.offsets.to_numpy(), features.values.to_numpy()
    del rows
    spelled = feat.astype(">i4").tobytes()  # compares like the lists themselves
    order_of = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], spelled[4 * first[i] : 4 * first[i + 1]])))
    del spelled
    size = np.diff(first)[order_of]
    feat = feat[np.repeat(first[:-1][order_of], size) + bt.runs(size)]
    fold = bt.mix(ids[order_of].astype(np.uint64) + np.uint64(7)) % np.uint64(FOLDS)
    return Chain([order[i] for i in used], keep, Rows.of(feat, size), y[order_of], fold)


def toxicity(docs: DataFrame, labels: DataFrame, order: tuple[str, ...] = ("quality", "toxic"), threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, p_<label> for each link, rejected (last probability over ``threshold``)."""
    return score_chain(docs, fit_chain(docs, labels, list(order), sample_rows), order, threshold)


def score_chain(docs: DataFrame, chain: Chain | None, order: tuple[str, ...], threshold: float = 0.5) -> DataFrame:
    order = list(order)
    if chain is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.lit(None).cast("double").alias(f"p_{c}") for c in order), F.lit(False).alias("rejected"))
    model = docs.sparkSession.sparkContext.broadcast(chain)  # VOCABULARY weights a label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bt.chunks(batch.column("text"), CHUNK):
                p = model.value.score(data, offsets)
                last = p.get(order[-1], np.zeros(hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(p[c]) if c in p else pa.nulls(hi - lo, pa.float64()) for c in order), pa.array(last > threshold)],
                    ["doc_id", *(f"p_{c}" for c in order), "rejected"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, f"doc_id long, {', '.join(f'p_{c} double' for c in order)}, rejected boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, order: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """``docs`` without the rejected rows, columns unchanged; each row is judged by its own text, also where
    ids are null or shared."""
    chain = fit_chain(docs, labels, list(order))
    scored = score_chain(docs.select(row_key().alias("doc_id"), "text"), chain, order)
    return without(docs, Scratch(docs.sparkSession, "toxicity-drop").save(scored.where("rejected").select("doc_id")))
