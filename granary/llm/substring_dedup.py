"""Removal of word windows that stand in an earlier document, by level-wise doubling.

A window of ``window`` consecutive words is removed where its word sequence also starts in a document with a
smaller doc_id. Windows of half that length are counted first, and only those repeated across documents are
extended to twice their length:

1. Half windows. Of all half windows inside a window the one with the smallest hash (the first of equals) is
   its anchor. Equal windows have equal anchors, so counting anchors only, some two in 27 words, loses no
   repeated window. Consecutive windows with one anchor are a stretch. Anchors of one document alone go.
2. Whole windows, a stretch at a time. Stretches of the same words are a class, and hold the same windows: all
   but the occurrences in the class's first document are removed whole. If an anchor has but one class, its
   windows stand nowhere else and no candidate survives.
3. Where an anchor has several classes, windows of each class's first occurrence are compared one by one,
   which settles what the classes share.

What is shuffled are hashes: a window is named by 128 bits (an anchor and its stretch by 64 each). Counts are
combined in the tasks, so a passage in a third of all documents is sent once a task, and joins on hot hashes are
sort-merge joins that adaptive execution splits. The texts are shuffled once, to meet what was decided.

Defined cases: null text has no words; a text of fewer words than a window loses none; windows of one
document, or of rows that share a doc_id, do not remove each other; a null doc_id counts as 2**63 - 1; rows with
equal doc_id and text get equal results; very long texts are read whole; an empty table gives an empty one;
extra columns stay, but columns called n_words and n_removed are replaced by the result's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import Scratch, fresh

WINDOW = 50
LAST_ID = (1 << 63) - 1
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


class Words:
    """Words of a run of documents; document d owns words first[d]:first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = bt.NONSPACE[data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]  # words end with their document
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        self.data, self.start, self.end = data, np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._sums: list[tuple[np.ndarray, np.ndarray]] = []

    def runs(self, start: np.ndarray, length: np.ndarray | int, family: int = 0) -> np.ndarray:
        """Hashes of the word sequences of ``length`` from ``start``."""
        n, one = len(self.start), _U(1)
        with np.errstate(over="ignore"):
            if not self._sums:
                h = bt.span_hash(self.data, self.start, self.end)
                for i, base in enumerate(_BASES):
                    up, down = (np.multiply.accumulate(np.concatenate([[one], np.full(n, b, _U)])) for b in (base, _U(pow(int(base), -1, 1 << 64))))
                    sums = np.zeros(n + 1, _U)
                    np.cumsum((bt.mix(h + _U(i)) | one) * up[:n], out=sums[1:])
                    self._sums.append((sums, down))
            sums, down = self._sums[family]
            return bt.mix((sums[start + length] - sums[start]) * down[start] + _U(length) if np.isscalar(length) else (sums[start + length] - sums[start]) * down[start] + length.astype(_U))


def stretches(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[Words, dict[str, np.ndarray]]:
    """The words, and runs of windows with one anchor: owner, number in the document, first and last window (word they start at), hashes of anchor and words."""
    words = Words(data, offsets)
    half = (window + 1) // 2
    n = len(words.start) - window + 1
    at = np.zeros(0, np.int64)
    if n > 0:
        at = np.arange(n)[words.doc[:n] == words.doc[window - 1 :]]
    if not len(at):
        none = np.zeros(0, np.int64)
        return words, {"doc": none, "no": none, "from": none, "to": none, "anchor": none, "stretch": none}
    halves = words.runs(np.arange(len(words.start) - half + 1), half)
    anchor = at + np.argmin(sliding_window_view(halves, window - half + 1)[at], axis=1)
    opens = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (words.doc[at[1:]] != words.doc[at[:-1]])))
    start, stop = at[opens], at[np.append(opens[1:], len(at)) - 1]
    owner = words.doc[start]
    before = np.searchsorted(owner, np.arange(len(offsets)))
    return words, {
        "doc": owner, "no": np.arange(len(start)) - before[owner], "from": start, "to": stop,
        "anchor": halves[anchor[opens]].view(np.int64), "stretch": words.runs(start, stop + window - start).view(np.int64),
    }


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """For each row, the first row with the same keys."""
    order = np.lexsort(keys[::-1])
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    return out


def _anchors(window: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors with the smallest and largest document of the chunk that hold them."""
        for batch in batches:
            ids = batch.column("d").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in bt.chunks(batch.column("text")):
                _, s = stretches(data, offsets, window)
                owner = ids[lo + s["doc"]]
                order = np.lexsort((owner, s["anchor"]))
                a, d = s["anchor"][order], owner[order]
                first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(a)) - 1 if len(a) else first
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(d[first]), pa.array(d[last])], ["anchor", "lo", "hi"])

    return kernel


def _places(window: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's different stretches."""
        for batch in batches:
            for lo, _, data, offsets in bt.chunks(batch.column("text")):
                _, s = stretches(data, offsets, window)
                use = _first_of(s["doc"], s["anchor"], s["stretch"]) == np.arange(len(s["doc"]))
                rows = pa.array(lo + s["doc"][use])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["anchor"][use]), pa.array(s["stretch"][use]), batch.column("d").take(rows), batch.column("key").take(rows), pa.array(s["no"][use].astype(np.int32))],
                    ["anchor", "stretch", "d", "key", "no"],
                )

    return kernel


def _chosen(s: dict[str, np.ndarray], lists: pa.Array, n_docs: int) -> np.ndarray:
    """Which stretches are listed, by number, or equal a listed one of their document."""
    before = np.searchsorted(s["doc"], np.arange(n_docs))
    owner = np.repeat(np.arange(n_docs), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    listed = np.zeros(len(s["doc"]), bool)
    listed[before[owner] + lists.flatten().to_numpy(zero_copy_only=False)] = True
    return listed[_first_of(s["doc"], s["anchor"], s["stretch"])]


def _windows(window: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of the stretches in list ``open``, ``at`` being the word of the document they start with."""
        for batch in batches:
            asked = batch.column("open")
            for lo, hi, data, offsets in bt.chunks(batch.column("text")):
                words, s = stretches(data, offsets, window)
                use = _chosen(s, asked.slice(lo, hi - lo), hi - lo)
                many = (s["to"] - s["from"] + 1)[use]
                at = np.repeat(s["from"][use], many) + bt.runs(many)
                rows = pa.array(lo + words.doc[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.runs(at, window, f).view(np.int64)) for f in (0, 1)]
                    + [batch.column("d").take(rows), batch.column("key").take(rows), pa.array((at - words.first[words.doc[at]]).astype(np.int32))],
                    ["w1", "w2", "d", "key", "at"],
                )

    return kernel


def _kept(window: int):
    def kernel(text: pa.Array, whole: pa.Array, single: pa.Array) -> pa.Array:
        """Words left when stretches ``whole`` and windows ``single`` are gone, joined by spaces."""
        parts = []
        for lo, hi, data, offsets in bt.chunks(text):
            words, s = stretches(data, offsets, window)
            use = _chosen(s, whole.slice(lo, hi - lo), hi - lo)
            some = single.slice(lo, hi - lo)
            at = words.first[np.repeat(np.arange(hi - lo), some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))] + some.flatten().to_numpy(zero_copy_only=False)
            edges = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edges, np.concatenate([s["from"][use], at]), 1)
            np.add.at(edges, np.concatenate([s["to"][use], at]) + window, -1)
            stay = np.cumsum(edges[:-1]) == 0
            doc, start, end = words.doc[stay], words.start[stay], words.end[stay]
            # A space goes before each kept word but a document's first.
            spaced = np.append(False, doc[1:] == doc[:-1]).astype(np.int64)[: len(doc)]
            size = end - start + spaced
            out = np.full(int(size.sum()), 0x20, np.uint8)
            place = np.cumsum(size) - (end - start)
            step = bt.runs(end - start)
            out[np.repeat(place, end - start) + step] = data[np.repeat(start, end - start) + step]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, size, hi - lo).astype(np.int64))])
            kept = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(bounds), pa.py_buffer(out)]).cast(pa.string())
            n = np.diff(words.first)
            parts.append(pa.StructArray.from_arrays([pa.array(n), pa.array(n - np.bincount(doc, minlength=hi - lo)), kept], ["n_words", "n_removed", "kept"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return kernel


def repeated_windows(texts: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(d, key, whole, single) of texts (d, key, text): stretches, by number, and windows, by first word, that stand in an earlier document."""
    lean = texts.select("d", "key", "text")
    counted = lean.select("d", "text").mapInArrow(_anchors(window), "anchor long, lo long, hi long").groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    repeated = scratch.save(counted.where("lo < hi").select("anchor"))
    # Merge joins at every size: adaptive execution can split the hot keys of these.
    places = scratch.save(lean.mapInArrow(_places(window), "anchor long, stretch long, d long, key long, no int").join(repeated.hint("merge"), "anchor"))
    classes = scratch.save(places.groupBy("anchor", "stretch").agg(F.min("d").alias("first"), F.max("d").alias("last")))
    several = classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("open"))
    judged = classes.join(several.hint("merge"), "anchor", "left").where("open OR first < last").drop("last")
    judged = places.join(judged.hint("merge"), ["anchor", "stretch"]).where("d > first OR open")
    whole = F.col("d") > F.col("first")
    return scratch.save(judged.groupBy("d", "key").agg(F.collect_set(F.when(whole, F.col("no"))).alias("whole"), F.collect_set(F.when(~whole, F.col("no"))).alias("open")))


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words left in ``text``, joined by one space, and n_words and n_removed; null text stays null."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs = docs.drop("n_words", "n_removed")
    d, key, kept = fresh(docs, "substring_d", "substring_key", "substring_kept")
    identity = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = docs.select(identity[0].alias("d"), identity[1].alias("key"), "text")
    decided = repeated_windows(texts, window, scratch)
    asked = texts.join(decided.where(F.size("open") > 0).select("d", "key", "open").hint("merge"), ["d", "key"])
    windows = scratch.save(asked.mapInArrow(_windows(window), "w1 long, w2 long, d long, key long, at int"))
    earliest = windows.groupBy("w1", "w2").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").drop("last")
    single = windows.join(earliest.hint("merge"), ["w1", "w2"]).where("d > first").groupBy("d", "key").agg(F.collect_set("at").alias("single"))
    cuts = decided.select("d", "key", "whole").join(single.hint("merge"), ["d", "key"], "left").toDF(d, key, "whole", "single")
    whole_, single_ = fresh(docs, "substring_whole", "substring_single")
    joined = docs.withColumns({d: identity[0], key: identity[1]}).join(cuts.toDF(d, key, whole_, single_).hint("merge"), [d, key], "left")
    out = joined.withColumn(kept, F.arrow_udf(_kept(window), "struct<n_words:long,n_removed:long,kept:string>")("text", whole_, single_))
    return out.select(
        *(F.when(F.col("text").isNotNull(), F.col(f"{kept}.kept")).alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.col(f"{kept}.n_words").alias("n_words"), F.col(f"{kept}.n_removed").alias("n_removed"),
    )
