"""Benchmark decontamination by an FM-index for each shard of training documents.

A shard is the documents of one task, up to a bounded number of words. Words outside the benchmark's
vocabulary can be in no occurrence, so they separate segments; the FM-index covers every other word:
suffix array by prefix doubling, BWT in a wavelet matrix, sampled suffix positions. All phrases are
searched backward at once, occurrences located by walking to the next sample, and overlapping occurrences
merged into removal spans.

Documents are read once and never shuffled. The benchmark is the stated query set: it goes to the
tasks in blocks of about BLOCK_BYTES; beyond one block each block makes its own pass and the passes'
hits are merged by document.

Defined cases: null or wordless documents have no words and are clean; items without words match
nothing; item ids may be of any type and are listed as strings; a repeated item_id counts once and
repeated items are one; items with a null id hit but are not listed; repeated rows each get their row, as
do rows with a null or shared doc_id; long texts are searched whole; no documents or no items give no
hits; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import Scratch, row_key, without

WINDOW = 13
BLOCK_BYTES = 2 << 20
#: Symbols after which a shard's index is built, and documents it may wait for.
SHARD_SYMBOLS = 1 << 19
SHARD_DOCS = 20_000
SAMPLE = 32


class Phrases:
    """Windows of a block of items as rows of vocabulary ids (1-based, padded with 0)."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        data, offsets = bt.text_buffers(pa.array([t for _, t in items], pa.string()))
        w = bt.words(data, offsets, bt.ALNUM)
        self.hash, at, code = np.unique(w.hash, return_index=True, return_inverse=True)
        low = bt.LOWER[data]
        lengths = (w.end - w.start)[at]
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = low[np.repeat(w.start[at], lengths) + bt.runs(lengths)]
        n = np.diff(w.first)
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        owner = np.repeat(np.arange(len(items)), count)
        start = np.repeat(w.first[:-1], count) + bt.runs(count)
        length = size[owner]
        rows = np.zeros((len(start), window), np.int32)
        for j in range(window):
            has = length > j
            rows[has, j] = code[start[has] + j] + 1
        self.rows, inverse = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.length = (self.rows > 0).sum(axis=1)
        pairs = np.unique(np.stack([inverse.reshape(-1), owner], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.item_of = pairs[:, 1]
        self.item_first = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.items = [i for i, _ in items]

    def codes(self, w: bt.Words) -> np.ndarray:
        """Vocabulary id of each word, 0 for others; equal hashes are confirmed byte by byte."""
        out = np.zeros(len(w.hash), np.int32)
        if not len(self.hash):
            return out
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        hit = np.flatnonzero((self.hash[at] == w.hash) & (np.diff(self.first)[at] == w.end - w.start))
        lengths = (w.end - w.start)[hit]
        step = bt.runs(lengths)
        same = bt.LOWER[w.data[np.repeat(w.start[hit], lengths) + step]] == self.bytes[np.repeat(self.first[at[hit]], lengths) + step]
        wrong = np.unique(np.repeat(hit, lengths)[~same])
        out[hit] = at[hit] + 1
        out[wrong] = 0
        return out


class WaveletMatrix:
    """Rank and access over an integer sequence, one bit plane per level."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        s = sequence
        for b in reversed(range(self.levels)):
            bit = (s >> b) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((c >> (self.levels - 1 - level)) & 1).astype(bool)
            a, b = ones[lo], ones[i]
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[i + 1] - ones[i]
            c = c * 2 + one
            i = np.where(one > 0, zeros + ones[i], i - ones[i])
        return c


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of segments that each end in 0, every 0 being a smaller letter the earlier it stands."""
    stop = text == 0
    rank = np.where(stop, np.cumsum(stop) - 1, text + int(stop.sum()))
    n, k = len(text), 1
    _, rank = np.unique(rank, return_inverse=True)
    while n:
        ahead = np.zeros(n, np.int64)
        if k < n:
            ahead[: n - k] = rank[k:] + 1
        key = rank.astype(np.int64) * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2
    return np.zeros(0, np.int64)


class FmIndex:
    """Backward search and locate over a shard's segments."""

    def __init__(self, text: np.ndarray, top: int):
        sa = suffix_array(text)
        before = text[sa - 1]
        before[sa == 0] = 0
        self.bwt = WaveletMatrix(before, top)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.sampled = (sa % SAMPLE == 0) | (before == 0)
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of every phrase."""
        lo, hi = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        last = rows[np.arange(len(rows)), length - 1]
        lo[:], hi[:] = self.less[last], self.less[last + 1]
        for back in range(1, int(length.max(initial=0))):
            live = np.flatnonzero((length > back) & (lo < hi))
            if not len(live):
                break
            c = rows[live, length[live] - 1 - back].astype(np.int64)
            lo[live] = self.less[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.less[c] + self.bwt.rank(c, hi[live])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text position of suffix-array rows."""
        row, out = row.copy(), np.zeros(len(row), np.int64)
        live = np.arange(len(row))
        while len(live):
            done = self.sampled[row[live]]
            out[live[done]] += self.samples[self.sample_at[row[live[done]]]]
            live = live[~done]
            c = self.bwt.access(row[live])
            row[live] = self.less[c] + self.bwt.rank(c, row[live])
            out[live] += 1
        return out


class _Shard:
    """Documents waiting for an index: their word counts, and their segments of vocabulary words."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.ids, self.n_words = phrases, [], []
        self.text, self.doc, self.word, self.char = [], [], [], []
        self.symbols = self.docs = 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        w = bt.words(data, offsets, bt.ALNUM)
        n = np.diff(w.first)
        owner = np.repeat(np.arange(len(n)), n)
        code = self.phrases.codes(w)
        # segments: runs of vocabulary words inside one document
        known = code > 0
        opens = known.copy()
        opens[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
        segment = np.cumsum(opens) - 1
        keep = np.flatnonzero(known)
        if len(keep):
            last = np.append(segment[keep[1:]] != segment[keep[:-1]], True)
            at = np.cumsum(last) - last + np.arange(len(keep))
            text = np.zeros(len(keep) + int(last.sum()), np.int64)
            text[at] = code[keep]
            place = np.full(len(text), -1, np.int64)
            place[at] = keep
            points = bt.code_points(data)
            base = points[offsets[owner[keep]]]
            chars = np.zeros((len(text), 2), np.int64)
            chars[at, 0] = points[w.start[keep]] - base
            chars[at, 1] = points[w.end[keep]] - base
            doc, word = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
            doc[at] = owner[keep] + self.docs
            word[at] = keep - w.first[owner[keep]]
            for to, part in ((self.text, text), (self.doc, doc), (self.word, word), (self.char, chars)):
                to.append(part)
            self.symbols += len(text)
        self.ids.append(ids)
        self.n_words.append(n)
        self.docs += len(n)

    def full(self) -> bool:
        return self.symbols >= SHARD_SYMBOLS or self.docs >= SHARD_DOCS

    def flush(self) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        n_words = np.concatenate(self.n_words).astype(np.int64)
        hits = [np.zeros(0, np.int64)] * 3
        hit_first = np.zeros(self.docs + 1, np.int64)
        item_first, item_ids = hit_first, []
        if self.symbols:
            text, doc, word, char = (np.concatenate(x) for x in (self.text, self.doc, self.word, self.char))
            p = self.phrases
            index = FmIndex(text, len(p.hash))
            lo, hi = index.search(p.rows, p.length)
            phrase = np.repeat(np.arange(len(lo)), np.maximum(hi - lo, 0))
            many = np.maximum(hi - lo, 0)
            at = index.locate(np.repeat(lo, many) + bt.runs(many))
            length = p.length[phrase]
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            covered = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            hit_first = np.searchsorted(doc[covered], np.arange(self.docs + 1))
            hits = [word[covered], char[covered, 0], char[covered, 1]]
            items = np.repeat(phrase, np.diff(p.item_first)[phrase])
            owners = np.repeat(doc[at], np.diff(p.item_first)[phrase])
            items = p.item_of[p.item_first[items] + bt.runs(np.diff(p.item_first)[phrase])]
            pairs = np.unique(np.stack([owners, items], 1), axis=0)
            pairs = pairs[[p.items[i] is not None for i in pairs[:, 1]]] if len(pairs) else pairs
            item_first = np.searchsorted(pairs[:, 0], np.arange(self.docs + 1))
            item_ids = [p.items[i] for i in pairs[:, 1]]
        self.__init__(self.phrases)
        struct = pa.StructArray.from_arrays([pa.array(h, pa.int64()) for h in hits], ["word", "start", "end"])
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n_words), pa.ListArray.from_arrays(pa.array(hit_first, pa.int32()), struct),
             pa.ListArray.from_arrays(pa.array(item_first, pa.int32()), pa.array(item_ids, pa.string()))],
            ["doc_id", "n_words", "hits", "items"],
        )


def _scan(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(broadcast.value)
        for batch in batches:
            for lo, hi, data, offsets in bt.chunks(batch.column("text")):
                shard.add(batch.column("doc_id").slice(lo, hi - lo), data, offsets)
                if shard.full():
                    yield shard.flush()
        if shard.docs:
            yield shard.flush()

    return run


_SCHEMA = "doc_id long, n_words long, hits array<struct<word: bigint, start: bigint, end: bigint>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids with occurrences), spans (merged runs of
    hit words: word range and code-point range to remove), contaminated (hit words are 5 % or more)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch, passes = Scratch(spark, "decontaminate"), []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.collect()], window))  # about block_bytes of benchmark text
        if blocks > 1:
            passes.append(scratch.save(texts.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).mapInArrow(_scan_keyed(phrases), _SCHEMA + ", sha string")))
            phrases.unpersist()
    found = texts.mapInArrow(_scan(phrases), _SCHEMA) if blocks == 1 else _merge_passes(passes)
    joined = F.aggregate(
        F.array_sort("hits"),
        F.expr("cast(array() as array<struct<word: bigint, last: bigint, start: bigint, end: bigint>>)"),
        lambda acc, h: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] + 1 == h["word"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["word"].alias("word"), h["word"].alias("last"), F.element_at(acc, -1)["start"].alias("start"), h["end"].alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(h["word"].alias("word"), h["word"].alias("last"), h["start"].alias("start"), h["end"].alias("end"))))),
    )
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.array_distinct("items").alias("items"), joined.alias("spans"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _merge_passes(passes: list[DataFrame]) -> DataFrame:
    """Hits of all passes by document; rows repeated with the same id and text have the same hits."""
    union = passes[0]
    for one in passes[1:]:
        union = union.unionByName(one)
    return (
        union.groupBy("doc_id", "sha")
        .agg(
            F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count("*") / len(passes)).cast("long").alias("m"),
        )
        .withColumn("copy", F.explode(F.expr("sequence(1L, m)")))
        .select("doc_id", "n_words", "hits", "items")
    )


def _scan_keyed(broadcast):
    scan = _scan(broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one shard per batch keeps rows and keys aligned
            out = pa.Table.from_batches(list(scan(iter([batch])))).combine_chunks()
            sha = batch.column("sha").cast(pa.string())
            yield from out.append_column("sha", sha).to_batches()

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, columns unchanged; each row is judged by its own text,
    also where ids are null or shared."""
    scratch = Scratch(docs.sparkSession, "decontaminate-drop")
    keyed = docs.select(row_key().alias("doc_id"), "text")
    return without(docs, scratch.save(contamination(keyed, benchmark).where("contaminated").select("doc_id")))
