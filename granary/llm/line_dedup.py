"""Repeated line passages by a rolling hash over lines.

Each document's lines are hashed, a line being a sentence where a line of text holds several, so that a
passage pasted into the middle of a line is seen too. A rolling hash runs over ROLL consecutive lines with
words. Every window is a chunk, as is every line of LONG_WORDS words or more on its own, so chunks depend on
their own lines only and no repeated run of ROLL lines is missed for where its boundaries fall. Chunks that
occur more than once in the corpus are removed everywhere but at their first occurrence (smallest doc_id,
then position), after their bytes have been compared. Overlapping and adjacent chunks grow into one passage,
line by line, as far as the copies agree; every removed line stands in an earlier place that is kept.

A passage then grows beyond its lines: as many words of the line before it and of the line after it go as
agree with what stands beside the first occurrence, where a run of repeated chunks ends in both places; so a
passage pasted into the middle of a sentence goes whole. Every removed stretch stands in an earlier place
that is kept.

Chunk counts are combined in the tasks before they are shuffled, so a passage shared by a third of the
documents is sent once per task. Chunks travel as hashes and numbers; their bytes only where the hash is
repeated. Whole texts move twice, to spell those chunks and to cut the documents; a hot chunk's rows are
spread by adaptive skew handling and its texts combine on the map side.

Defined cases: null text has no lines and stays null, empty text stays empty; lines without words count for
no window, but those inside a passage go with it; rows with equal doc_id and text are one document and keep
the same text; a null doc_id sorts first; long texts are read whole; an empty table gives an empty one;
extra columns are kept, but columns called removed_chunks, removed_lines and removed_chars are replaced by
the result's own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import Scratch, fresh

ROLL = 2
LONG_WORDS = 50
_NEWLINE = 10
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F]] = True
_U = np.uint64


def line_chunks(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Chunks of a run of documents: doc, no, first and last line, start and end byte, hash; document d owns chunks first[d]:first[d+1]."""
    n_docs, n = len(offsets) - 1, len(data)
    ends = data == _NEWLINE  # what closes a line: a line feed, or the space after a sentence
    ends[1:] |= (data[1:] == 0x20) & _STOP[data[:-1]]
    ends[offsets[:-1][offsets[:-1] < n]] = data[offsets[:-1][offsets[:-1] < n]] == _NEWLINE
    breaks = np.flatnonzero(ends)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n_docs), owner])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[last] = offsets[1:]
    # word counts, and hashes of lines and of what separates those with words
    filled = end > start
    is_word = bt.NONSPACE[data]
    opens = np.zeros(n + 1, np.int64)
    if n:
        begin = is_word.copy()
        begin[1:] &= ~is_word[:-1]
        np.cumsum(begin, out=opens[1:])
    words = opens[end] - opens[start]
    words += (filled & (start > 0) & is_word[np.minimum(start, max(n - 1, 0))] & is_word[np.maximum(start, 1) - 1]) if n else 0
    full = np.flatnonzero(words > 0)
    within = doc[full[1:]] == doc[full[:-1]]
    h = bt.span_hash(data, np.concatenate([start, np.where(within, end[full[:-1]], 0)]), np.concatenate([end, np.where(within, start[full[1:]], 0)]))
    h, gap = h[: len(start)], h[len(start) :]
    alone = np.flatnonzero(words >= LONG_WORDS)
    n_windows = max(len(full) - ROLL + 1, 0)
    with np.errstate(over="ignore"):
        rolled = h[full[:n_windows]]
        for i in range(1, ROLL):
            rolled = bt.mix(bt.mix(rolled * _U(0x9E3779B97F4A7C15) + gap[i - 1 : i - 1 + n_windows]) + h[full[i : i + n_windows]])
    head, tail = full[:n_windows], full[ROLL - 1 :][:n_windows]
    inside = doc[head] == doc[tail]
    head, tail = np.concatenate([head[inside], alone]), np.concatenate([tail[inside], alone])
    digest = np.concatenate([rolled[inside], h[alone]])
    order = np.lexsort((tail, head))
    head, tail, digest = head[order], tail[order], digest[order]
    first_line, first = np.searchsorted(doc, np.arange(n_docs)), np.searchsorted(doc[head], np.arange(n_docs + 1))
    owner = doc[head]
    return {
        "doc": owner, "no": np.arange(len(head)) - first[owner], "from": head - first_line[owner], "to": tail - first_line[owner],
        "start": start[head], "end": end[tail], "hash": digest, "first": first,
        "line_start": start, "line_end": end, "first_line": first_line, "line_doc": doc,
    }


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in bt.chunks(batch.column("text")):
            c = line_chunks(data, offsets)
            value, times = np.unique(c["hash"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], ["h", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, data, offsets in bt.chunks(batch.column("text")):
            c = line_chunks(data, offsets)
            rows = pa.array(c["doc"] + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("row_key").take(rows), pa.array(c["no"].astype(np.int32)), pa.array(c["hash"].view(np.int64))],
                ["doc_id", "row_key", "no", "h"],
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked = batch.column("nos")
        for lo, hi, data, offsets in bt.chunks(batch.column("text")):
            c = line_chunks(data, offsets)
            nos = asked.slice(lo, hi - lo)
            use = np.sort(nos.flatten().to_numpy() + np.repeat(c["first"][:-1], nos.value_lengths().to_numpy()))
            doc, start, end = c["doc"][use], c["start"][use], c["end"][use]
            rows = pa.array(doc + lo)
            raw = data.tobytes()
            points = bt.code_points(data)
            base = points[offsets[doc]]
            # Where a run of repeated chunks ends, the line beside it.
            gap = np.append(True, (doc[1:] != doc[:-1]) | (c["from"][use][1:] > c["to"][use][:-1] + 1)) if len(use) else np.zeros(0, bool)
            head, tail = c["first_line"][doc] + c["from"][use], c["first_line"][doc] + c["to"][use]
            left = gap & (c["from"][use] > 0)
            right = np.append(gap[1:], True)[: len(use)] & (end < offsets[doc + 1])
            before, after = c["line_start"][np.maximum(head - 1, 0)], c["line_end"][np.minimum(tail + 1, len(c["line_end"]) - 1)]

            def spell(s: np.ndarray, e: np.ndarray, which: np.ndarray, raw: bytes = raw) -> pa.Array:
                return pa.array([raw[i:j] if w else None for i, j, w in zip(s.tolist(), e.tolist(), which.tolist(), strict=True)], pa.binary())

            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("row_key").take(rows), pa.array(c["no"][use]), pa.array(c["from"][use]), pa.array(c["to"][use]),
                 pa.array(points[start] - base), pa.array(points[end] - base), pa.array(c["hash"][use].view(np.int64)),
                 spell(start, end, np.ones(len(use), bool)), spell(before, start, left), spell(end, after, right)],
                ["doc_id", "row_key", "no", "from", "to", "start", "end", "h", "chunk", "before", "after"],
            )


def _common_start(a: bytes, b: bytes) -> bytes:
    """What both begin with, in whole words."""
    n = len(os.path.commonprefix([a, b]))
    if all(n == len(x) or x[n : n + 1].isspace() for x in (a, b)):
        return a[:n]
    return a[: max(0, *(a.rfind(s, 0, n) for s in (b" ", b"\t", b"\n", b"\r")))]


def _grown(before: pd.Series, first_before: pd.Series, after: pd.Series, first_after: pd.Series) -> pd.DataFrame:
    """Code points that a copy grows by to either side."""
    left = [_common_start(a[::-1], b[::-1])[::-1] for a, b in zip(before, first_before, strict=True)]
    right = [_common_start(a, b) for a, b in zip(after, first_after, strict=True)]
    return pd.DataFrame({"start": [len(x.decode()) for x in left], "end": [len(x.decode()) for x in right]}, dtype="int64")


def _cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Texts without the spans; a cut takes the line feed or space that follows, at the end of the text the one before."""
    cut = []
    for i in np.flatnonzero(starts.is_valid().to_numpy(zero_copy_only=False)).tolist():
        t, parts, at = text[i].as_py(), [], 0
        for a, b in zip(starts[i].as_py(), ends[i].as_py(), strict=True):
            parts.append(t[at:a])
            at = b + t[b : b + 1].isspace()
        kept = "".join(parts)
        if b >= len(t) and kept[-1:].isspace():
            kept = kept[:-1]
        cut.append(kept + t[at:])
    return pc.replace_with_mask(text, starts.is_valid(), pa.array(cut, text.type))


def repeated_passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, row_key, lines, start, end): passages to remove, as code-point spans of the text that don't overlap."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    again = scratch.save(texts.select("text").mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    # Shuffled joins at every size: a broadcast below some size would only hide what the large run moves. Each
    # key stands once in the hinted table, so the many rows that it meets need no sort.
    places = scratch.save(texts.mapInArrow(_places, "doc_id long, row_key long, no int, h long").join(again.hint("shuffle_hash"), "h").drop("h"))
    asked = scratch.save(places.groupBy(F.col("doc_id").alias("asked_id"), F.col("row_key").alias("asked_key")).agg(F.collect_set("no").alias("nos"), F.count("*").alias("n")))
    repeated_rows = not asked.where(F.col("n") > F.size("nos")).isEmpty()
    asked = texts.join(asked.hint("shuffle_hash"), F.expr("doc_id <=> asked_id AND row_key = asked_key")).select("doc_id", "row_key", "text", "nos")
    spelled = scratch.save(asked.mapInArrow(_texts, "doc_id long, row_key long, no long, from long, to long, start long, end long, h long, chunk binary, before binary, after binary"))
    # Equal bytes, not just equal hashes, make a group; its first occurrence stays. Where all chunks of a hash
    # have the same bytes, its least and its greatest being equal, the hash stands for them from here on.
    place = F.min(F.struct("doc_id", "row_key", "no", "before", "after")).alias("first")
    by_hash = scratch.save(spelled.groupBy("h").agg(F.count("*").alias("times"), place, (F.min("chunk") != F.max("chunk")).alias("mixed")))
    firsts = by_hash.where("times > 1 AND NOT mixed").select("h", "first")
    copies = spelled.drop("chunk").join(firsts.hint("shuffle_hash"), "h")
    mixed = by_hash.where("mixed").select("h")
    if not mixed.isEmpty():
        doubtful = spelled.join(mixed.hint("merge"), "h")
        by_bytes = doubtful.groupBy("h", "chunk").agg(F.count("*").alias("times"), place).where("times > 1")
        copies = copies.unionByName(doubtful.join(by_bytes.drop("times").hint("merge"), ["h", "chunk"]).drop("chunk"))
    copies = copies.where("NOT (doc_id <=> first.doc_id AND row_key = first.row_key AND no = first.no)")
    left = F.when(F.col("before").isNotNull() & F.col("first.before").isNotNull(), F.struct("before", F.col("first.before").alias("first")))
    right = F.when(F.col("after").isNotNull() & F.col("first.after").isNotNull(), F.struct("after", F.col("first.after").alias("first")))
    copies = copies.select("doc_id", "row_key", "no", "from", "to", "start", "end", left.alias("left"), right.alias("right"))
    again = scratch.save(copies.distinct() if repeated_rows else copies)
    scratch.free(spelled)
    # Chunks of one document that overlap or touch are one passage. Neither end of a chunk lies before that of
    # the chunk before it, so a passage's first and last chunk tell its extent, and only they are grouped.
    order = Window.partitionBy("doc_id", "row_key").orderBy("no")
    opens = F.coalesce(F.col("from") > F.lag("to").over(order) + 1, F.lit(True))
    closes = F.coalesce(F.lead("from").over(order) > F.col("to") + 1, F.lit(True))
    ends = again.withColumns({"opens": opens.cast("long"), "closes": closes}).withColumn("passage", F.sum("opens").over(order))
    passages = ends.where("opens = 1 OR closes").groupBy("doc_id", "row_key", "passage").agg(
        F.min("from").alias("from"), F.max("to").alias("to"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min(F.struct("from", "no", "left")).alias("head"), F.max(F.struct("to", "no", "right")).alias("tail"),
    )
    sides = ("head.left.before", "head.left.first", "tail.right.after", "tail.right.first")
    grown = F.pandas_udf(_grown, "start long, end long")(*(F.coalesce(F.col(x), F.lit(b"")) for x in sides))
    whole = passages.withColumn("g", grown).select("doc_id", "row_key", "from", "to", (F.col("start") - F.col("g.start")).alias("start"), (F.col("end") + F.col("g.end")).alias("end"))
    # Passages that have grown together are one.
    order = Window.partitionBy("doc_id", "row_key").orderBy("start", "from")
    apart = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    one = whole.withColumn("opens", apart.cast("long")).withColumn("passage", F.sum("opens").over(order)).groupBy("doc_id", "row_key", "passage")
    return one.agg((F.max("to") - F.min("from") + 1).alias("lines"), F.min("start").alias("start"), F.max("end").alias("end")).drop("passage")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from text, and removed_chunks, removed_lines, removed_chars."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.drop("removed_chunks", "removed_lines", "removed_chars")
    passages = repeated_passages(docs.select("doc_id", "text"), scratch)
    cuts = passages.groupBy("doc_id", "row_key").agg(
        F.count("*").alias("removed_chunks"), F.sum("lines").alias("removed_lines"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")
    ).select("doc_id", "row_key", "removed_chunks", "removed_lines", "cuts.start", "cuts.end")
    cut_id, cut_key, chunks, lines, start, end, key, cut_text = fresh(docs, "cut_id", "cut_key", "cut_chunks", "cut_lines", "cut_start", "cut_end", "line_row_key", "cut_text")
    cuts = scratch.save(cuts.toDF(cut_id, cut_key, chunks, lines, start, end))
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col(cut_id)) & (F.col(key) == F.col(cut_key))
    joined = docs.withColumn(key, F.xxhash64(text)).join(cuts.hint("shuffle_hash"), same, "left")
    return joined.withColumn(cut_text, F.arrow_udf(_cut, "string")("text", start, end)).select(
        *(F.col(cut_text).alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.coalesce(chunks, F.lit(0)).alias("removed_chunks"), F.coalesce(lines, F.lit(0)).alias("removed_lines"),
        (F.length(text) - F.length(F.coalesce(cut_text, F.lit("")))).cast("long").alias("removed_chars"),
    )
