"""Corpus clean-up, chunking and sentence tables.

Functions take a frame with an id column (``doc_id`` unless named) and ``text``; null text counts as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that count as empty, compared without case. Fixed values.
EMPTY_WORDS = ("null", "none", "nan", "-")


def strip(c: Column) -> Column:
    """White space removed at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(c, r"\s+", -1), lambda w: w != "")


def normalise_space(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def is_empty(c: Column) -> Column:
    bare = F.lower(strip(F.coalesce(c, F.lit(""))))
    return (bare == "") | bare.isin(*EMPTY_WORDS)


def clean_corpus(docs: DataFrame) -> DataFrame:
    """Documents equal after white-space clean-up, as one row: smallest doc_id, text, copies."""
    clean = docs.select("doc_id", normalise_space(F.col("text")).alias("text"))
    return (
        clean.groupBy(F.sha2("text", 256).alias("key"))
        .agg(F.min(F.struct("doc_id", "text")).alias("m"), F.count("*").alias("copies"))
        .select("m.doc_id", "m.text", "copies")
    )


def drop_empty(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with content, counts by source: n_total, n_dropped)."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n_total"), F.count_if(is_empty(F.col("text"))).alias("n_dropped"))
    return docs.where(~is_empty(F.col("text"))), counts


def token_budget(docs: DataFrame, by: list[str]) -> DataFrame:
    """Estimated tokens, a quarter of each text's characters rounded down, summed by ``by``."""
    return docs.groupBy(*by).agg(F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).alias("tokens"), F.count("*").alias("n_docs"))


def assign_source_ids(docs: DataFrame, prefix: str = "kp_") -> tuple[DataFrame, DataFrame]:
    """(rows with a content-derived source_id where it is missing, ids given to different contents)."""
    made = F.concat(F.lit(prefix), F.substring(F.sha2(F.coalesce("content", F.lit("")), 256), 1, 12))
    out = docs.withColumn("source_id", F.coalesce("source_id", made))
    clashes = out.groupBy("source_id").agg(F.countDistinct(F.sha2(F.coalesce("content", F.lit("")), 256)).alias("contents")).where("contents > 1")
    return out, clashes


def sentence_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence): texts split after ``.``, ``!`` or ``?`` and white space, terminators removed."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), r"[.!?]\s+", -1), strip)
    return docs.select("doc_id", F.posexplode(F.filter(parts, lambda s: s != "")).alias("pos", "sentence"))


def chunk_fixed(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Fixed-step chunks: chunk_id, doc_id, chunk_index, char_start, char_end, content.

    Pieces start every ``size - overlap`` characters; one that does not reach the end of its text is cut
    after its first sentence end past the middle, else before its first white space there. Blank texts
    have no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    half, text = size // 2, F.col("text")
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    pieces = (
        docs.where(strip(F.coalesce("text", F.lit(""))) != "")
        .select("doc_id", "text", F.posexplode(starts).alias("chunk_index", "char_start"))
        .select("doc_id", "chunk_index", "char_start", F.expr(f"substring(text, char_start + 1, {size})").alias("piece"), (F.col("char_start") + size < F.length(text)).alias("inner"))
    )
    tail = F.expr(f"substring(piece, {half + 1})")
    sentence = F.length(F.regexp_extract(tail, r"(?s)^(.*?[.!?。！？]\s+)", 1))
    word = F.length(F.regexp_extract(tail, r"(?s)^(.*?)\s", 1))
    keep = F.when(~F.col("inner"), F.length("piece")).when(sentence > 0, half + sentence).when(tail.rlike(r"\s"), half + word).otherwise(F.length("piece"))
    cut = pieces.withColumn("kept", keep)
    return cut.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "char_start",
        (F.col("char_start") + F.col("kept")).alias("char_end"), strip(F.expr("substring(piece, 1, kept)")).alias("content"),
    )


def _packed(sentences: list[str], size: int, overlap: int) -> list[str]:
    done, opened, n = [], [], 0
    for s in sentences:
        if n + len(s) > size and opened:
            done.append(" ".join(opened))
            kept, n = [], 0
            for t in reversed(opened):
                if n + len(t) > overlap:
                    break
                kept.append(t)
                n += len(t) + 1
            opened = kept[::-1]
        opened.append(s)
        n += len(s) + 1
    return [*done, " ".join(opened)]


def chunk_sentences(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, content): sentences packed greedily up to ``size`` characters; a new chunk
    starts with the sentences that ended the last one, as far as they fit ``overlap``. One pass a document."""

    def pack(lists: pd.Series) -> pd.Series:
        return pd.Series([_packed(list(x), size, overlap) for x in lists])

    sentences = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+", -1)
    return docs.select("doc_id", F.posexplode(F.pandas_udf(pack, "array<string>")(sentences)).alias("chunk_index", "content"))
