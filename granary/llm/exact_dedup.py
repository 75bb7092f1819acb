"""Exact duplicates by deterministic block naming.

Texts are cut into fixed-size blocks. The distinct blocks are sorted and numbered; then adjacent
names are paired and the distinct pairs sorted and numbered, level by level, until each document is
one integer. Two documents get the same (level, name) if and only if their texts are equal: the
numbers stand for compared texts and pairs, never for hashes.

The text is shuffled once, as distinct blocks (combined on the map side, so a hot block is sent once
per task). References to blocks travel as 64-bit keys; blocks whose keys collide are named by a
second join on the block itself.

Defined cases: null text counts as empty, and empty texts are equal; a null doc_id is a document of
its own and never wins over another id; rows repeated with the same doc_id and text all come back and
count in group_size, but one of them at most is kept; so is one of a group of null ids only; texts of any
length are compared whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

BLOCK_CHARS = 4096


def _numbered(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Distinct ``rows`` with an integer name by their order inside hash partitions."""
    return scratch.save(
        rows.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    )


def _name_blocks(cut: DataFrame, refs: DataFrame, scratch: Scratch) -> DataFrame:
    named = scratch.save(
        cut.select("h", "block").distinct().sortWithinPartitions("block")
        .select("h", F.monotonically_increasing_id().alias("name"))
    )
    shared = named.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    if shared.isEmpty():
        return refs.join(named, "h").drop("h")
    shared = scratch.save(shared)
    doubtful = cut.join(shared, "h", "left_semi")
    exact = scratch.save(
        doubtful.select("h", "block").distinct().sortWithinPartitions("block")
        .select("h", "block", (-1 - F.monotonically_increasing_id()).alias("name"))
    )
    keys = ["id", "sha", "pos", "n"]
    again = doubtful.join(exact, ["h", "block"]).groupBy(*keys, "name").agg(F.count("*").alias("m"))
    plain = refs.join(shared, "h", "left_anti").join(named, "h")
    return plain.select(*keys, "m", "name").unionByName(again.select(*keys, "m", "name"))


def identities(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS,
    normalise=lambda c: c, block_key=F.xxhash64,
) -> DataFrame:
    """(id, sha, m, level, name): one row per distinct (id, text) with its multiplicity and identity."""
    text: Column = normalise(F.coalesce(F.col(text_col), F.lit("")))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .select("id", F.unhex(F.sha2("text", 256)).alias("sha"), F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(pieces).alias("b"))
        .select("id", "sha", F.size("b").alias("n"), F.posexplode("b").alias("pos", "block"))
        .withColumn("h", block_key("block"))
    )
    refs = cut.groupBy("id", "sha", "pos", "n", "h").agg(F.count("*").alias("m"))
    state = scratch.save(_name_blocks(cut, refs, scratch))
    longest = state.agg(F.max("n")).first()[0] or 1
    level, done = 0, []
    while True:
        done.append(state.where("n = 1").select("id", "sha", "m", F.lit(level).alias("level"), "name"))
        if longest == 1:
            break
        pairs = (
            state.where("n > 1").withColumn("odd", F.expr("pos % 2"))
            .groupBy("id", "sha", "n", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max("m").alias("m"),
                F.max(F.when(F.col("odd") == 0, F.col("name"))).alias("l"),
                F.max(F.when(F.col("odd") == 1, F.col("name"))).alias("r"),
                F.max("odd").alias("paired"),
            )
        )
        pairs = scratch.save(pairs.withColumn("r", F.coalesce("r", F.lit(0))))
        names = _numbered(pairs, ["l", "r", "paired"], scratch)
        nxt = scratch.save(
            pairs.join(names, ["l", "r", "paired"])
            .select("id", "sha", "pos", F.ceil(F.col("n") / 2).cast("int").alias("n"), "m", "name")
        )
        scratch.free(pairs)
        state, level, longest = nxt, level + 1, (longest + 1) // 2
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, **how) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays (``keep_id``); of such rows repeated, one.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    ids = scratch.save(identities(docs, scratch, id_col, text_col, block_chars, **how))
    groups = scratch.save(ids.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("m").alias("group_size")))
    return (
        ids.join(groups, ["level", "name"])
        .withColumn("copy", F.explode(F.expr("sequence(1L, m)")))
        .select(
            F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``documents`` with one row for each distinct text, columns unchanged; of rows that repeat the id and
    text that stay, any one."""
    scratch = Scratch(docs.sparkSession, "exact-drop")
    best = exact_dedup(docs).where("doc_id <=> keep_id")
    best = scratch.save(best.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows")))
    sha, best_id, best_sha = fresh(docs, "text_sha", "best_id", "best_sha")
    v = best.select(F.col("doc_id").alias(best_id), F.col("text_sha256").alias(best_sha))
    texts = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    kept = texts.join(v, F.col("doc_id").eqNullSafe(F.col(best_id)) & (F.col(sha) == F.col(best_sha)), "left_semi")
    if not best.where("rows > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", sha])
    return kept.drop(sha)
