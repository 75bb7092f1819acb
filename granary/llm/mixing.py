"""Mixing sources to target weights by Poisson replication.

Each source's target mean repetition rate is its share of the wanted total over what it has. A
document's count is the quantile of a Poisson distribution with that mean at a uniform number seeded by
its doc_id, so any executor that recomputes it gets the same count. Documents are exploded by their
counts and shuffled globally: dealt to partitions and sorted there by a hash of (document, copy), which
puts every copy at an independent place.

Per-source statistics are one partial aggregate. They join the documents by broadcast when there are at
most MAX_BROADCAST_SOURCES of them; beyond that both sides are salted, so a source holding a third of
the rows is spread over SALTS tasks.

Defined cases: a null source is a source of its own; a null text has no characters; rows without text
still get counts; equal doc_ids get equal counts, so repeated rows do; a null doc_id is seeded by its
text; sources without mass or with weight 0 are not drawn; an empty table gives an empty one; extra
columns are kept, but columns called copy and shuffle_key are replaced by the result's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

#: Largest mean inverted at once; larger means are sums of independent pieces.
PIECE = 64.0
MAX_BROADCAST_SOURCES = 100_000
SALTS = 64


def _uniform(key: Column, seed: int, piece: Column) -> Column:
    """A number in (0, 1) with 52 bits of md5, the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key, piece.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float, size: Column) -> DataFrame:
    """(source, rate, pieces, cdf): mean repetition rate, and the distribution function of one piece.

    ``weights`` names target shares by source; without it a source's share is its mass to the power
    ``temperature``, normalised.
    """
    mass = docs.groupBy(F.col("source").alias("source")).agg(F.sum(size).cast("double").alias("mass")).where("mass > 0")
    if weights is None:
        share = mass.withColumn("w", F.pow("mass", F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "g string, w double")
        share = mass.join(F.broadcast(given), F.expr("source <=> g")).drop("g")
    total = share.agg(F.sum("mass").alias("all_mass"), F.sum("w").alias("all_w"))
    rate = share.crossJoin(F.broadcast(total)).select("source", (F.col("w") / F.col("all_w") * F.col("all_mass") / F.col("mass")).alias("rate"))
    cdf = """
        aggregate(sequence(1, cast(mean + 12 * sqrt(mean) + 40 as int)),
                  struct(exp(-mean) as p, array(exp(-mean)) as c),
                  (s, j) -> struct(s.p * mean / j as p, concat(s.c, array(element_at(s.c, -1) + s.p * mean / j)) as c),
                  s -> s.c)
    """
    return (
        rate.where("rate > 0").withColumn("pieces", F.ceil(F.col("rate") / PIECE).cast("int"))
        .withColumn("mean", F.col("rate") / F.col("pieces"))
        .select("source", "rate", "pieces", F.expr(cdf).alias("cdf"))
    )


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, seed: int = 42,
    size: Column | None = None, shuffle: bool = True,
) -> DataFrame:
    """``docs`` replicated to target weights and shuffled: its columns, ``copy`` (from 0) and ``shuffle_key``."""
    docs = docs.drop("copy", "shuffle_key")
    size = F.length(F.coalesce("text", F.lit(""))) if size is None else size
    names = fresh(docs, "mix_source", "mix_rate", "mix_pieces", "mix_cdf", "mix_salt", "mix_row", "mix_u", "mix_count", "copy", "shuffle_key")
    own, rate, pieces, cdf, salt, row, u, count, _, _ = names
    rates = Scratch(docs.sparkSession, "mixing").save(source_rates(docs, weights, temperature, size).toDF(own, rate, pieces, cdf))
    same = F.col("source").eqNullSafe(F.col(own))
    if rates.count() <= MAX_BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(row, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS))).join(salted, same & (F.col(row) == F.col(salt)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    # A count is the number of steps of the distribution function below the uniform number, over the pieces.
    joined = joined.withColumn(u, F.transform(F.sequence(F.lit(1), F.col(pieces)), lambda piece: _uniform(key, seed, piece)))
    joined = joined.withColumn(count, F.aggregate(u, F.lit(0), lambda n, x: n + F.size(F.filter(cdf, lambda c: c < x))))
    copies = joined.where(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    out = copies.select(*docs.columns, "copy", F.xxhash64(F.lit(seed), key, F.col("copy")).alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy") if shuffle else out
