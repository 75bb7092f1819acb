"""Paths and neighbourhoods of many pairs or seeds at once, level by level.

Each level is saved, so a level extends the one before instead of repeating it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.scratch import saved


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()


def hop_distances(steps: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(id, hops): nodes from which some target (id) is at most ``depth`` steps (at, next) away, and how far the nearest is.
    A row for each node, whatever the number of targets."""
    front = targets.select("id").distinct().withColumn("hops", F.lit(0))
    levels = [front]
    for hops in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("id")
        reached = steps.join(front.select(F.col("id").alias("next")), "next", "left_semi").select(F.col("at").alias("id")).distinct()
        front = saved(reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(hops)), "distance")
        levels.append(front)
    return reduce(DataFrame.unionByName, levels)


def half_paths(steps: DataFrame, starts: DataFrame, goal: DataFrame, length: int, depth: int) -> list[DataFrame]:
    """For each number of steps up to ``length``: (origin, at, path) of the simple paths from ``starts`` (id) whose last node
    can still reach a goal within ``depth`` steps in all, by the hop distances ``goal`` (id, hops)."""
    level = starts.select("id").distinct().select(F.col("id").alias("origin"), F.col("id").alias("at"), F.array("id").alias("path"))
    out = [level]
    for done in range(1, length + 1):
        onward = steps.join(goal.where(F.col("hops") <= depth - done).select(F.col("id").alias("next")), "next", "left_semi")
        level = level.join(onward, "at").where(~F.array_contains("path", F.col("next"))).select("origin", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        level = saved(level, "paths")
        out.append(level)
    return out


def find_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, end, path): simple directed paths of at most ``max_depth`` edges.

    Halves are walked from both ends and meet in the middle: forward halves from each start, shared by all its pairs,
    backward ones from each end, joined on the node they meet in if they have no other in common. Forward halves go on
    only to nodes from which some end is near enough, backward ones only to nodes that are on the way from some start,
    or that a forward half has come to.
    """
    pairs = saved(pairs.where("start <> end").select("start", "end").distinct(), "pairs")
    steps = saved(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).where("at <> next").distinct(), "steps")
    back = steps.select(F.col("next").alias("at"), F.col("at").alias("next"))
    starts, ends = (pairs.select(F.col(c).alias("id")) for c in ("start", "end"))
    half, rest = (max_depth + 1) // 2, max_depth // 2
    forth = half_paths(steps, starts, hop_distances(steps, ends, max_depth - 1), half, max_depth)
    # How far a node is from the nearest start, for all nodes that forward halves have come to.
    come = reduce(DataFrame.unionByName, (f.select(F.col("at").alias("id"), F.lit(i).alias("hops")) for i, f in enumerate(forth))).groupBy("id").agg(F.min("hops").alias("hops"))
    hither = half_paths(back, ends, come, rest, max_depth) if rest < 2 else half_paths(back, ends, hop_distances(back, starts, max_depth - 1), rest, max_depth)
    found = []
    for length in range(1, max_depth + 1):
        a = forth[(length + 1) // 2].select(F.col("origin").alias("start"), "at", F.col("path").alias("ahead"))
        b = hither[length // 2].select(F.col("origin").alias("end"), "at", F.reverse(F.slice("path", 1, length // 2)).alias("rest"))
        met = pairs.join(a, "start").join(b, ["end", "at"]).where(~F.arrays_overlap("ahead", "rest"))
        found.append(met.select("start", "end", F.concat("ahead", "rest").alias("path")))
    return reduce(DataFrame.unionByName, found)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, end, path): each pair's shortest path of at most ``max_depth`` edges, of equally short ones the one whose nodes,
    joined by >, come first. Ids must not hold that sign.

    All starts advance together. A level has one row for each start and node, with the best way there; nodes seen
    before, starts whose pairs are all settled, and nodes too far from any end go no further, so no path longer
    than the shortest is built.
    """
    pairs = saved(pairs.where("start <> end").select("start", "end").distinct(), "pairs")
    steps = saved(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).where("at <> next").distinct(), "steps")
    goal = hop_distances(steps, pairs.select(F.col("end").alias("id")), max_depth - 1)
    front = pairs.select("start", F.col("start").alias("at"), F.concat("start", F.lit(">")).alias("text")).distinct()
    seen, found, open_ = [front.select("start", "at")], [], pairs
    for done in range(1, max_depth + 1):
        onward = steps.join(goal.where(F.col("hops") <= max_depth - done).select(F.col("id").alias("next")), "next", "left_semi")
        alive = front.join(open_.select("start").distinct(), "start", "left_semi")
        # With a sign after every node, the smallest way to a node stays the smallest beyond it.
        reached = alive.join(onward, "at").groupBy("start", F.col("next").alias("at")).agg(F.min(F.concat("text", "next", F.lit(">"))).alias("text"))
        front = saved(reached.join(reduce(DataFrame.unionByName, seen), ["start", "at"], "left_anti"), "front")
        seen.append(front.select("start", "at"))
        hit = front.join(open_.select("start", F.col("end").alias("at")), ["start", "at"])
        found.append(hit.select("start", F.col("at").alias("end"), F.split(F.expr("substring(text, 1, length(text) - 1)"), ">").alias("path")))
        open_ = saved(open_.join(front.select("start", F.col("at").alias("end")), ["start", "end"], "left_anti"), "open")
    return reduce(DataFrame.unionByName, found)


#: Seeds that one word of bits stands for.
_WORD = 64


def number_seeds(seeds: DataFrame) -> DataFrame:
    """(seed, word, bit): neighbours in the order of seeds share words."""
    own = seeds.select("seed").distinct().repartitionByRange("seed").sortWithinPartitions("seed").select("seed", F.monotonically_increasing_id().alias("n"))
    return saved(own.select("seed", F.shiftright("n", 6).alias("word"), F.col("n").bitwiseAND(F.lit(_WORD - 1)).cast("int").alias("bit")), "seeds")


def ego_bits(edges: DataFrame, numbered: DataFrame, k: int) -> DataFrame:
    """(id, word, bits, hop): for every node within k edges of some seeds, in either direction, the seeds that it is ``hop``
    edges from, as bits. A level has at most a row for each node and word of seeds, merged in the tasks first."""
    steps = saved(both_ways(edges), "steps")
    seen = saved(numbered.groupBy(F.col("seed").alias("id"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).withColumn("hop", F.lit(0)), "ego")
    front, levels = seen, [seen]
    for hop in range(1, k + 1):
        new = front.select(F.col("id").alias("a"), "word", "bits").join(steps, "a").groupBy(F.col("b").alias("id"), "word").agg(F.bit_or("bits").alias("new"))
        known = reduce(DataFrame.unionByName, levels).groupBy("id", "word").agg(F.bit_or("bits").alias("known"))
        fresh = new.join(known, ["id", "word"], "left").withColumn("bits", F.col("new").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long")))))
        front = saved(fresh.where("bits <> 0").select("id", "word", "bits", F.lit(hop).alias("hop")), "ego")
        levels.append(front)
    return reduce(DataFrame.unionByName, levels)


def _seeds_of(rows: DataFrame, numbered: DataFrame, *keep: str) -> DataFrame:
    """``rows`` (word, bits) once for each seed among their bits."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda i: F.getbit("bits", i) == 1)
    return rows.select(*keep, "word", F.explode(bits).alias("bit")).join(numbered, ["word", "bit"]).select("seed", *keep)


def _per_seed(rows: DataFrame, numbered: DataFrame, name: str) -> DataFrame:
    """(seed, ``name``): the times of the ``rows`` (word, bits, times) in which each seed's bit is set; a sum for each bit, no row for each seed."""
    sums = rows.groupBy("word").agg(*(F.sum(F.expr(f"getbit(bits, {i}) * times")).alias(f"s{i}") for i in range(_WORD)))
    return sums.select("word", F.posexplode(F.array(*(f"s{i}" for i in range(_WORD)))).alias("bit", name)).join(numbered, ["word", "bit"]).select("seed", name)


def _inside(near: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with the words of the seeds that have both ends near."""
    whole = near.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    src, dst = (whole.select(F.col("id").alias(c), "word", F.col("bits").alias(f"{c}_bits")) for c in ("src", "dst"))
    met = edges.join(src, "src").join(dst, ["dst", "word"])
    return met.withColumn("bits", F.col("src_bits").bitwiseAND(F.col("dst_bits"))).where("bits <> 0").drop("src_bits", "dst_bits")


def ego_nodes(edges: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """(seed, id, hop): nodes within k edges of each seed, in either direction."""
    numbered = number_seeds(seeds)
    return _seeds_of(ego_bits(edges, numbered, k), numbered, "id", "hop")


def ego_graph(edges: DataFrame, seeds: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes by seed, edges with both ends among a seed's nodes)."""
    numbered = number_seeds(seeds)
    near = ego_bits(edges, numbered, k)
    return _seeds_of(near, numbered, "id", "hop"), _seeds_of(_inside(near, edges), numbered, "src", "dst", "relation", "weight", "evidence")


def twins(edges: DataFrame) -> DataFrame:
    """(id, kind): nodes of the same neighbours, in either direction, have the same kind, told by 128 bits of hashes."""
    hashes = (F.bit_xor(F.xxhash64(F.lit(i), "b")).alias(f"h{i}") for i in range(2))
    each = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), *hashes)
    return saved(each.select("id", F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "h0", "h1"))).alias("kind")), "twins")


def ego_sizes(edges: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """(seed, n_nodes, n_edges) of each seed's ego graph, counted without listing them.

    Twins, nodes of the same neighbours, are two edges apart and equally far from all others, so from k = 2 on they have
    the same ego graph and lie in the same ones. Each kind of node is then walked from and come to once, and
    counts as often as it has nodes; edges between two kinds count as often as there are.
    """
    if k < 2:
        numbered = number_seeds(seeds)
        near = ego_bits(edges, numbered, k)
        nodes, inside = near.withColumn("times", F.lit(1).cast("long")), _inside(near, edges).withColumn("times", F.lit(1).cast("long"))
        return _sizes(nodes, inside, numbered)
    kind = twins(edges)
    weights = kind.groupBy("kind").agg(F.count("*").alias("times"))
    asked = seeds.select("seed").distinct().join(kind.withColumnRenamed("id", "seed"), "seed", "left")
    asked = saved(asked.select("seed", F.coalesce("kind", F.concat(F.lit("alone "), F.col("seed").cast("string"))).alias("kind")), "asked")
    src, dst = (kind.select(F.col("id").alias(c), F.col("kind").alias(f"{c}_kind")) for c in ("src", "dst"))
    half = edges.join(src, "src").groupBy("src_kind", "dst").agg(F.count("*").alias("times"))
    between = saved(half.join(dst, "dst").groupBy(F.col("src_kind").alias("src"), F.col("dst_kind").alias("dst")).agg(F.sum("times").alias("times")), "between")
    numbered = number_seeds(asked.select(F.col("kind").alias("seed")))
    near = ego_bits(between, numbered, k)
    nodes = near.join(weights.withColumnRenamed("kind", "id"), "id", "left").withColumn("times", F.coalesce("times", F.lit(1).cast("long")))
    return asked.join(_sizes(nodes, _inside(near, between), numbered).withColumnRenamed("seed", "kind"), "kind").drop("kind")


def _sizes(nodes: DataFrame, inside: DataFrame, numbered: DataFrame) -> DataFrame:
    ends = _per_seed(nodes, numbered, "n_nodes").join(_per_seed(inside, numbered, "n_edges"), "seed", "left")
    return ends.select("seed", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
