"""N-gram Jaccard self-join: size-aware, light and heavy sets, exact at 100 * |A & B| >= 90 * |A | B|.

A set of size s can only be linked with sets that differ in at most floor(s / 9) elements, so:

* Light sets (small) enumerate their fixed-size subsets, each as a 128-bit digest. Two sets that share a
  c-subset overlap in at least c elements, so sharing one proves the link without looking at the sets
  again. Each subset's list links its members to its smallest one: if any two members qualify through
  that subset, both qualify with the smallest, so no pairs are listed and no link is lost.
* Heavy sets (large) are cut by element hash into one slice more than the differences allowed; linked
  sets then agree in a whole slice. Inverted lists are keyed by slice contents, which keeps lists of
  passages shared by thousands of documents short. Lists chain their members into candidate
  components. Each set is first compared with its component's smallest member, which settles groups of
  near copies in one comparison a set; members of lists that this leaves open are compared in blocks of
  bounded sets and elements, where each set scans the inverted lists of its elements and counts overlaps.

A list's hub is a minimum that tasks combine before the shuffle, and members meet it in a join that
adaptive execution splits, so a signature shared by a third of all documents is no single task's work.

The boundary between light and heavy is the size that minimises the rows and elements the two ways
would produce, counted over the whole table's sizes; sets above MAX_LIGHT are heavy under every choice,
so their cost is the same for all and left out of it. Copies with the same set are one class and only the
class takes part.

Defined cases: null or blank texts have an empty set and link with nothing; rows that share a doc_id
are one document for linking, each with its own n_shingles; a null doc_id links with nothing and has a
null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import Scratch, connected_components, fresh

#: Largest size that may be handled by subsets.
MAX_LIGHT = 26
#: Sets, and elements of sets, in one of the two blocks that a task compares; a larger set is a block of its own.
BLOCK_SETS = 1024
BLOCK_ELEMENTS = 1 << 18
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): document d has the sorted distinct shingle hashes values[first[d]:first[d+1]]."""
    w = bt.words(data, offsets, bt.NONSPACE)
    n = np.diff(w.first)
    with np.errstate(over="ignore"):
        # k-grams that stay inside their document
        many = np.maximum(n - k + 1, 0)
        at = np.repeat(w.first[:-1], many) + bt.runs(many)
        gram = np.full(len(at), _U(k))
        for j in range(k):
            gram = bt.mix(gram * _U(0x9E3779B97F4A7C15) + w.hash[at + j])
        owner = np.repeat(np.arange(len(n)), many)
        # documents of fewer words: the whole sequence
        short = np.flatnonzero((n > 0) & (n < k))
        whole = n[short].astype(np.uint64)
        for j in range(k - 1):
            more = n[short] > j
            whole[more] = bt.mix(whole[more] * _U(0x9E3779B97F4A7C15) + w.hash[w.first[short[more]] + j])
    owner = np.concatenate([owner, short])
    gram = np.concatenate([gram, whole])
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    owner, gram = owner[new], gram[new]
    return gram, np.searchsorted(owner, np.arange(len(n) + 1))


def _digests(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93):
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(bt.mix(values ^ _U(salt)), out=sums[1:])
            out.append(bt.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64) * _U(salt)))
    return out[0], out[1]


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _profiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bt.chunks(batch.column(1)):
                values, first = shingle_sets(data, offsets, k)
                a, b = _digests(values, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), _i64(a), _i64(b)],
                    ["doc_id", "n", "set_a", "set_b"],
                )

    return run


def size_groups(top: int) -> np.ndarray:
    """Lower ends of size classes, each covering sizes whose linked partners end in the next class."""
    ends = [1]
    while ends[-1] <= top:
        ends.append(max(ends[-1] + 1, -(-10 * ends[-1] // 9)))
    return np.array(ends)


def differences(size: int, threshold: int = 90) -> int:
    """Elements in which a set of this size and a linked one can differ."""
    return size * (100 - threshold) // threshold


def light_rows(size: int) -> int:
    """Subsets that a light set enumerates: all it can keep when up to differences(size - 1) drop out."""
    total, c = 1, 1
    for d in range(1, _drops(size) + 1):
        c = c * (size - d + 1) // d
        total += c
    return total


def _drops(size: int) -> int:
    # A linked partner keeps a common subset of at least ceil(0.9 * size) of this set's elements.
    return size - -(-9 * size // 10)


def choose_boundary(histogram: dict[int, int], verify_cost: float = 2.0) -> int:
    """Largest light size: subsets enumerated against slices written and elements gathered again."""
    best, at = None, 0
    for x in range(0, MAX_LIGHT + 1):
        light = sum(n * light_rows(s) for s, n in histogram.items() if s <= x)
        heavy = sum(
            n * (2 * (differences(s) + 1) + verify_cost * 2) for s, n in histogram.items() if -(-9 * (x + 1) // 10) <= s <= MAX_LIGHT
        )
        if best is None or light + heavy < best:
            best, at = light + heavy, x
    return at


def _signatures(k: int, boundary: int):
    lowest_heavy = -(-9 * (boundary + 1) // 10)  # light sets that a heavy one can be linked with

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bt.chunks(batch.column(1)):
                ids = np.asarray(batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                values, first = shingle_sets(data, offsets, k)
                sizes = np.diff(first)
                # Copies within the chunk write their signatures once.
                a, b = _digests(values, first)
                order = np.lexsort((ids, b, a))
                fresh = np.ones(len(ids), bool)
                fresh[order[1:]] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
                rows = [_light(ids, values, first, np.flatnonzero(fresh & (sizes > 0) & (sizes <= boundary)))]
                docs = np.flatnonzero(fresh & (sizes >= max(lowest_heavy, 1)))
                if len(docs):
                    ends = size_groups(int(sizes[docs].max()))
                    own = np.searchsorted(ends, sizes[docs], "right") - 1
                    rows += [_heavy(ids, values, first, docs[own + s >= 0], (own + s)[own + s >= 0], ends) for s in (0, -1)]
                for c, sig, sig2, over, node in rows:
                    if len(sig):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c.astype(np.int32)), _i64(sig), _i64(sig2), pa.array(over.astype(np.int32)), pa.array(node.astype(np.int64))],
                            ["c", "sig", "sig2", "over", "node"],
                        )

    return run


def _light(ids, values, first, docs):
    """Subset size, 128-bit digest, elements over the subset's, and node of every subset of the light sets."""
    out = [[], [], [], [], []]
    with np.errstate(over="ignore"):
        for d in docs:
            v = values[first[d] : first[d + 1]]
            salted = [bt.mix(v ^ _U(x)) for x in (0xA0761D6478BD642F, 0x589965CC75374CC3)]
            for drop in range(_drops(len(v)) + 1):
                gone = np.array(list(combinations(range(len(v)), drop)), np.int64)  # one row a subset
                tag = _U((len(v) - drop) * 0x9E3779B97F4A7C15 & (2**64 - 1))
                sums = [bt.mix(x.sum(dtype=np.uint64) - x[gone].sum(axis=1, dtype=np.uint64) + tag) for x in salted]
                for to, part in zip(out, (np.full(len(gone), len(v) - drop), *sums, np.full(len(gone), drop), np.full(len(gone), ids[d])), strict=True):
                    to.append(part)
    return tuple(np.concatenate([*x, np.zeros(0, kind)]) for x, kind in zip(out, (np.int64, np.uint64, np.uint64, np.int64, np.int64), strict=True))


def _heavy(ids, values, first, docs, group, ends):
    """Slice contents of each set, cut for the pairs whose smaller set is in size class ``group``."""
    slices = (ends[group + 1] - 1) // 9 + 1
    sizes = np.diff(first)[docs]
    at = np.repeat(first[docs], sizes) + bt.runs(sizes)
    with np.errstate(over="ignore"):
        v = values[at]
        doc = np.repeat(np.arange(len(docs)), sizes)
        part = ((v >> _U(32)) * slices[doc].astype(np.uint64)) >> _U(32)
        base = np.concatenate([[0], np.cumsum(slices)])
        sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(bt.mix(v ^ _U(0xE7037ED1A0B428DB)), out=sums[1:])
        cell = base[doc] + part.astype(np.int64)  # sorted, as values are sorted within a set
        edge = np.searchsorted(cell, np.arange(base[-1] + 1))
        number = bt.runs(slices)
        owner = np.repeat(np.arange(len(docs)), slices)
        tag = group[owner].astype(np.uint64) * _U(1 << 32) + number.astype(np.uint64)
        sig = bt.mix(sums[edge[1:]] - sums[edge[:-1]] + bt.mix(tag + _U(0x8EBC6AF09C88C6E3)))
    none = np.zeros(len(sig), np.int64)
    return none, sig, none.view(np.uint64), none, ids[docs][owner]


def _arrays(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(["comp", "node"])
            for lo, hi, data, offsets in bt.chunks(batch.column("text")):
                values, first = shingle_sets(data, offsets, k)
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _i64(values))
                yield pa.RecordBatch.from_arrays([*keys.slice(lo, hi - lo).columns, sets], [*keys.schema.names, "elements"])

    return run


def _links_in_block(table: pa.Table) -> pa.Table:
    """(a, b) links among the sets of a block pair, as a spanning forest: each set scans the shortest
    inverted lists that any linked set must be on, and counts the overlap with those it meets there."""
    node = table.column("node").to_numpy()
    left = table.column("left_side").to_numpy(zero_copy_only=False).astype(bool)
    lists = table.column("elements").combine_chunks()
    first = np.asarray(lists.offsets, np.int64)
    values = np.asarray(lists.flatten()).view(np.uint64)
    first = first - first[0]
    sizes = np.diff(first)
    _, element, lengths = np.unique(values, return_inverse=True, return_counts=True)
    posting = np.repeat(np.arange(len(node)), sizes)[np.argsort(element, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(lengths)])
    both_sides = left.any() and not left.all()
    label = np.arange(len(node))
    held = np.zeros(len(lengths), bool)
    out = []

    def link(i: int, others: np.ndarray) -> None:
        """Count the overlap of set i with each of ``others`` and join what qualifies."""
        others = others[(10 * sizes[others] >= 9 * sizes[i]) & (9 * sizes[others] <= 10 * sizes[i])]
        if not len(others):
            return
        mine = element[first[i] : first[i + 1]]
        held[mine] = True
        at = np.repeat(first[others], sizes[others]) + bt.runs(sizes[others])
        overlap = np.add.reduceat(held[element[at]].astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        held[mine] = False
        for j in others[100 * overlap >= 90 * (sizes[i] + sizes[others] - overlap)]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((node[i], node[j]))

    def shortest(i: int) -> np.ndarray:
        # A linked set lacks at most _drops elements, so it is on a list of any one more.
        mine = element[first[i] : first[i + 1]]
        return mine[np.argsort(lengths[mine], kind="stable")[: _drops(len(mine)) + 1]]

    filled = np.flatnonzero(sizes).tolist()
    for i in filled:  # the first on its shortest list: joins most of a group of near copies
        link(i, posting[begin[shortest(i)[:1]]])
    # Lists whose members are all joined by now have nothing left to compare.
    mixed = np.minimum.reduceat(label[posting], begin[:-1]) != np.maximum.reduceat(label[posting], begin[:-1]) if len(posting) else np.zeros(0, bool)
    for i in filled:
        rare = shortest(i)
        rare = rare[mixed[rare]]
        if len(rare):
            met = np.unique(posting[np.repeat(begin[rare], lengths[rare]) + bt.runs(lengths[rare])])
            link(i, met[(label[met] != label[i]) & ((left[met] != left[i]) | (not both_sides))])
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def set_classes(profiles: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(classes, joined): doc_id -> smallest doc_id with an equal set, for those with another one; links
    between classes that share a doc_id (rows repeating an id with another text)."""
    sets = ["n", "set_a", "set_b"]
    members = profiles.where("n > 0 AND doc_id IS NOT NULL")
    least = scratch.save(members.groupBy(*sets).agg(F.min("doc_id").alias("class"), F.count("*").alias("m")))
    every = members.join(least, sets).groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("other"), F.collect_set("class").alias("all"))
    every = scratch.save(every.where("doc_id <> class OR class <> other"))
    joined = every.where("class <> other").select(F.col("class").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return every.where("doc_id <> class").select("doc_id", "class"), joined


def _signature_links(signatures: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, over, node, hub, hub_over): each list's members and the hub, the smallest of those with the fewest elements."""
    most = _drops(MAX_LIGHT)
    ends = [F.min(F.when(F.col("over") == d, F.col("node"))).alias(f"m{d}") for d in range(most + 1)]
    lists = signatures.groupBy("c", "sig", "sig2").agg(*ends, F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    hubs = scratch.save(lists.select(
        "c", "sig", "sig2", F.coalesce(*(f"m{d}" for d in range(most + 1))).alias("hub"),
        F.coalesce(*(F.when(F.col(f"m{d}").isNotNull(), F.lit(d)) for d in range(most + 1))).alias("hub_over"),
    ))
    return signatures.join(hubs, ["c", "sig", "sig2"]).where("node <> hub").select("c", "over", "node", "hub", "hub_over").distinct()


def _heavy_links(edges: DataFrame, texts: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(a, b): verified links of the candidate ``edges`` (a, b: a member of a list and its hub)."""
    maybe = connected_components(edges, scratch).select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
    sets = texts.join(maybe, "doc_id").select("comp", F.col("doc_id").alias("node"), "text").mapInArrow(_arrays(k), "comp long, node long, elements array<bigint>")
    sets = scratch.save(sets)
    # One comparison with the component's smallest member for each set. Repeated links do no harm, and an
    # aggregate by component would keep the join from being split where a component is large.
    root = sets.where("node = comp").select("comp", F.col("elements").alias("root"))
    overlap = F.size(F.array_intersect("elements", "root"))
    near = overlap * 100 >= (F.size("elements") + F.size("root") - overlap) * 90
    star = scratch.save(sets.where("node <> comp").join(root, "comp").where(near).select(F.col("node").alias("a"), F.col("comp").alias("b")))
    # A list is settled if all its members are joined to the root; the others' members are compared with each other.
    settled = star.select("a").union(maybe.where("doc_id = comp").select("doc_id"))
    loose = edges.select(F.explode(F.array("a", "b")).alias("a"), F.col("b").alias("hub")).distinct().join(settled, "a", "left_anti").select(F.col("hub").alias("b")).distinct()
    rest = scratch.save(edges.join(loose, "b", "left_semi").select("a", "b"))
    again = connected_components(rest, scratch).select("node", F.col("component").alias("part"))
    left = scratch.save(sets.join(again, "node").select("part", "node", "elements"))
    spread = left.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.size("elements")) / BLOCK_ELEMENTS)).cast("int").alias("n_blocks"))
    blocked = left.join(spread, "part").withColumn("block", F.expr("pmod(xxhash64(node, elements), n_blocks)").cast("int"))
    placed = blocked.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "part", F.least("block", "j").alias("p"), F.greatest("block", "j").alias("q"), "node", F.expr("block <= j").alias("left_side"), "elements"
    )
    return star.union(placed.groupBy("part", "p", "q").applyInArrow(_links_in_block, "a long, b long"))


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, boundary: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (smallest id with the same set), component_id
    (smallest id reachable by links). ``boundary`` overrides the cost-chosen largest light size."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profiles = scratch.save(texts.mapInArrow(_profiles(k), "doc_id long, n long, set_a long, set_b long"))
    texts = texts.where("doc_id IS NOT NULL")
    classes, joined = set_classes(profiles, scratch)
    if boundary is None:
        small = profiles.where(F.col("n").between(1, MAX_LIGHT)).groupBy("n").count().collect()  # MAX_LIGHT rows
        boundary = choose_boundary({r["n"]: r["count"] for r in small})

    signatures = scratch.save(texts.mapInArrow(_signatures(k, boundary), "c int, sig long, sig2 long, over int, node long"))
    shared = scratch.save(_signature_links(signatures, scratch))
    scratch.free(signatures)
    # Members of one class may have written signatures in different tasks.
    edges = scratch.save(
        shared.join(classes.toDF("node", "node_class"), "node", "left").join(classes.toDF("hub", "hub_class"), "hub", "left")
        .select("c", "over", "hub_over", F.coalesce("node_class", "node").alias("a"), F.coalesce("hub_class", "hub").alias("b"))
        .where("a <> b").distinct()
    )
    # Both sets have c elements in common, one has ``over`` more and the hub ``hub_over``.
    proven = edges.where("c > 0 AND 100 * c >= 90 * (c + over + hub_over)").select("a", "b")
    verified = _heavy_links(edges.where("c = 0").select("a", "b"), texts, k, scratch)
    links = scratch.save(proven.union(verified).union(joined))
    comps = scratch.save(connected_components(links, scratch))

    copies = classes.join(comps.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "class", "component")
    label = copies.union(comps.select(F.col("node").alias("doc_id"), F.col("node").alias("class"), "component"))
    return profiles.select("doc_id", F.col("n").alias("n_shingles")).join(label, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("component", "class", "doc_id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest doc_id of each component, columns unchanged. Rows that share a doc_id are
    one document and go or stay together; rows with a null doc_id stay, and so do empty texts."""
    scratch = Scratch(docs.sparkSession, "jaccard-drop")
    (own,) = fresh(docs, "copy_id")
    gone = scratch.save(ngram_jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct())
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
