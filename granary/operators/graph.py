"""Knowledge graphs as node and edge frames, traversal and graph retrieval.

nodes: id, label, type; edges: src, dst, relation, weight, evidence.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import automaton
from granary.sources.scratch import saved

from .retrieval import meet
from .text import sentence_table, strip
from .traversal import ego_nodes, find_paths

#: Text and labels that meet in one group.
TEXT_BYTES, LABEL_BYTES = 1 << 24, 1 << 16

# Relation patterns of the rule-based extractor, in the order they are tried.
RELATIONS = (
    (r"([A-Z][a-zA-Z\s]+)\s+is\s+(?:the\s+)?([a-z]+)\s+of\s+([A-Z][a-zA-Z\s]+)", "{1}_of"),
    (r"([A-Z][a-zA-Z\s]+)\s+was\s+born\s+in\s+([A-Z][a-zA-Z\s]+)", "born_in"),
    (r"([A-Z][a-zA-Z\s]+)\s+invented\s+([A-Z][a-zA-Z\s]+)", "invented"),
    (r"([A-Z][a-zA-Z\s]+)\s+discovered\s+([A-Z][a-zA-Z\s]+)", "discovered"),
    (r"([A-Z][a-zA-Z\s]+)\s+works\s+(?:at|for)\s+([A-Z][a-zA-Z\s]+)", "works_at"),
    (r"([A-Z][a-zA-Z\s]+)\s+won\s+(?:the\s+)?([A-Z][a-zA-Z\s]+)", "won"),
)


def node_id(label: Column) -> Column:
    return F.lower(F.regexp_replace(strip(label), r"[^\p{L}\p{N}_]+", "_"))


def graph_from_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (subject, predicate, object): the last label of an id stays, by the column ``pos``
    if there is one and an object after its subject, else the largest; edges keep repeats."""
    pos = F.col("pos") if "pos" in triples.columns else F.lit(0)
    edges = triples.select(
        node_id(F.col("subject")).alias("src"), node_id(F.col("object")).alias("dst"), F.col("predicate").alias("relation"), F.lit(1.0).alias("weight"),
        F.concat_ws(" ", "subject", "predicate", "object").alias("evidence"),
    )
    labels = triples.select(pos.alias("pos"), F.posexplode(F.array("subject", "object")).alias("side", "label")).withColumn("side", F.when(F.col("pos").isNotNull(), F.col("side")))
    last = F.max_by("label", F.struct("pos", "side", "label")) if "pos" in triples.columns else F.max("label")
    nodes = labels.groupBy(node_id(F.col("label")).alias("id")).agg(last.alias("label")).withColumn("type", F.lit("Entity"))
    return nodes, edges


def resolve_entities(labels: DataFrame) -> DataFrame:
    """(id, label, aliases): labels that share an id."""
    return labels.groupBy(node_id(F.col("label")).alias("id")).agg(F.max("label").alias("label"), F.array_sort(F.collect_set("label")).alias("aliases"))


def extract_relations(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, subject, predicate, object): each sentence's first matching pattern."""
    s = F.col("sentence")
    made = None
    for pattern, relation in RELATIONS:
        named = "{1}" in relation  # the second group is part of the relation's name
        name = strip(F.lower(F.regexp_extract(s, pattern, 2))) if named else F.lit("")
        t = F.struct(
            strip(F.regexp_extract(s, pattern, 1)).alias("subject"), F.replace(F.lit(relation), F.lit("{1}"), name).alias("predicate"),
            strip(F.regexp_extract(s, pattern, 3 if named else 2)).alias("object"),
        )
        made = F.when(s.rlike(pattern), t) if made is None else made.when(s.rlike(pattern), t)
    return sentence_table(docs).withColumn("t", made).where("t IS NOT NULL").select("doc_id", "pos", "t.subject", "t.predicate", "t.object")


def graph_from_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged graph of all documents' relations; a later document's label replaces an earlier one's."""
    return graph_from_triples(extract_relations(docs).withColumn("pos", F.struct("doc_id", "pos")))


def parse_triple_json(df: DataFrame) -> DataFrame:
    """(id, subject, relation, object) from stored model output holding a JSON array, fenced or bare; text
    that is no such array, and items lacking a key, give nothing."""
    fenced, bare = F.regexp_extract("output", r"(?s)```json\s*(\[.*?\])\s*```", 1), F.regexp_extract("output", r"(?s)(\[.*?\])", 1)
    text = F.when(fenced != "", fenced).otherwise(bare)
    items = F.from_json(text, "array<struct<subject: string, relation: string, object: string>>")
    return df.select("id", F.explode(items).alias("t")).select("id", "t.*").where("subject IS NOT NULL AND relation IS NOT NULL AND object IS NOT NULL")


def check_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that break integrity, with the reason."""
    ids = nodes.select("id")
    no_src = edges.join(ids, edges.src == ids.id, "left_anti").withColumn("reason", F.lit("unknown source"))
    no_dst = edges.join(ids, edges.dst == ids.id, "left_anti").withColumn("reason", F.lit("unknown target"))
    return no_src.unionByName(no_dst).unionByName(edges.where("weight < 0 OR weight > 1 OR weight IS NULL").withColumn("reason", F.lit("weight")))


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(id, neighbor), distinct."""
    pairs = {"out": edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor")), "in": edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"))}
    pairs["both"] = pairs["out"].union(pairs["in"])
    return pairs[direction].join(ids.select("id"), "id", "left_semi").distinct()


def edges_from(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that start at one of the ids."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(*edges.columns)


def edges_to(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that end at one of the ids."""
    return edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node, 0 kept; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, density, average degree, relation types."""
    n, e = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"), F.countDistinct("relation").alias("n_relations"))
    return n.crossJoin(e).select(
        "n_nodes", "n_edges", "n_relations",
        F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0).alias("density"),
        F.when(F.col("n_nodes") > 0, 2 * F.col("n_edges") / F.col("n_nodes")).otherwise(0.0).alias("avg_degree"),
    )


def top_degrees(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    return degree(nodes, edges).orderBy(F.desc("degree"), "id").limit(k)


def shortest_path(paths: DataFrame) -> DataFrame:
    """Each pair's shortest path, the smallest of equal ones."""
    best = paths.groupBy("start", "end").agg(F.min(F.struct(F.size("path").alias("n"), F.array_join("path", ">").alias("text"), "path")).alias("b"))
    return best.select("start", "end", "b.path")


def to_triples(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("subject"), F.col("relation").alias("predicate"), F.col("dst").alias("object"))


def link_entities(queries: DataFrame, nodes: DataFrame, text_bytes: int = TEXT_BYTES, label_bytes: int = LABEL_BYTES) -> DataFrame:
    """(query_id, id, place, label): nodes whose label occurs in the query, without case, and where first.

    Labels are dealt into shards of about ``label_bytes``, texts into blocks of about ``text_bytes``. Where a shard
    and a block meet, the shard becomes an automaton that is run once over all texts of the block, so the work is
    the length of the texts, once a shard, and what is found. Empty labels link with nothing.
    """
    kinds = {c: f.schema[c].dataType.simpleString() for c, f in (("query_id", queries), ("id", nodes))}
    keyed = nodes.select("id", "label", F.lower("label").alias("low")).where("low <> ''")
    asked = queries.select("query_id", F.lower("text").alias("text")).where("text <> ''")

    def scan(texts: pa.Table, labels: pa.Table) -> pa.Table:
        rows_of: dict[str, list[int]] = {}
        for i, low in enumerate(labels.column("low").to_pylist()):
            rows_of.setdefault(low, []).append(i)
        owned = np.array([len(r) for r in rows_of.values()], np.int64)
        order, first = np.array([i for r in rows_of.values() for i in r], np.int64), np.cumsum(owned) - owned
        data, offsets = automaton.text_bytes(texts.column("text")) if len(texts) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        text, pattern, place = automaton.Automaton([p.encode() for p in rows_of]).places(data, offsets)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        place = points[place] - points[offsets[text]] + 1
        # Nodes that share a label all link.
        times = owned[pattern]
        row = np.repeat(np.arange(len(text)), times)
        step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        node = pa.array(order[first[pattern[row]] + step])
        return pa.table({"query_id": texts.column("query_id").take(pa.array(text[row])), "id": labels.column("id").take(node), "place": place[row].astype(np.int32), "label": labels.column("label").take(node)})

    found = meet(asked, keyed, "query_id", "id", scan, f"query_id {kinds['query_id']}, id {kinds['id']}, place int, label string", text_bytes, label_bytes, q_weight=F.octet_length("text"), i_weight=F.octet_length("low"))
    return found.groupBy("query_id", "id", "label").agg(F.min("place").alias("place")).select("query_id", "id", "place", "label")


def _chunks_of(found: DataFrame, nodes: DataFrame, chunk_map: DataFrame | None, prefix: str) -> DataFrame:
    """``found`` nodes (id) with their chunk_id: their chunks by ``chunk_map`` (id, chunk_id), else one named for
    the node where it has content, and no row without either; without a map or a content column each node is
    its own chunk."""
    own = F.lit(None).cast("string")
    if "content" in nodes.columns:
        content = nodes.where("content <> ''").select("id", F.concat(F.lit(prefix), "id").alias("own")).distinct()
        found, own = found.join(content, "id", "left"), F.col("own")
    if chunk_map is not None:
        found, own = found.join(chunk_map.select("id", F.col("chunk_id").cast("string").alias("mapped")).distinct(), "id", "left"), F.coalesce("mapped", own)
    elif "content" not in nodes.columns:
        own = F.col("id")
    return found.withColumn("chunk_id", own).where("chunk_id IS NOT NULL").drop("own", "mapped")


def _first_chunks(found: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    """The first k chunks ``by`` query or seed, numbered by ``rank``."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order, "chunk_id"))).where(F.col("rank") <= k)


def ego_topk(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k_hops: int = 1, k: int = 5, chunk_map: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks of the nodes around each query's linked entities, nearest first.

    What is before a chunk in the list of one entity is before it in any list of a query that links to the entity, so
    a query needs only the first k of each of its entities. An entity's list is made once for all queries, and those
    that have k go no further out.
    """
    linked = saved(link_entities(queries, nodes), "links")
    open_, lists = linked.select(F.col("id").alias("seed")).distinct(), []
    for hops in range(min(1, k_hops), k_hops + 1):
        own = saved(_first_chunks(_chunks_of(ego_nodes(edges, open_, hops), nodes, chunk_map, "kg_"), "seed", k, "hop", "id").drop("rank"), "lists")
        full = own.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("seed")
        lists.append(own if hops == k_hops else own.join(full, "seed", "left_semi"))
        open_ = open_.join(full, "seed", "left_anti")
    near = linked.select("query_id", F.col("id").alias("seed")).join(reduce(DataFrame.unionByName, lists), "seed").groupBy("query_id", "id", "chunk_id").agg(F.min("hop").alias("hop"))
    return _first_chunks(near, "query_id", k, "hop", "id").select("query_id", "chunk_id", F.lit(1.0).alias("score"), "rank")


def path_topk(queries: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3, k: int = 5, chunk_map: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks of the nodes on the paths between each query's first two entities."""
    order = Window.partitionBy("query_id").orderBy("place", F.length("label").desc(), "id")
    two = link_entities(queries, nodes).withColumn("n", F.row_number().over(order)).where("n <= 2")
    pairs = two.groupBy("query_id").agg(F.max(F.when(F.col("n") == 1, F.col("id"))).alias("start"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("end")).where("end IS NOT NULL")
    pairs = saved(pairs, "pairs")
    paths = find_paths(edges, pairs.select("start", "end"), depth)
    on = pairs.join(paths, ["start", "end"]).select("query_id", F.size("path").alias("n"), F.explode("path").alias("id")).groupBy("query_id", "id").agg(F.min("n").alias("n"))
    return _first_chunks(_chunks_of(on, nodes, chunk_map, "kg_path_"), "query_id", k, "n", "id").select("query_id", "chunk_id", F.lit(1.0).alias("score"), "rank")
