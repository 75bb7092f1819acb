"""Queries over the graph of nations, regions, suppliers and customers, and relations read from texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import graph as G
from granary.operators import retrieval as R
from granary.operators import traversal as V

from .common import TRIPLES, frame, plain, table

_T = plain(TRIPLES)
_SENTENCES = """
    SELECT c_custkey AS doc_id, name || ' is the client of Nation ' || n_name || '. Then ' || name || ' Ann was born in ' || n_name || '! ' || name || ' works at ' || n_name || ' Bank' AS text
    FROM (SELECT *, 'Client ' || translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS name FROM {customer}) c JOIN {nation} ON c_nationkey = n_nationkey
"""
_NATIONS = "SELECT s_suppkey AS query_id, 'Which supplier ' || s_suppkey || ' serves nation ' || n_name || ' today?' AS text FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"
_OUTPUT = """
    SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'no array' WHEN 1 THEN 'Here: [' || chr(123) || '"subject": "' || c_name || '", "relation": "in", "object": "' || n_name || '"' || chr(125) || '] done'
        WHEN 2 THEN '```json' || chr(10) || '[' || chr(123) || '"subject": "' || c_name || '", "relation": "of", "object": "' || c_mktsegment || '"' || chr(125) || ', ' || chr(123) || '"subject": "x"' || chr(125) || ']' || chr(10) || '```'
        ELSE '[broken' END AS output
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""


def _graph(spark, sf):
    return G.graph_from_triples(frame(spark, sf, TRIPLES))


def _seeds(spark, sf, nodes, name="seed"):
    return nodes.where("id LIKE 'supplier_%'").select(F.col("id").alias(name))


_SHOUTED = f"SELECT subject, predicate, CASE WHEN subject LIKE '%7' THEN upper(object) ELSE object END AS object, subject AS pos FROM ({TRIPLES}) AS t"


def gra1(spark, sf):
    """Labels differ in case; the last one, by subject, stays."""
    nodes, edges = G.graph_from_triples(frame(spark, sf, _SHOUTED))
    return nodes.select(F.lit("node").alias("part"), "id", "label").unionByName(edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.concat_ws(">", "relation", "dst").alias("label")))


def gra2(spark, sf):
    t = frame(spark, sf, TRIPLES)
    labels = t.select(F.col("object").alias("label")).union(t.select(F.upper("object")))
    return G.resolve_entities(labels).select("id", "label", F.array_join("aliases", "|").alias("aliases"))


def gra3(spark, sf):
    return G.extract_relations(frame(spark, sf, _SENTENCES))


def gra4(spark, sf):
    return G.parse_triple_json(frame(spark, sf, _OUTPUT))


def gra5(spark, sf):
    nodes, edges = _graph(spark, sf)
    heavy = edges.withColumn("weight", F.when(F.col("src").endswith("7"), 1.5).otherwise(F.col("weight")))
    return G.check_edges(nodes.where("id <> 'nation_france'"), heavy).select("src", "dst", "reason")


def gra6(spark, sf):
    nodes, edges = _graph(spark, sf)
    ids = nodes.where("id LIKE 'nation_%'")
    out = None
    for d in ("out", "in", "both"):
        part = G.neighbors(edges, ids, d).groupBy("id").agg(F.count("*").alias("n")).withColumn("direction", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out


def gra6_edges(spark, sf):
    """All edges that start at a supplier or end at a region."""
    nodes, edges = _graph(spark, sf)
    parts = (("from", G.edges_from(edges, nodes.where("id LIKE 'supplier_%'"))), ("to", G.edges_to(edges, nodes.where("id LIKE 'region_%'"))))
    out = [df.select("src", "dst", "relation", F.lit(d).alias("direction")) for d, df in parts]
    return out[0].unionByName(out[1])


def gra7(spark, sf):
    nodes, edges = _graph(spark, sf)
    summary = G.graph_summary(nodes, edges)
    return summary.select("n_nodes", "n_edges", "n_relations", F.round("density", 9).alias("density"), F.round("avg_degree", 6).alias("avg_degree")).crossJoin(
        G.degree(nodes, edges).groupBy("degree").agg(F.count("*").alias("n"))
    )


def gra7_top(spark, sf):
    return G.top_degrees(*_graph(spark, sf))


def _pairs(nodes):
    return nodes.where("id LIKE 'supplier_%'").select(F.col("id").alias("start")).crossJoin(F.broadcast(nodes.where("id LIKE 'region_%'").select(F.col("id").alias("end"))))


def gra8(spark, sf):
    nodes, edges = _graph(spark, sf)
    return V.find_paths(edges, _pairs(nodes)).select("start", "end", F.array_join("path", ">").alias("path"))


def gra9(spark, sf):
    nodes, edges = _graph(spark, sf)
    return V.ego_sizes(edges, _seeds(spark, sf, nodes), 2)


def gra10(spark, sf):
    nodes, edges = _graph(spark, sf)
    return V.shortest_paths(edges, _pairs(nodes)).select("start", "end", F.array_join("path", ">").alias("path"))


def gra11(spark, sf):
    return G.to_triples(_graph(spark, sf)[1])


def ret8(spark, sf):
    nodes, edges = _graph(spark, sf)
    graph = G.ego_topk(frame(spark, sf, _NATIONS), nodes, edges, 1, 10)
    dense = graph.select("query_id", "chunk_id", (1 / F.col("rank")).alias("score"), "rank").where("rank % 2 = 1")
    return R.graph_hybrid_topk(dense, graph, 3).withColumn("score", F.round("score", 6))


def ret9(spark, sf):
    nodes, _ = _graph(spark, sf)
    return G.link_entities(frame(spark, sf, _NATIONS), nodes).select("query_id", "id", F.col("place").cast("long").alias("place"))


def ret9_passages(spark, sf):
    """Benchmark items as labels, linked in whole documents."""
    nodes = table(spark, sf, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("label"))
    found = G.link_entities(table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text"), nodes)
    return found.select("query_id", "id", F.col("place").cast("long").alias("place"))


def _chunked(spark, sf):
    """Suppliers have chunks, nations content of their own, customers neither."""
    nodes, edges = _graph(spark, sf)
    nodes = nodes.withColumn("content", F.when(F.startswith("id", F.lit("nation_")), F.col("label")))
    return nodes, edges, nodes.where("id LIKE 'supplier_%'").select("id", F.concat(F.lit("chunk "), "label").alias("chunk_id"))


def ret10(spark, sf):
    nodes, edges, chunks = _chunked(spark, sf)
    return G.ego_topk(frame(spark, sf, _NATIONS), nodes, edges, 1, 5, chunks)


def ret11(spark, sf):
    nodes, edges, chunks = _chunked(spark, sf)
    return G.path_topk(frame(spark, sf, _NATIONS), nodes, edges, chunk_map=chunks)


def ret12(spark, sf):
    nodes, edges = G.graph_from_documents(frame(spark, sf, _SENTENCES))
    return G.degree(nodes, edges)


_CASED = """
    SELECT c_custkey AS doc_id, 'Nothing here. ' || name || ' works at ' || CASE WHEN c_custkey % 3 = 0 THEN 'LAND ' ELSE 'Land ' END || translate(CAST(c_nationkey AS STRING), '0123456789', 'abcdefghij') AS text
    FROM (SELECT *, 'Client ' || translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS name FROM {customer}) AS c
"""


def ret12_labels(spark, sf):
    """Nations are spelled in two ways; the last document's spelling stays."""
    return G.graph_from_documents(frame(spark, sf, _CASED))[0].select("id", "label")


QUERIES = {
    "gra1_graph_from_triples": gra1, "gra2_resolve_entities": gra2, "gra3_extract_relations": gra3, "gra4_parse_triple_json": gra4, "gra5_check_edges": gra5, "gra6_neighbors": gra6, "gra6_edges": gra6_edges,
    "gra7_degree_summary": gra7, "gra7_top_degrees": gra7_top, "gra8_find_paths": gra8, "gra9_ego_graph": gra9, "gra10_shortest_path": gra10, "gra11_to_triples": gra11,
    "ret8_graph_hybrid": ret8, "ret9_link_entities": ret9, "ret9_link_passages": ret9_passages, "ret10_ego_topk": ret10, "ret11_path_topk": ret11, "ret12_graph_from_documents": ret12, "ret12_labels": ret12_labels,
}

_ID = r"lower(regexp_replace(trim({0}), '[^\p{L}\p{N}_]+', '_', 'g'))"
_S, _O = _ID.replace("{0}", "subject"), _ID.replace("{0}", "object")
_G = f"""t AS ({_T}), e AS (SELECT {_S} AS src, {_O} AS dst, predicate AS relation, subject, object FROM t
    ), n AS (SELECT {_ID.replace('{0}', 'label')} AS id, max(label) AS label FROM (SELECT subject AS label FROM t UNION ALL SELECT object FROM t) GROUP BY 1
    ), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)"""
_PATHS = f"""WITH RECURSIVE {_G}, p AS (
        SELECT s.id AS start, r.id AS "end", s.id AS cur, [s.id] AS path FROM n s, n r WHERE s.id LIKE 'supplier_%' AND r.id LIKE 'region_%'
        UNION ALL SELECT start, "end", dst, list_append(path, dst) FROM p JOIN (SELECT DISTINCT src, dst FROM e) e ON src = cur WHERE cur <> "end" AND len(path) <= 3 AND NOT list_contains(path, dst)
    ), paths AS (SELECT start, "end", array_to_string(path, '>') AS path, len(path) AS size FROM p WHERE cur = "end")"""
_N = plain(_NATIONS)
_EGO = f"""WITH {_G}, q AS ({_N}), l AS (SELECT query_id, id, strpos(lower(text), lower(label)) AS place, label FROM q, n WHERE contains(lower(text), lower(label))
    ), h AS (SELECT query_id, id, min(hop) AS hop FROM (SELECT query_id, id, 0 AS hop FROM l UNION ALL SELECT query_id, b, 1 FROM l JOIN b ON a = id) GROUP BY ALL
    ), g AS (SELECT query_id, id AS chunk_id, CAST(1.0 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hop, id) AS INT) AS rank FROM h)"""
_CHUNK = "CASE WHEN id LIKE 'supplier_%' THEN 'chunk ' || label WHEN id LIKE 'nation_%' THEN '{0}' || id END"
_SENT = plain(_SENTENCES)
_RELATIONS = rf"""WITH d AS ({_SENT}), s AS (SELECT doc_id, regexp_split_to_array(text, '[.!?]\s+') AS ss FROM d), x AS (SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INT) AS pos, unnest(ss) AS z FROM s
    ), r AS (SELECT doc_id, pos,
        CASE WHEN regexp_matches(z, '([A-Z][a-zA-Z\s]+)\s+is\s+(?:the\s+)?([a-z]+)\s+of\s+([A-Z][a-zA-Z\s]+)') THEN [regexp_extract(z, '([A-Z][a-zA-Z\s]+)\s+is\s+(?:the\s+)?([a-z]+)\s+of\s+([A-Z][a-zA-Z\s]+)', 1), 'client_of', regexp_extract(z, '([A-Z][a-zA-Z\s]+)\s+is\s+(?:the\s+)?([a-z]+)\s+of\s+([A-Z][a-zA-Z\s]+)', 3)]
             WHEN regexp_matches(z, '([A-Z][a-zA-Z\s]+)\s+was\s+born\s+in\s+([A-Z][a-zA-Z\s]+)') THEN [regexp_extract(z, '([A-Z][a-zA-Z\s]+)\s+was\s+born\s+in\s+([A-Z][a-zA-Z\s]+)', 1), 'born_in', regexp_extract(z, '([A-Z][a-zA-Z\s]+)\s+was\s+born\s+in\s+([A-Z][a-zA-Z\s]+)', 2)]
             WHEN regexp_matches(z, '([A-Z][a-zA-Z\s]+)\s+works\s+(?:at|for)\s+([A-Z][a-zA-Z\s]+)') THEN [regexp_extract(z, '([A-Z][a-zA-Z\s]+)\s+works\s+(?:at|for)\s+([A-Z][a-zA-Z\s]+)', 1), 'works_at', regexp_extract(z, '([A-Z][a-zA-Z\s]+)\s+works\s+(?:at|for)\s+([A-Z][a-zA-Z\s]+)', 2)] END AS m FROM x
    ), rel AS (SELECT doc_id, pos, trim(m[1]) AS subject, m[2] AS predicate, trim(m[3]) AS object FROM r WHERE m IS NOT NULL)"""
_OUT = plain(_OUTPUT)

ORACLE = {
    "gra1_graph_from_triples": f"""WITH t AS ({plain(_SHOUTED)}), e AS (SELECT {_S} AS src, {_O} AS dst, predicate AS relation FROM t
        ), l AS (SELECT subject AS label, pos, 0 AS side FROM t UNION ALL SELECT object, pos, 1 FROM t), n AS (SELECT {_ID.replace('{0}', 'label')} AS id, arg_max(label, (pos, side, label)) AS label FROM l GROUP BY 1) SELECT 'node' AS part, id, label FROM n UNION ALL SELECT 'edge', src, relation || '>' || dst FROM e""",
    "gra2_resolve_entities": f"""WITH t AS ({_T}), l AS (SELECT object AS label FROM t UNION SELECT upper(object) FROM t)
        SELECT {_ID.replace('{0}', 'label')} AS id, max(label) AS label, string_agg(DISTINCT label, '|' ORDER BY label) AS aliases FROM l GROUP BY 1""",
    "gra3_extract_relations": _RELATIONS + " SELECT * FROM rel",
    "gra4_parse_triple_json": f"""WITH o AS ({_OUT}), j AS (SELECT id, CASE WHEN regexp_extract(output, '(?s)```json\\s*(\\[.*?\\])\\s*```', 1) <> '' THEN regexp_extract(output, '(?s)```json\\s*(\\[.*?\\])\\s*```', 1) ELSE regexp_extract(output, '(?s)(\\[.*?\\])', 1) END AS j FROM o
        ), u AS (SELECT id, unnest(from_json(j, '[{{"subject":"VARCHAR","relation":"VARCHAR","object":"VARCHAR"}}]')) AS t FROM j WHERE j <> '')
        SELECT id, t.subject AS subject, t.relation AS relation, t.object AS object FROM u WHERE t.relation IS NOT NULL AND t.object IS NOT NULL""",
    "gra5_check_edges": f"""WITH {_G} SELECT src, dst, 'unknown source' AS reason FROM e WHERE src = 'nation_france' UNION ALL SELECT src, dst, 'unknown target' FROM e WHERE dst = 'nation_france'
        UNION ALL SELECT src, dst, 'weight' FROM e WHERE src LIKE '%7'""",
    "gra6_neighbors": f"""WITH {_G}, x AS (SELECT DISTINCT src AS id, dst AS m, 'out' AS direction FROM e UNION SELECT DISTINCT dst, src, 'in' FROM e UNION SELECT DISTINCT a, b, 'both' FROM b)
        SELECT id, direction, count(*) AS n FROM x WHERE id LIKE 'nation_%' GROUP BY ALL""",
    "gra6_edges": f"""WITH {_G} SELECT src, dst, relation, 'from' AS direction FROM e WHERE src LIKE 'supplier_%' UNION ALL SELECT src, dst, relation, 'to' FROM e WHERE dst LIKE 'region_%'""",
    "ret12_labels": f"""WITH d AS ({plain(_CASED)}), m AS (SELECT doc_id, regexp_extract(text, '(Client [a-j]+) works at (.*)$', ['subject', 'object']) AS x FROM d
        ), l AS (SELECT doc_id, 0 AS side, trim(x.subject) AS label FROM m UNION ALL SELECT doc_id, 1, trim(x.object) FROM m)
        SELECT {_ID.replace('{0}', 'label')} AS id, arg_max(label, (doc_id, side)) AS label FROM l GROUP BY 1""",
    "gra7_degree_summary": f"""WITH {_G}, d AS (SELECT n.id, count(x.id) AS degree FROM n LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x USING (id) GROUP BY n.id
        ), s AS (SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(DISTINCT relation) FROM e) AS n_relations)
        SELECT n_nodes, n_edges, n_relations, round(n_edges / (n_nodes * (n_nodes - 1)), 9) AS density, round(2 * n_edges / n_nodes, 6) AS avg_degree, degree, count(*) AS n FROM s, d GROUP BY ALL""",
    "gra7_top_degrees": f"WITH {_G} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 5",
    "gra8_find_paths": _PATHS + """ SELECT start, "end", path FROM paths""",
    "gra9_ego_graph": f"""WITH {_G}, s AS (SELECT id AS seed FROM n WHERE id LIKE 'supplier_%'), r AS (
            SELECT seed, seed AS id FROM s UNION SELECT seed, b FROM s JOIN b ON a = seed UNION SELECT seed, y.b FROM s JOIN b x ON x.a = seed JOIN b y ON y.a = x.b)
        SELECT seed, count(*) AS n_nodes, (SELECT count(*) FROM e JOIN r p ON p.seed = r.seed AND p.id = e.src JOIN r q ON q.seed = r.seed AND q.id = e.dst) AS n_edges FROM r GROUP BY seed""",
    "gra10_shortest_path": _PATHS + """ SELECT start, "end", arg_min(path, (size, path)) AS path FROM paths GROUP BY ALL""",
    "gra11_to_triples": f"WITH {_G} SELECT src AS subject, relation AS predicate, dst AS object FROM e",
    "ret8_graph_hybrid": _EGO + """, f AS (SELECT query_id, chunk_id, 0.6 * CASE WHEN rank % 2 = 1 THEN 1.0 / rank ELSE 0 END + 0.4 AS score FROM g WHERE rank <= 10)
        SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f.score DESC, chunk_id) AS INT) AS rank FROM f QUALIFY rank <= 5""",
    "ret9_link_passages": """SELECT doc_id AS query_id, 'item_' || item_id AS id, strpos(lower(d.text), lower(b.text)) AS place FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) AND b.text <> ''""",
    "ret9_link_entities": _EGO + " SELECT query_id, id, place FROM l",
    "ret10_ego_topk": _EGO + f""", c AS (SELECT query_id, hop, id, {_CHUNK.format('kg_')} AS chunk_id FROM h JOIN n USING (id))
        SELECT query_id, chunk_id, CAST(1.0 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hop, id) AS INT) AS rank FROM c WHERE chunk_id IS NOT NULL QUALIFY rank <= 5""",
    "ret11_path_topk": _EGO + """, two AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, length(label) DESC, id) AS i FROM l
        ), pr AS (SELECT query_id, max(id) FILTER (i = 1) AS s, max(id) FILTER (i = 2) AS f FROM two WHERE i <= 2 GROUP BY query_id
        ), o AS (SELECT query_id, s AS id FROM pr JOIN e ON src = s AND dst = f UNION SELECT query_id, f FROM pr JOIN e ON src = s AND dst = f)
        SELECT query_id, chunk_id, CAST(1.0 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INT) AS rank
        FROM (SELECT query_id, id, """ + _CHUNK.format("kg_path_") + """ AS chunk_id FROM o JOIN n USING (id)) c WHERE chunk_id IS NOT NULL""",
    "ret12_graph_from_documents": _RELATIONS + f""", ends AS (SELECT {_S} AS id FROM rel UNION ALL SELECT {_O} FROM rel) SELECT id, count(*) AS degree FROM ends GROUP BY id""",
}
