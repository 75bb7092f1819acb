"""Graph retrieval and ego graphs around hubs, where a row for each pair of a seed and a node would be too many."""

import gc
import random

from granary.operators import graph, traversal


def most_rows(spark, make):
    """The rows of ``make()``, and the most rows that any node of the plans run for it put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    found = make().collect()
    gc.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs, most = store.executionsList(), 0
    for i in range(before, runs.size()):
        told = runs.apply(i).metricValues()
        metrics = runs.apply(i).metrics()
        for j in range(metrics.size()):
            m = metrics.apply(j)
            if m.name() == "number of output rows" and told is not None and told.contains(m.accumulatorId()):
                most = max(most, int(told.apply(m.accumulatorId()).replace(",", "")))
    return found, most


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "r", 1.0, "e") for a, b in pairs], "src string, dst string, relation string, weight double, evidence string")


def test_queries_at_a_hub_take_its_first_chunks(spark):
    """100 queries link to a hub of 1000 neighbours: its list is made once and cut before it meets them."""
    nodes = spark.createDataFrame([("hub", "hub"), *((f"x{i:04}", f"leaf no{i:04}") for i in range(1000))], "id string, label string")
    edges = _edges(spark, [("hub", f"x{i:04}") for i in range(1000)])
    queries = spark.createDataFrame([(i, f"the hub and leaf no{i:04}") for i in range(100)], "query_id long, text string")
    found, most = most_rows(spark, lambda: graph.ego_topk(queries, nodes, edges, 1, 4))
    want = {(q, c, r) for q in range(100) for r, c in enumerate(["hub", f"x{q:04}", *[f"x{i:04}" for i in range(3) if i != q][:2]], 1)}
    assert {(r.query_id, r.chunk_id, r.rank) for r in found} == want and len(found) == 400
    assert most < 20_000  # 100 times 1000 pairs of a query and a node before


def test_ego_chunks_of_all_hops_against_plain_search(spark):
    r = random.Random(3)
    ids = [f"n{i:02}" for i in range(40)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(60)] + [("n00", i) for i in ids[20:]]
    nodes = spark.createDataFrame([(i, f"label {i}", "text" if int(i[1:]) % 3 == 0 else None) for i in ids], "id string, label string, content string")
    chunks = [(i, f"c{j}{i}") for i in ids if int(i[1:]) % 4 == 1 for j in range(2)]
    asked = [(q, r.sample(ids, r.randint(0, 3))) for q in range(25)]
    queries = spark.createDataFrame([(q, " ".join(f"label {i}" for i in own)) for q, own in asked], "query_id long, text string")
    of = {i: [c for j, c in chunks if j == i] or ([f"kg_{i}"] if int(i[1:]) % 3 == 0 else []) for i in ids}
    for hops in (0, 1, 2, 3):
        want = set()
        for q, own in asked:
            hop = {i: 0 for i in own}
            for h in range(1, hops + 1):
                for a, b in pairs:
                    for x, y in ((a, b), (b, a)):
                        if hop.get(x) == h - 1 and y not in hop:
                            hop[y] = h
            ranked = sorted((h, i, c) for i, h in hop.items() for c in of[i])[:5]
            want |= {(q, c, n) for n, (_, _, c) in enumerate(ranked, 1)}
        got = graph.ego_topk(queries, nodes, _edges(spark, pairs), hops, 5, spark.createDataFrame(chunks, "id string, chunk_id string"))
        assert {(x.query_id, x.chunk_id, x.rank) for x in got.collect()} == want


def test_twins_at_hubs_are_walked_once(spark):
    """Five hubs of 300 leaves each, all leaves seeds in an order that mixes the hubs."""
    pairs = [(f"x{i:04}", f"hub{i % 5}") for i in range(1500)] + [(f"hub{i}", "root") for i in range(5)] + [("x0000", "hub0"), ("y", "y"), ("z", "y")]
    seeds = spark.createDataFrame([(f"x{i:04}",) for i in range(1500)] + [("root",), ("y",), ("far",)], "seed string")
    found, most = most_rows(spark, lambda: traversal.ego_sizes(_edges(spark, pairs), seeds, 2))
    want = {(f"x{i:04}", 302, 302 if i % 5 == 0 else 301) for i in range(1500)} | {("root", 1506, 1506), ("y", 2, 2), ("far", 1, 0)}
    assert {(r.seed, r.n_nodes, r.n_edges) for r in found} == want and len(found) == len(want)
    assert most < 8_000  # a row for each leaf and word of seeds before, 36 000
