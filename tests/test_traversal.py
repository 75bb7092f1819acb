"""Paths, shortest paths and ego graphs of many seeds against plain searches."""

import random

import pytest

from granary.operators import traversal


def _graph(seed, n=14, m=40):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(n)] + ["n1_0", "n10x"]
    edges = [(r.choice(ids), r.choice(ids)) for _ in range(m)]
    edges += edges[:3] + [("hub", i) for i in ids] + [(i, "hub") for i in ids[:5]] + [("p", "q"), ("q", "q")]
    return ids, edges


def _simple_paths(edges, start, end, depth):
    out, todo = set(), [(start,)]
    while todo:
        path = todo.pop()
        for a, b in set(edges):
            if a == path[-1] and b not in path and len(path) <= depth:
                if b == end:
                    out.add((*path, b))
                else:
                    todo.append((*path, b))
    return out


def _frames(spark, edges, pairs):
    full = spark.createDataFrame([(a, b, "r", 1.0, "e") for a, b in edges], "src string, dst string, relation string, weight double, evidence string")
    return full, spark.createDataFrame(pairs, "start string, end string")


@pytest.mark.parametrize("seed, depth", [(1, 1), (2, 2), (3, 3), (4, 4)])
def test_paths_against_depth_first_search(spark, seed, depth):
    ids, edges = _graph(seed)
    r = random.Random(seed)
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(15)] + [("n0", "n0"), ("n1", "missing"), ("p", "q"), ("hub", "n3"), ("n2", "hub")]
    frames = _frames(spark, edges, pairs)
    want = {(s, e, p) for s, e in pairs if s != e for p in _simple_paths(edges, s, e, depth)}
    found = [(x.start, x.end, tuple(x.path)) for x in traversal.find_paths(*frames, depth).collect()]
    assert len(found) == len(want) and set(found) == want
    best = {}
    for s, e, p in want:
        best[s, e] = min(best.get((s, e), p), p, key=lambda p: (len(p), ">".join(p)))
    assert {(x.start, x.end): tuple(x.path) for x in traversal.shortest_paths(*frames, depth).collect()} == best


def test_halves_at_a_hub_stay_small(spark):
    """Behind a hub with 400 neighbours only those near an end are walked."""
    edges = [("start", "hub"), *(("hub", f"x{i}") for i in range(400)), *((f"x{i}", f"y{i}") for i in range(400)), ("x7", "end")]
    full, pairs = _frames(spark, edges, [("start", "end")])
    steps = full.selectExpr("src AS at", "dst AS next")
    goal = traversal.hop_distances(steps, pairs.selectExpr("end AS id"), 2)
    sizes = [level.count() for level in traversal.half_paths(steps, pairs.selectExpr("start AS id"), goal, 2, 3)]
    assert sizes == [1, 1, 1]  # the plain extension has 1, 1, 400
    assert [tuple(x.path) for x in traversal.find_paths(full, pairs, 3).collect()] == [("start", "hub", "x7", "end")]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_ego_graphs_of_many_seeds(spark, k):
    ids, edges = _graph(9, 90, 150)
    full, _ = _frames(spark, edges, [("a", "b")])
    seeds = [*ids, "hub", "alone"]
    near = {}
    for s in seeds:
        near[s] = {s: 0}
        for hop in range(1, k + 1):
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if near[s].get(x) == hop - 1 and y not in near[s]:
                        near[s][y] = hop
    frame = spark.createDataFrame([(s,) for s in [*seeds, seeds[0]]], "seed string")
    assert {(r.seed, r.id, r.hop) for r in traversal.ego_nodes(full, frame, k).collect()} == {(s, i, h) for s in seeds for i, h in near[s].items()}
    inside = {s: sorted(e for e in edges if e[0] in near[s] and e[1] in near[s]) for s in seeds}
    assert {(r.seed, r.n_nodes, r.n_edges) for r in traversal.ego_sizes(full, frame, k).collect()} == {(s, len(near[s]), len(inside[s])) for s in seeds}
    got = {}
    for r in traversal.ego_graph(full, frame, k)[1].collect():
        got.setdefault(r.seed, []).append((r.src, r.dst))
    assert {s: sorted(e) for s, e in got.items()} == {s: e for s, e in inside.items() if e}
    if k == 2:
        numbered = traversal.number_seeds(frame)
        assert traversal.ego_bits(full, numbered, k).count() < sum(map(len, near.values())) / 5
