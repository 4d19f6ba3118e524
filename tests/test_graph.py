"""Graph and cycle operators on hand-made and random graphs, against plain Python."""

from __future__ import annotations

import itertools
import random
from collections import deque

import pytest

from girder.operators import cycles, graph


def make(spark, n, pairs):
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    rows = [(a, b, 1 + (a + b) % 3, (a + b) % 2 == 0, False) for a, b in pairs]
    return nodes, spark.createDataFrame(rows, "source long, target long, import_count int, is_type_only boolean, is_deferred boolean")


def randoms():
    rng = random.Random(4)
    for n, m in ((1, 0), (4, 5), (7, 14), (9, 16)):
        pool = [(a, b) for a in range(n) for b in range(n) if a != b]
        yield n, sorted(rng.sample(pool, min(m, len(pool))))


GRAPHS = list(randoms()) + [(3, [(0, 1), (1, 2), (0, 2)]), (3, [(0, 1), (1, 2), (2, 0)]), (5, [(0, 1), (1, 0), (2, 3), (3, 2)]), (2, [(0, 0), (0, 1)])]


def steps(pairs, s):
    far, front = {}, deque([(s, 0)])
    while front:
        x, d = front.popleft()
        for a, b in pairs:
            if a == x and b not in far:
                far[b] = d + 1
                front.append((b, d + 1))
    return far


@pytest.mark.parametrize("n, pairs", GRAPHS)
@pytest.mark.parametrize("most", [graph.BROADCAST_EDGES, 0])
def test_reach(spark, n, pairs, most):
    _, e = make(spark, n, pairs)
    want = {(s, v, d) for s in range(n) for v, d in steps(pairs, s).items()}
    assert {tuple(r) for r in graph.reach(e, broadcast_edges=most).collect()} == want
    near = {x for x in want if x[2] <= 2}
    assert {tuple(r) for r in graph.reach(e, most=2, broadcast_edges=most).collect()} == near


@pytest.mark.parametrize("n, pairs", GRAPHS)
def test_shortest_paths(spark, n, pairs):
    _, e = make(spark, n, pairs)
    want = {}
    for s, t in itertools.product(range(n), repeat=2):
        for k in range(1, n + 1):
            found = [p for p in itertools.permutations(range(n), k) if p[0] == s and p[-1] == t and all((a, b) in pairs for a, b in itertools.pairwise(p))]
            if found:
                want[s, t] = list(min(found))
                break
    asked = spark.createDataFrame(list(itertools.product(range(n + 1), repeat=2)), "source long, target long")
    got = {(r.source, r.target): list(r.path) for r in graph.shortest_paths(e, asked).collect() if max(r.source, r.target) < n}
    assert got == want


@pytest.mark.parametrize("n, pairs", GRAPHS[2:])
def test_forms_by_joins(spark, n, pairs):
    nodes, e = make(spark, n, pairs)
    asked = spark.createDataFrame(list(itertools.product(range(n + 1), repeat=2)), "source long, target long")
    for find in (lambda **k: graph.shortest_paths(e, asked, **k), lambda **k: graph.strong_components(e, **k)):
        assert sorted(find(broadcast_edges=0).collect()) == sorted(find().collect())
    want = {r.id: r.centrality for r in graph.betweenness(nodes, e).collect()}
    for size in (3, 100):
        got = {r.id: r.centrality for r in graph.betweenness(nodes, e, 0, size).collect()}
        assert got == pytest.approx(want)


def test_components_of_long_rings(spark):
    ring = [(i, (i + 1) % 5000) for i in range(5000)] + [(5000 + i, 5001 + i) for i in range(5000)]
    _, e = make(spark, 1, ring)
    assert {(r.id, r.scc) for r in graph.strong_components(e).collect()} == {(i, 0) for i in range(5000)}


@pytest.mark.parametrize("n, pairs", GRAPHS)
def test_betweenness(spark, n, pairs):
    nodes, e = make(spark, n, pairs)
    want = dict.fromkeys(range(n), 0.0)
    for s, t in itertools.permutations(range(n), 2):
        paths = []
        for k in range(2, n + 1):
            paths = [p for p in itertools.permutations(range(n), k) if p[0] == s and p[-1] == t and all((a, b) in pairs for a, b in itertools.pairwise(p))]
            if paths:
                break
        for p in paths:
            for v in p[1:-1]:
                want[v] += 1 / len(paths)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1
    got = {r.id: r.centrality for r in graph.betweenness(nodes, e).collect()}
    assert got == pytest.approx({v: x * scale for v, x in want.items()})


@pytest.mark.parametrize("n, pairs", GRAPHS)
def test_components_cycles_and_levels(spark, n, pairs, monkeypatch):
    nodes, e = make(spark, n, pairs)
    far = {s: steps(pairs, s) for s in range(n)}
    scc = {v: min(u for u in range(n) if u == v or u in far[v] and v in far[u]) for v in range(n)}
    members = {v: r for v, r in scc.items() if list(scc.values()).count(r) > 1}
    assert {r.id: r.scc for r in graph.strong_components(e).collect()} == members
    want = {(*p, p[0]) for k in range(2, n + 1) for p in itertools.permutations(range(n), k) if p[0] == min(p) and all(x in pairs for x in itertools.pairwise((*p, p[0])))}
    found = cycles.elementary_cycles(e)
    assert {tuple(r.path) for r in found.collect()} == want
    few = cycles.elementary_cycles(e, cap=2).collect()
    for root in set(members.values()):
        first = sorted((p for p in want if scc[p[0]] == root), key=lambda p: (len(p), p))[:2]
        assert sorted((tuple(r.path) for r in few if r.scc == root), key=lambda p: (len(p), p)) == first
    bad = {v for v in range(n) if any(v == u or v in far[u] for u in range(n) if u in far[u])}
    levels = {v: max([k for k in range(n) for p in itertools.permutations([x for x in range(n) if x not in bad], k + 1) if p[-1] == v and all(x in pairs for x in itertools.pairwise(p))]) for v in range(n) if v not in bad} if n < 8 else None
    for most in (graph.BROADCAST_EDGES, 0):
        monkeypatch.setattr(graph, "small", lambda e, m=most, f=graph.small: f(e, m)) if most == 0 else None
        got = {r.id: r.level for r in graph.topological_levels(nodes, e).collect()}
        assert levels is None or got == levels


def test_cycle_report(spark):
    _, e = make(spark, 8, [(0, 1), (1, 2), (2, 0), (3, 0), (4, 0), (5, 1), (6, 7), (7, 6)])
    found = cycles.elementary_cycles(e)
    rows = {tuple(r.path): r for r in cycles.report(found, e).collect()}
    assert rows[0, 1, 2, 0].outside == 3 and rows[0, 1, 2, 0].severity == "medium" and rows[6, 7, 6].severity == "low"
    assert (rows[0, 1, 2, 0].source, rows[0, 1, 2, 0].target) == (2, 0) or rows[0, 1, 2, 0].source in (0, 1)
    assert {r.id: r.cycles for r in cycles.participation(found).collect()} == {0: 1, 1: 1, 2: 1, 6: 1, 7: 1}


def test_neighborhood_and_collapse(spark):
    _, e = make(spark, 5, [(0, 1), (1, 2), (3, 1), (2, 4)])
    assert {r.id for r in graph.neighborhood(e, 1, 1).collect()} == {0, 1, 2, 3}
    assert {r.id for r in graph.neighborhood(e, 1, 0).collect()} == {1}
    nodes = spark.createDataFrame([("p.a.x", 1, 5), ("p.a.y", 2, 6), ("p.b.x", 3, 7)], "name string, ord int, loc int")
    edges = spark.createDataFrame([("p.a.x", "p.b.x", 2), ("p.a.y", "p.b.x", 3), ("p.a.x", "p.a.y", 9)], "source string, target string, import_count int")
    kept, joined = graph.collapse(nodes, edges, 1)
    assert {(r.name, r.loc) for r in kept.collect()} == {("p.a", 5), ("p.b", 7)} and [tuple(r) for r in joined.collect()] == [("p.a", "p.b", 5)]
