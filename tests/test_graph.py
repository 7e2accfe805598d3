import random
from collections import deque

import pytest

from refloom.operators import graph as G
from refloom.operators.trace import analyze


def _graph(spark, edges, n):
    return spark.createDataFrame([(a, b) for a, b in edges], "src bigint, dst bigint"), spark.createDataFrame([(i, 2000 + i % 5, "analyzed" if i % 2 else "no_match") for i in range(n)], "id bigint, year int, status string")


def _random_edges(seed, n=24, m=70):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def _brandes(edges, n):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    total = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        dist, paths, before, order, queue = {s: 0}, {s: 1.0}, {}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    before.setdefault(w, []).append(v)
        part = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != s:
                total[w] += part[w]
    return {k: round(v / ((n - 1) * (n - 2)), 6) for k, v in total.items()}


@pytest.mark.parametrize("held", [0, 1_000])
def test_betweenness_in_workers_and_by_joins(spark, held, monkeypatch):
    monkeypatch.setattr(G, "SOURCES_A_BATCH", 7)
    edges = _random_edges(1)
    e, n = _graph(spark, edges, 24)
    got = {r.id: r.betweenness for r in G.betweenness(e, n, held_edges=held).collect()}
    want = _brandes(edges, 24)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_pagerank_equals_power_iteration(spark):
    edges, n = _random_edges(2, 15, 30), 15
    e, nodes = _graph(spark, edges, n)
    out = {i: [b for a, b in edges if a == i] for i in range(n)}
    r = dict.fromkeys(range(n), 1 / n)
    for _ in range(8):
        lost = sum(r[i] for i in r if not out[i])
        r = {j: 0.85 * (sum(r[i] / len(out[i]) for i in out if j in out[i]) + lost / n) + 0.15 / n for j in r}
    got = {x.id: x.pagerank for x in G.pagerank(e, nodes, rounds=8).collect()}
    assert all(abs(got[i] - r[i]) < 1e-9 for i in r)
    settled = {x.id: x.pagerank for x in G.pagerank(e, nodes).collect()}
    assert abs(sum(settled.values()) - 1) < 1e-6


def test_hot_sources_change_nothing(spark, monkeypatch):
    from refloom.plans import skew

    e, nodes = _graph(spark, [(0, i) for i in range(1, 20)] + [(3, 4)], 20)
    want = {x.id: round(x.pagerank, 9) for x in G.pagerank(e, nodes, rounds=4).collect()}
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (3,))
    monkeypatch.setattr(G, "HOT_ROWS", 3)
    assert {x.id: round(x.pagerank, 9) for x in G.pagerank(e, nodes, rounds=4).collect()} == want
    assert {x.component for x in G.components(e, nodes).collect()} == {0}


def test_components_equal_union_find(spark):
    for seed in (3, 4):
        edges = _random_edges(seed, 40, 30)
        e, nodes = _graph(spark, edges, 40)
        root = list(range(40))
        for _ in range(40):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        assert {r.id: r.component for r in G.components(e, nodes).collect()} == dict(enumerate(root))


def test_levels_of_a_trace(spark):
    e, _ = _graph(spark, [(0, 1), (1, 2), (2, 3), (0, 2), (2, 0)], 4)
    root = spark.createDataFrame([(0,)], "id bigint")
    assert {r.id: r.depth for r in G.bfs(e, root, 2).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert {r.id: r.depth for r in G.bfs(e, root, 0).collect()} == {0: 0}


def test_reverse_trace_needs_keywords_within_the_limit(spark):
    rows = [("c1", "r", 1, 0), ("c2", "r", 2, None), ("c3", "r", 3, 0), ("c3", "r", 4, 1), ("d", "c3", 5, 0), ("c4", "r", 9, 0)]
    e = spark.createDataFrame(rows, "src string, dst string, edge_id bigint, kw_no int")
    root = spark.createDataFrame([("r",)], "id string")
    assert {r.id: r.depth for r in G.reverse_trace(e, root, 2, 4, 1).collect()} == {"r": 0, "c1": 1, "c3": 1, "d": 2}
    assert {r.id for r in G.reverse_trace(e, root, 1, 4, 2).collect()} == {"r", "c3"}


def test_empty_graph_and_analysis(spark):
    e, nodes = _graph(spark, [], 0)
    out = {k: v.collect() for k, v in analyze(nodes, e).items()}
    assert out["global"][0].n_nodes == 0 and out["global"][0].density == 0 and not out["node_metrics"] and not out["timeline"] and not out["pivot_papers"]
    e, nodes = _graph(spark, _random_edges(5, 10, 20), 10)
    out = {k: v.collect() for k, v in analyze(nodes, e).items()}
    assert len(out["node_metrics"]) == 10 and {r.year for r in out["timeline"]} == set(range(2000, 2005)) and any(r.is_pivot for r in out["node_metrics"])


def test_nearest_vectors_in_blocks_equal_brute_force(spark):
    rng = random.Random(6)
    vec = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame([*vec, (99, None)], "vec_id bigint, embedding array<float>")
    dots = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(i, j) for i, a in vec for j, _ in sorted(((j, dots(a, b)) for j, b in vec if j < i), key=lambda x: (-x[1], x[0]))[:3]}
    for block in (7, 1000):
        assert {(r.src, r.dst) for r in G.nearest_smaller(df, 3, block).collect()} == want


def test_views_keep_the_first(spark):
    n = spark.createDataFrame([("DOI:a ", None, "u", "t2"), ("doi:a", "2024-01-01", "u", "t1"), (None, None, None, None), (" ", None, None, "x")], "paper_id string, added_at string, url string, title string")
    assert [(r.id, r.title) for r in G.node_view(n).collect()] == [("doi:a", "t1")]
    e = spark.createDataFrame([(2, "A", "b", "primary", 1, "x", None), (1, "a ", "B", "primary", 1, "y", None), (3, "a", "a", "primary", 1, "z", None), (4, "a", None, "primary", 1, "z", None)], "edge_id bigint, source_id string, target_id string, edge_type string, depth int, context string, seen_at string")
    assert [(r.src, r.dst, r.edge_id) for r in G.edge_view(e).collect()] == [("a", "b", 1)]
