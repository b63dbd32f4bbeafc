"""Queries over the whole road network against plain Python: no road is left out before an operator."""

import heapq
import math

import pytest

import __spark_entry__  # noqa: F401
from tarmac.operators import paths
from tarmac.plans.catalog import QUERIES
from tarmac.sources import fixtures


@pytest.fixture(scope="module")
def net(spark, data):
    return {(min(r.src, r.dst), max(r.src, r.dst)): math.dist((r.x, r.y), (r.x1, r.y1)) for r in fixtures.roads(spark, data).collect()}


def degrees(net):
    n = {}
    for e in net:
        for v in e:
            n[v] = n.get(v, 0) + 1
    return n


def around(net):
    out = {}
    for (a, b), w in net.items():
        out.setdefault(a, []).append((b, w))
        out.setdefault(b, []).append((a, w))
    return out


def reach(ways, source, most):
    dist, todo = {}, [(0.0, source)]
    while todo:
        far, v = heapq.heappop(todo)
        if v not in dist:
            dist[v] = far
            todo_more = [(far + w, b) for b, w in ways.get(v, []) if b not in dist and far + w <= most]
            for x in todo_more:
                heapq.heappush(todo, x)
    return dist


def test_the_network_has_long_roads(net):
    assert any(w >= 28 for w in net.values())


@pytest.mark.parametrize("name, least, both", [("prune_dead_end_edges_whole", 26.0, False), ("prune_spurs_whole", 26.0, True), ("remove_hair_whole", 25.5, False)])
def test_prune(spark, data, net, name, least, both):
    n = degrees(net)
    dead = lambda e: min(n[v] for v in e) == 1 and (not both or max(n[v] for v in e) > 2)
    got = {(r.src, r.dst) for r in QUERIES[name](spark, data).collect()}
    assert got == {e for e, w in net.items() if not (dead(e) and w < least)}


def test_contract_chains_cover_every_road(spark, data, net):
    got = [(r.src, r.dst) for r in QUERIES["contract_chains"](spark, data).collect()]
    assert sorted(got) == sorted([e for e in net] + [e[::-1] for e in net])


def test_shortest_paths_and_path_to(spark, data, net):
    ways = around(net)
    nodes = [r.node_id for r in fixtures.nodes(spark, data).collect()]
    want = {(s, v): d for s in nodes for v, d in reach(ways, s, 110.0).items()}
    got = {(r.source, r.node): r.dist for r in QUERIES["shortest_paths_whole"](spark, data).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    walks = {}
    for r in QUERIES["path_to"](spark, data).collect():
        walks.setdefault((r.source, r.target), {})[r.step] = r.node
    assert {s for s, _ in walks} == {s for s in nodes if s in ways and any(w <= 110 for _, w in ways[s])}
    for (s, t), steps in walks.items():
        nodes_back = [steps[k] for k in sorted(steps)] + [s]
        size = sum(net[min(a, b), max(a, b)] for a, b in zip(nodes_back, nodes_back[1:], strict=False))
        assert abs(size - want[s, t]) < 1e-5 and all(want[s, t] >= d - 1e-9 for (q, _), d in want.items() if q == s)


def test_follow_distance_ends_on_long_roads_too(spark, data, net):
    got = QUERIES["follow_distance"](spark, data).collect()
    assert any(net[min(r.src, r.dst), max(r.src, r.dst)] >= 28 for r in got)
    assert all(0 <= r.along <= net[min(r.src, r.dst), max(r.src, r.dst)] + 1e-5 for r in got)


@pytest.mark.parametrize("name, cols", [("connect_terminals", ("a", "b")), ("connect_up", ("node",))])
def test_only_true_dead_ends_are_joined(spark, data, net, name, cols):
    n = degrees({e for e in net if name != "connect_up" or e[1] == e[0] + 40})  # connect_up runs over the columns of the lattice
    rows = QUERIES[name](spark, data).collect()
    assert rows or name != "connect_up"
    assert all(n[r[c]] == 1 for r in rows for c in cols)


@pytest.mark.parametrize("frame, margin", [((0.0, 0.0, 1000.0, 1300.0), 20.0), ((-9.0, -9.0, 1000.0, 1300.0), 0.0)])
def test_prune_roads(spark, data, net, frame, margin):
    at = {r.node_id: (r.x, r.y) for r in fixtures.nodes(spark, data).collect()}
    n, ways = degrees(net), around(net)
    inside = lambda v: all(frame[k] + margin <= at[v][k] <= frame[k + 2] - margin for k in (0, 1))
    gone, done = set(), set()
    for v in ways:
        for w, _ in ways[v] if n[v] != 2 else []:
            road = [v, w]
            while n[road[-1]] == 2 and road[-1] != v:
                road.append(next(b for b, _ in ways[road[-1]] if b != road[-2]))
            es = [(min(e), max(e)) for e in zip(road, road[1:], strict=False)]
            size, dead = sum(net[e] for e in es), [n[road[0]] == 1, n[road[-1]] == 1]
            if inside(road[0]) and inside(road[-1]) and (any(dead) and size < 80 or all(dead) and size < 400):
                gone.update(es)
    edges = spark.createDataFrame([(*e, w) for e, w in net.items()], "src long, dst long, size double")
    got = {(r.src, r.dst) for r in paths.prune_roads(fixtures.nodes(spark, data), edges, frame, margin=margin).collect()}
    assert got == set(net) - gone and (gone or margin)
    assert margin == 0 or got == {(r.src, r.dst) for r in QUERIES["prune_roads"](spark, data).collect()}


def test_network_tables(spark, data, net):
    from tarmac.sources import sinks

    n, weight = degrees(net), {r.node_id: r.x + r.y for r in fixtures.nodes(spark, data).collect()}
    t = sinks.node_edge_tables(spark.createDataFrame(list(weight.items()), "node_id long, weight double"), spark.createDataFrame(list(net), "src long, dst long"))
    edges = {r.edge_id: (r.src, r.dst) for r in t["edges"].collect()}
    assert sorted(edges.values()) == sorted([*net, *(e[::-1] for e in net)])
    assert {r.node_id: r.n for r in t["intersections"].collect()} == {v: k for v, k in n.items() if k != 2}
    rows, seen = t["segments"].collect(), []
    for r in rows:
        there, back = [edges[k] for k in r.out_edges], [edges[k] for k in r.back_edges]
        assert sorted(back) == sorted(e[::-1] for e in there) and all(a[1] == b[0] for a, b in zip(there, there[1:], strict=False))
        inner = [e[0] for e in there[1:]] or [there[0][0], there[-1][1]]
        assert abs(r.weight - sum(weight[v] for v in inner) / len(inner)) < 1e-9
        seen += there + back
    assert sorted(seen) == sorted(edges.values()) and len({r.segment_id for r in rows}) == len(rows) == QUERIES["network_segments"](spark, data).count()
