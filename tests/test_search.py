"""Searches from nodes and from places on edges against a plain best-first search."""

import heapq

import pytest

from tarmac.operators import paths
from tarmac.plans import iterative
from tarmac.sources import fixtures as X


def best_first(ways, starts, most, stops=(), barred=frozenset()):
    """{node: distance} of nodes nearer than `most`, stops not gone beyond."""
    dist, todo = {}, [(d, v, True) for v, d in starts if d < most]
    heapq.heapify(todo)
    while todo:
        far, v, begun = heapq.heappop(todo)
        if v in dist:
            continue
        dist[v] = far
        if v in stops and not begun:
            continue
        for b, w in ways.get(v, []):
            if (v, b) not in barred and b not in dist and far + w < most:
                heapq.heappush(todo, (far + w, b, False))
    return dist


def plain_follow(ways, edge, along, size, length, stops, sign):
    """Places (src, dst, along) and nodes passed, by Dijkstra's order: an edge belongs to the end that is taken off the heap first."""
    a, b = edge
    rest = size - along
    if rest >= length:
        return {(a, b, along + length)}, set()
    if b in stops:
        return {(a, b, size)}, set()
    used, places, seen, todo, done = {(min(edge), max(edge))}, set(), set(), [(rest, b)], set()
    while todo:
        far, v = heapq.heappop(todo)
        if v in done:
            continue
        done.add(v)
        seen.add(v)
        for w, step in ways.get(v, []):
            pair = (min(v, w), max(v, w))
            if pair in used:
                continue
            used.add(pair)
            if far + step >= length:
                places.add((v, w, length - far))
            elif w in stops:
                places.add((v, w, step))
            else:
                heapq.heappush(todo, (far + step, w))
    return places, seen


@pytest.mark.parametrize("backwards", [False, True])
def test_follow_from_places(spark, data, backwards):
    net = {(r.src, r.dst): r["size"] for r in iterative._network(spark, data).collect()}
    ways = {}
    for (a, b), w in net.items():
        ways.setdefault(a, []).append((b, w))
        ways.setdefault(b, []).append((a, w))
    nodes = [r.node_id for r in X.nodes(spark, data).collect()]
    places, seen = iterative._followed_places(spark, data, backwards)
    got, passed = {}, {}
    for r in places.collect():
        got.setdefault(r.source, set()).add((r.src, r.dst, round(r.along, 6)))
    for r in seen.collect():
        passed.setdefault(r.source, set()).add(r.node)
    stopped = 0
    for p in iterative._positions(spark, data).collect():
        stops = {v for v in nodes if v % 7 == 3 and (v + p.source) % 2 == 1 and abs(v - p.src) <= 300}
        size = net[p.src, p.dst]
        want, nodes_passed = plain_follow(ways, (p.dst, p.src) if backwards else (p.src, p.dst), size - p.along if backwards else p.along, size, 70.0, stops, 1)
        if backwards:  # the network runs both ways, so going against an edge is going along its reverse
            want = {(b, a, net[min(a, b), max(a, b)] - x) for a, b, x in want}
        assert {(a, b) for a, b, _ in got.get(p.source, set())} == {(a, b) for a, b, _ in want}
        assert sorted(x for *_, x in got.get(p.source, set())) == pytest.approx(sorted(x for *_, x in want), abs=1e-5)
        assert passed.get(p.source, set()) == nodes_passed
        stopped += any(min(abs(x), abs(x - net[min(a, b), max(a, b)])) < 1e-9 for a, b, x in want)
    assert stopped


def test_backwards_goes_against_one_way_edges(spark):
    edges = spark.createDataFrame([(1, 2, 10.0), (2, 3, 10.0), (4, 2, 10.0)], "src long, dst long, size double")
    starts = spark.createDataFrame([(7, 2, 3, 5.0)], "source long, src long, dst long, along double")
    there, _ = paths.follow_distance(edges, starts, 8.0)
    back, seen = paths.follow_distance(edges, starts, 8.0, backwards=True)
    assert there.count() == 0 and {tuple(r)[1:] for r in back.collect()} == {(1, 2, 7.0), (4, 2, 7.0)} and [r.node for r in seen.collect()] == [2]
    stops = spark.createDataFrame([(7, 2)], "source long, node long")
    assert [tuple(r)[1:] for r in paths.follow_distance(edges, starts, 8.0, True, stops)[0].collect()] == [(2, 3, 0.0)]
    node = spark.createDataFrame([(7, 1)], "source long, node long")
    assert [tuple(r)[1:] for r in paths.follow_distance(edges, node, 15.0)[0].collect()] == [(2, 3, 5.0)]
    assert paths.follow_distance(edges.where("false"), starts, 8.0)[0].count() == 0


def test_closest_reachable_and_its_way(spark, data):
    net = {(r.src, r.dst): r["size"] for r in iterative._network(spark, data).collect()}
    ways = {}
    for (a, b), w in net.items():
        ways.setdefault(a, []).append((b, w))
        ways.setdefault(b, []).append((a, w))
    rows = {r.source: r for r in iterative._reachable(spark, data).collect()}
    at = {r.source: r for r in iterative._positions(spark, data).collect()}
    long_ways = 0
    for k, r in rows.items():
        p = at[k]
        own = {(p.src, p.dst), (p.dst, p.src)}
        if r.way is None:
            assert (r.src, r.dst) == (p.src, p.dst)
            continue
        dist = best_first(ways, [(p.dst, net[p.src, p.dst] - p.along), (p.src, p.along)], 60.0, barred=own)
        way = [tuple(e) for e in r.way]
        assert (way[-1][1] if way else r.src) == r.src and all(a[1] == b[0] for a, b in zip(way, way[1:])) and not own & {*way, (r.src, r.dst)}
        begin = way[0][0] if way else r.src
        before = net[p.src, p.dst] - p.along if begin == p.dst else p.along
        assert begin in (p.src, p.dst) and before + sum(net[min(e), max(e)] for e in way) == pytest.approx(dist[r.src], abs=1e-6)
        long_ways += len(way) > 1
    assert long_ways and len(rows) > len(at) / 2


def test_stops_are_reached_but_not_passed(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(5)], "src long, dst long, size double")
    one = spark.createDataFrame([(0,), (2,)], "source long")
    stops = spark.createDataFrame([(0, 2), (2, 2), (0, 2)], "source long, node long")
    assert {(r.source, r.node, r.dist) for r in paths.shortest_paths(edges, one, 3.0, stops).collect()} == {(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (2, 2, 0.0), (2, 3, 1.0), (2, 4, 2.0), (2, 5, 3.0)}


def test_no_way_straight_back_over_edges_without_length(spark):
    """Of equal distances the least predecessor stays, but none that was reached over the node itself: ways end where the search began."""
    edges = spark.createDataFrame([(5, 7, 1.0), (7, 3, 0.0), (3, 7, 0.0), (7, 5, 1.0), (3, 9, 2.0), (9, 3, 2.0)], "src long, dst long, size double")
    found = paths.shortest_paths(edges, spark.createDataFrame([(5,)], "source long"), 3.0)
    assert {(r.node, r.dist, r.pred) for r in found.collect()} == {(5, 0.0, None), (7, 1.0, 5), (3, 1.0, 7), (9, 3.0, 3)}
    far = spark.createDataFrame([(5, 9), (5, 7), (5, 5), (5, 8)], "source long, target long")
    assert {(r.target, r.step, r.node) for r in paths.path_to(found, far).collect()} == {(9, 0, 9), (9, 1, 3), (9, 2, 7), (7, 0, 7)}
