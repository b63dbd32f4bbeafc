"""Map matching against a plain step-by-step search, over the queries' tables and over drawn-up ones."""

import math
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql.functions import expr

from tarmac.operators import matching
from tarmac.operators.graphs import edge_transitions, edge_transitions_first
from tarmac.operators.paths import road_graph
from tarmac.plans import iterative
from tarmac.plans.catalog import QUERIES
from tarmac.sources import fixtures as X


def away(e, p):
    """Distance of a point from an edge (x, y, x1, y1)."""
    x, y, x1, y1 = e
    size = (x1 - x) ** 2 + (y1 - y) ** 2
    t = max(0.0, min(1.0, ((p[0] - x) * (x1 - x) + (p[1] - y) * (y1 - y)) / size)) if size else 0.0
    return math.hypot(x + t * (x1 - x) - p[0], y + t * (y1 - y) - p[1])


def gap(e, p):
    x, y, x1, y1 = e
    return max(min(x, x1) - p[0], p[0] - max(x, x1), min(y, y1) - p[1], p[1] - max(y, y1))


def emissions(roads, p, sigma, tolerance):
    for wide in (tolerance, 2 * tolerance, 4 * tolerance):
        near = [k for k, e in roads.items() if gap(e, p) <= wide]
        if len(near) >= 2:
            break
    scores = {k: math.exp(-0.5 * away(roads[k], p) ** 2 / sigma**2) for k in near}
    total = sum(scores.values())
    return {k: -math.log(v / total) for k, v in scores.items() if v > 0}


def search(fixes, roads, moves, sigma, tolerance, per):
    """(least cost, cost of a given chain): plain search, fix by fix and move by move."""
    hops = [1 if per is None else max(1, math.ceil(math.dist(a, b) / per)) for a, b in zip(fixes, fixes[1:])]

    def on(state, n):
        for _ in range(n):
            new = {}
            for e, c in state.items():
                for to, m in moves[e]:
                    new[to] = min(new.get(to, math.inf), c + m)
            state = new
        return state

    seen = [emissions(roads, p, sigma, tolerance) for p in fixes]
    state = {k: 0.0 for k, e in roads.items() if gap(e, fixes[0]) <= tolerance}
    for n, em in zip(hops, seen[1:]):
        state = {k: c + em[k] for k, c in on(state, n).items() if k in em}

    def of(chain):
        return sum(on({a: 0.0}, n)[b] + em[b] for a, b, n, em in zip(chain, chain[1:], hops, seen[1:]))

    return min(state.values(), default=None), of, hops


def checked(spark, obs, roads, sparse):
    net = {(r.src, r.dst): (r.x, r.y, r.x1, r.y1) for r in roads.collect()}
    moves = defaultdict(list)
    for r in (edge_transitions(roads) if sparse else edge_transitions_first(roads)).collect():
        if r.p > 0:
            moves[r.src, r.dst].append(((r.src, r.dst) if r.to_dst is None else (r.dst, r.to_dst), -math.log(r.p)))
    traces = defaultdict(list)
    for r in obs.orderBy("trace_id", "ts").collect():
        traces[r.trace_id].append((r.x, r.y))
    rows = (matching.map_match_sparse if sparse else matching.map_match)(obs, roads).orderBy("trace_id", "step").collect()
    got = defaultdict(list)
    for r in rows:
        assert r.step == len(got[r.trace_id])
        got[r.trace_id].append((r.src, r.dst))
        x, y, x1, y1 = net[r.src, r.dst]
        size, p = math.dist((x, y), (x1, y1)), traces[r.trace_id][r.step]
        at = (x + (x1 - x) * r.along / size, y + (y1 - y) * r.along / size)
        assert math.dist(at, p) == pytest.approx(away((x, y, x1, y1), p), abs=1e-6)
    for t, fixes in traces.items():
        if len(fixes) < (5 if sparse else 2):
            assert not sparse or t not in got
            continue
        best, cost, _ = search(fixes, net, moves, *((30.0, 100.0, 50.0) if sparse else (25.0, 30.0, None)))
        assert (best is None) == (t not in got)
        if best is not None:
            assert len(got[t]) == len(fixes) and cost(got[t]) == pytest.approx(best, abs=1e-6)
    return got, moves, traces


def test_dense_as_plain_search(spark, data):
    got, *_ = checked(spark, iterative._walks(spark, data), X.roads(spark, data), False)
    assert len(got) >= 3


def test_sparse_as_plain_search_and_hits(spark, data):
    obs, roads = iterative._thinned(spark, data), iterative._wide(X.roads(spark, data))
    got, moves, traces = checked(spark, obs, roads, True)
    assert got
    ways = matching.matched_ways(obs, roads).collect()
    cost = {(a, b): m for a, on in moves.items() for b, m in on}
    hits = Counter()
    for r in ways:
        way = [tuple(e) for e in r.way]
        a, b = got[r.trace_id][r.step : r.step + 2]
        fixes = traces[r.trace_id][r.step : r.step + 2]
        assert way[0] == a and way[-1] == b and len(way) == 1 + max(1, math.ceil(math.dist(*fixes) / 50))
        state = {a: 0.0}
        for _ in way[1:]:
            new = {}
            for e, c in state.items():
                for to, m in moves[e]:
                    new[to] = min(new.get(to, math.inf), c + m)
            state = new
        assert sum(cost[e] for e in zip(way, way[1:])) == pytest.approx(state[b], abs=1e-6)
        hits.update(b for a, b in zip(way, way[1:]) if a != b)
    assert len(ways) == sum(len(x) - 1 for x in got.values())
    assert {(r.src, r.dst): r.hits for r in QUERIES["edge_hits_matched"](spark, data).collect()} == hits and sum(hits.values()) > len(got)


def test_a_long_trace_beside_short_and_odd_ones(spark):
    """A trace of a thousand fixes, one of one fix, one far from all roads, one with a hole, nulls, and repeated times."""
    roads = spark.createDataFrame([(i, (i + 1) % 40, 50.0 * i, 0.0, 50.0 * i + 50, 0.0) for i in range(39)] + [(39, 0, 1950.0, 0.0, 0.0, 0.0)], "src long, dst long, x double, y double, x1 double, y1 double")
    rows = [(1, k, 25.0 * k % 1950, 3.0 + k % 2) for k in range(1001)] + [(2, 0, 60.0, 1.0), (3, 0, 9e6, 9e6), (3, 1, 9e6, 9e6), (4, 0, 10.0, 0.0), (4, 1, 1200.0, 0.0), (5, 0, 1.0, 1.0), (5, 0, 2.0, 1.0), (None, 0, 1.0, 1.0), (5, None, 1.0, 1.0)]
    obs = spark.createDataFrame(rows, "trace_id long, ts long, x double, y double")
    got, *_ = checked(spark, obs.dropna(), roads, False)
    assert len(got[1]) == 1001 and len(got[2]) == 1 and 3 not in got and len(got[5]) == 2
    assert matching.map_match(obs.where("false"), roads).count() == 0 == matching.map_match(obs, roads.where("false")).count()


def test_weights_decide_at_crossings(spark):
    roads = spark.createDataFrame([(0, 1, 0.0, 0.0, 300.0, 0.0), (1, 2, 300.0, 0.0, 400.0, 1.0), (1, 3, 300.0, 0.0, 400.0, -1.0), (2, 4, 400.0, 1.0, 500.0, 0.0), (3, 4, 400.0, -1.0, 500.0, 0.0), (4, 5, 500.0, 0.0, 600.0, 0.0)], "src long, dst long, x double, y double, x1 double, y1 double")
    obs = spark.createDataFrame([(1, k, x, 0.0) for k, x in enumerate((20.0, 60.0, 150.0, 510.0, 580.0))], "trace_id long, ts long, x double, y double")
    for heavy in (2, 3):
        weights = roads.select("src", "dst").selectExpr("src", "dst", f"CASE WHEN dst = {heavy} THEN 9 ELSE 1 END AS weight")
        along = {(e.src, e.dst) for r in matching.matched_ways(obs, roads, weights).collect() for e in r.way}
        assert (1, heavy) in along and (1, 5 - heavy) not in along


def road_search(fixes, place, roads, pace):
    """[{road: (cost, along, origin)}] after each fix: plain trellis over roads and the progress along them."""
    size = {e: math.dist(p[:2], p[2:]) for e, p in place.items()}
    before = {r: [sum(size[e] for e in way[:k]) for k in range(len(way))] for r, way in roads.items()}
    whole = {r: sum(size[e] for e in way) for r, way in roads.items()}

    def put(e, p):
        x, y, x1, y1 = place[e]
        return max(0.0, min(size[e], ((p[0] - x) * (x1 - x) + (p[1] - y) * (y1 - y)) / size[e])) if size[e] else 0.0

    def angle(e, v):
        w = (place[e][2] - place[e][0], place[e][3] - place[e][1])
        m = math.hypot(*w) * math.hypot(*v)
        return math.acos(max(-1.0, min(1.0, (w[0] * v[0] + w[1] * v[1]) / m))) if m else 0.0

    near = {r: min((0.5 * (away(place[e], fixes[0]) / pace) ** 2, b + put(e, fixes[0])) for e, b in zip(way, before[r]) if gap(place[e], fixes[0]) <= 2.5 * pace) for r, way in roads.items() if any(gap(place[e], fixes[0]) <= 2.5 * pace for e in way)}
    states = [{r: (*s, None) for r, s in near.items()}]
    for a, b in zip(fixes, fixes[1:]):
        new = {}
        for r, (cost, along, _) in states[-1].items():
            nexts = [(r, along)] + [(q, along - whole[r]) for q, way in roads.items() if q != r and any(e[0] == roads[r][-1][1] for e in way)]
            for q, clip in nexts:
                if roads[q][0] == roads[r][-1][::-1] and roads[q][-1][1] == roads[r][0][0]:
                    continue
                low, high = clip + pace / 2, clip + 2 * pace
                if high < 0 or low > whole[q]:
                    continue
                ends = [x + size[e] for e, x in zip(roads[q], before[q])]
                i = next((i for i, x in enumerate(ends) if x >= low), len(ends) - 1)
                j = next((j for j, x in enumerate(ends) if x >= high), len(ends) - 1)
                for e, x in list(zip(roads[q], before[q]))[i : j + 1]:
                    at = max(x, min(x + size[e], max(low, min(high, x + put(e, b)))))
                    t = (at - x) / size[e] if size[e] else 0.0
                    here = [place[e][k] + t * (place[e][k + 2] - place[e][k]) for k in (0, 1)]
                    far = math.dist(here, b) + 12 * angle(e, (b[0] - a[0], b[1] - a[1]))
                    if far <= 4 * pace:
                        new[q] = min(new.get(q, (math.inf,)), (cost + 0.5 * (far / pace) ** 2, at, r))
        states.append(new)
    return states


def check_roads(spark, obs, roads, pace):
    """Compares final states, ways and second choices with the plain search; gives the ways by trace."""
    place = {(r.src, r.dst): (r.x, r.y, r.x1, r.y1) for r in roads.collect()}
    graph = road_graph(roads.withColumn("size", expr("sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))")))
    chains = defaultdict(list)
    for r in sorted(graph["chains"].collect(), key=lambda r: r.seq):
        chains[r.road].append((r.src, r.dst))
    traces = defaultdict(list)
    for r in sorted(obs.collect(), key=lambda r: (r.trace_id, r.ts, r.x, r.y)):
        traces[r.trace_id].append((r.x, r.y))
    states = matching.road_states(obs, matching.road_segments(graph, roads), graph, pace)
    found = defaultdict(dict)
    for r in states.where("step = steps - 1").collect():
        found[r.trace_id][r.road] = r.cost
    best = matching.best_roads(states)
    first, second = ({r.trace_id: r for r in x.collect()} for x in (best, matching.best_roads(states, best)))
    ways = defaultdict(dict)
    for r in matching.map_match_roads(obs, roads, pace).collect():
        assert r.step not in ways[r.trace_id] and r.cost == pytest.approx(first[r.trace_id].cost)
        ways[r.trace_id][r.step] = r.road
    for t, fixes in traces.items():
        want = road_search(fixes, place, chains, pace)
        assert found[t] == pytest.approx({r: s[0] for r, s in want[-1].items()})
        if not want[-1]:
            assert t not in ways
            continue
        costs = sorted(s[0] for s in want[-1].values())
        assert first[t].cost == pytest.approx(costs[0]) and (second[t].cost == pytest.approx(costs[1]) if len(costs) > 1 else t not in second)
        way = [first[t].road]
        for s in want[:0:-1]:
            way.append(s[way[-1]][2])
        assert [ways[t][k] for k in range(len(fixes))] == way[::-1]
    return ways


def test_roads_as_plain_search(spark, data):
    assert len(check_roads(spark, iterative._walks(spark, data), X.roads(spark, data), 25.0)) > 2


def test_roads_of_many_edges_both_ways(spark, monkeypatch):
    """Bent two-way roads between three crossings, in stretches of seven fixes: traces along them, one that jumps, one far off, one of one fix, nulls."""
    monkeypatch.setattr(matching, "STRETCH", 7)
    legs = [[(0, 0.0, 0.0), *((100 + k, 20.0 * k + 20, 6.0 * (k % 2)) for k in range(12)), (1, 260.0, 0.0)], [(1, 260.0, 0.0), *((200 + k, 260.0 + 3 * (k % 2), 20.0 * k + 20) for k in range(9)), (2, 260.0, 200.0)], [(1, 260.0, 0.0), (300, 330.0, -20.0), (3, 400.0, 0.0)], [(0, 0.0, 0.0), (400, 100.0, 120.0), (2, 260.0, 200.0)], [(2, 260.0, 200.0), (5, 300.0, 260.0)], [(0, 0.0, 0.0), (6, -60.0, 0.0)]]
    rows = [(a[0], b[0], *a[1:], *b[1:]) for leg in legs for way in (leg, leg[::-1]) for a, b in zip(way, way[1:])]
    roads = spark.createDataFrame(rows, "src long, dst long, x double, y double, x1 double, y1 double")
    there = [(20.0 * k, 4.0) for k in range(13)] + [(262.0, 20.0 * k) for k in range(11)]
    points = {1: there, 2: there[::-1], 3: there[:9] + there[16:], 4: [(9e5, 9e5)] * 3, 5: [(30.0, 3.0)], 6: [(20.0 * k, -0.7 * k) for k in range(19)], 7: there[:8], 8: [(0.8 * p, 0.6 * p) for p in range(0, 160, 20)], 9: [(50.0, 1.0)] * 4}
    obs = spark.createDataFrame([(t, k, *p) for t, ps in points.items() for k, p in enumerate(ps)] + [(None, 0, 1.0, 1.0), (5, None, 1.0, 1.0)], "trace_id long, ts long, x double, y double")
    ways = check_roads(spark, obs.dropna(), roads, 20.0)
    assert [ways[1][k] for k in (3, 20)] == ["0-100", "1-200"] and len(ways[1]) == 24 and set(ways[1].values()).isdisjoint(ways[2].values()) and 4 not in ways
    assert matching.map_match_roads(obs, roads, 20.0).where("trace_id = 5").count() == 1
    assert matching.map_match_roads(obs.where("false"), roads, 20.0).count() == 0 == matching.map_match_roads(obs, roads.where("false"), 20.0).count()


def test_traces_go_on_together():
    """Two traces in one call of _onward and _backward get what each gets alone."""
    state = pd.DataFrame({"trace_id": [1, 2], "step": [0, 0], "road": ["a", "a"], "cost": [0.5, 0.25], "along": [0.0, 10.0]})
    cols = ["trace_id", "step", "road", "origin", "base", "turn", "before", "size", "whole", "sx", "sy", "tx", "ty", "px", "py"]
    rows = pd.DataFrame([(t, k, "a", "a", 0.0, 0.0, 0.0, 200.0, 200.0, 0.0, 0.0, 200.0, 0.0, 20.0 * k + 3 * t, 2.0 * t) for t in (1, 2) for k in (1, 2, 3) if (t, k) != (2, 3)], columns=cols)
    alone = pd.concat([matching._onward(state[state.trace_id == t], rows[rows.trace_id == t], 20.0) for t in (1, 2)])
    both = matching._onward(state, rows, 20.0).sort_values(["trace_id", "step"])
    assert len(both) == 5 and both.values.tolist() == alone.values.tolist()
    ends = pd.DataFrame({"trace_id": [1, 2], "step": [3, 2], "road": ["a", "a"]})
    back = matching._backward(ends, both)
    assert sorted(map(tuple, back.values.tolist())) == [(t, k, "a") for t, n in ((1, 3), (2, 2)) for k in range(n + 1)]


def test_an_edge_is_searched_from_once_and_halves_meet(spark):
    """Moves in a ring with a shortcut: exact numbers of moves, none to six, against plain steps; a search's rows don't grow with the fixes that ask."""
    moves = [(k, (k + d) % 7, c + k) for k in range(7) for d, c in ((0, 5), (1, 2), (3, 4))]
    table = spark.createDataFrame(moves, "edge long, to long, move long")
    gaps = [(t, s, (t + 2 * s) % 7, (s + a) % 7, b) for t in range(6) for s in range(3) for a in (0, 2) for b in (1, 4, 6)]
    starts = spark.createDataFrame(sorted({(t, s, h, a) for t, s, h, a, _ in gaps}), "trace_id long, step long, hops int, a long")
    ends = spark.createDataFrame(sorted({(t, s, h, b, 10) for t, s, h, _, b in gaps}), "trace_id long, step long, hops int, b long, more long")
    best = {}
    for a in range(7):
        state = {a: (0, (a,))}
        for h in range(7):
            best |= {(h, a, b): v for b, v in state.items()}
            new = {}
            for e, (c, way) in state.items():
                for _, to, m in (x for x in moves if x[0] == e):
                    new[to] = min(new.get(to, (math.inf, ())), (c + m, (*way, to)))
            state = new
    got = {}
    for r in matching._met(starts, ends, table, ways=True).collect():
        key = (r.trace_id, r.step, r.a, r.b)
        got[key] = min(got.get(key, (math.inf, ())), (r.cost - 10, tuple(r.way)))
    assert got == {(t, s, a, b): best[h, a, b] for t, s, h, a, b in gaps if (h, a, b) in best}
    begin = starts.selectExpr("false AS back", "a AS edge", "5 AS hops")
    assert matching._reached(begin, table).count() == matching._reached(begin.distinct(), table).count() == 7 * begin.distinct().count()


def test_traces_side_by_side_share_the_network(spark, monkeypatch):
    """What a batch of traces gets of the network is written once, not for each fix or trace; each gets its own states."""
    wrote, real = [], matching.stored

    def counted(df, *by):
        out = real(df, *by)
        if by:
            wrote.append(out.count())
        return out

    monkeypatch.setattr(matching, "stored", counted)
    rows = [(a, b, 20.0 * a, 0.0, 20.0 * b, 0.0) for k in range(15) for a, b in ((k, k + 1), (k + 1, k))]
    roads = spark.createDataFrame(rows, "src long, dst long, x double, y double, x1 double, y1 double")
    graph = road_graph(roads.withColumn("size", expr("abs(x1 - x)")))
    segs, found = real(matching.road_segments(graph, roads)), []
    for copies in (1, 30):
        obs = spark.createDataFrame([(t, k, 20.0 * k, 3.0) for t in range(copies) for k in range(14)], "trace_id long, ts long, x double, y double")
        found.append(matching.road_states(obs, segs, graph, 20.0).drop("trace_id"))
    assert wrote[0] == wrote[1] > 0
    one, many = ([tuple(r) for r in df.collect()] for df in found)
    assert len(one) > 14 and sorted(30 * one, key=repr) == sorted(many, key=repr)


def test_second_roads_make_their_segments_once(spark, data, monkeypatch):
    seen, real = [], matching.road_states
    monkeypatch.setattr(matching, "road_states", lambda obs, segs, *a: (seen.append(segs), real(obs, segs, *a))[1])
    assert iterative._second_roads(spark, data).count() > 0
    assert hasattr(seen[0], "_scratch_path")
