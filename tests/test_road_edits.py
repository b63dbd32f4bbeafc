"""Roads as a graph, and edges cut by lengthened dead ends, against plain Python."""

import math
import random
from collections import Counter

from tarmac.operators import paths
from tarmac.plans import iterative


def test_road_graph(spark, data):
    net = [(r.src, r.dst) for r in iterative._network(spark, data).collect()]
    out = {}
    for a, b in net:
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)
    roads = {}
    for v in out:
        for w in out[v] if len(out[v]) != 2 else []:
            way = [v, w]
            while len(out[way[-1]]) == 2:
                way.append(next(x for x in out[way[-1]] if x != way[-2]))
            roads[f"{v}-{w}"] = way
    g = paths.road_graph(iterative._weighted(iterative._network(spark, data)))
    got = {r.road: r for r in g["roads"].collect()}
    loops = {k for k, r in got.items() if k not in roads}
    assert set(roads) <= set(got) and all(len(out[got[k].head]) == 2 for k in loops)
    assert all((got[k].head, got[k].tail, got[k].n) == (w[0], w[-1], len(w) - 1) for k, w in roads.items())
    links = {(r.road, r.way, r.other) for r in g["links"].collect() if r.road not in loops}
    assert links == {(k, way, j) for k, w in roads.items() for j, x in roads.items() if k != j for way in ("in", "out") if (x[-1] == w[0] if way == "in" else x[0] == w[-1])}
    opposite = {r.road: r.opposite for r in g["opposites"].collect() if r.road not in loops}
    assert opposite == {k: f"{w[-1]}-{w[-2]}" for k, w in roads.items() if f"{w[-1]}-{w[-2]}" != k}


def test_splitting_an_edge_at_many_places(spark):
    nodes = [(1, 0.0, 0.0), (2, 100.0, 0.0), (9, 100.0, 50.0)] + [(10 + k, 10.0 * k + 5, 30.0) for k in range(9)] + [(20, 0.0, 9.0), (21, 5.0, -9.0)]
    edges = spark.createDataFrame([(1, 2), (2, 9)], "src long, dst long")
    cuts = [(10 + k, 1, 2, 10.0 * k + 5, 0.0) for k in range(8, -1, -1)] + [(20, 1, 2, 0.0, 0.0), (21, 1, 2, 5.0, 0.0), (21, 1, 2, 5.0, 0.0)]
    new, after = paths.split_edges(spark.createDataFrame(nodes, "node_id long, x double, y double"), edges, spark.createDataFrame(cuts, "node long, src long, dst long, at_x double, at_y double"))
    at = {r.node_id: (r.x, r.y) for r in new.collect()}
    inner = {22 + k: (10.0 * k + 5, 0.0) for k in range(9)}
    assert {k: v for k, v in at.items() if k > 21} == inner
    line = [1, *range(22, 31), 2]
    want = {(min(e), max(e)) for e in zip(line, line[1:])} | {(2, 9), (1, 20), (21, 22)} | {(10 + k, 22 + k) for k in range(9)}
    rows = after.collect()
    assert {(r.src, r.dst) for r in rows} == want and len(rows) == len(want) and all(abs(r["size"] - math.dist(at[r.src], at[r.dst])) < 1e-9 for r in rows)
    same = paths.split_edges(spark.createDataFrame(nodes, "node_id long, x double, y double"), edges, spark.createDataFrame([], "node long, src long, dst long, at_x double, at_y double"))
    assert same[0].count() == len(nodes) and {(r.src, r.dst) for r in same[1].collect()} == {(1, 2), (2, 9)}


def test_ends_beside_likely_pixels(spark):
    """A dead end at (50, 0) that looks right: an edge that begins ahead, nearly parallel, counts where the pixels on the way are likely."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0), (3, 80.0, 6.0), (4, 120.0, 20.0), (5, 70.0, 30.0), (6, 70.0, 90.0), (7, 45.0, 25.0), (8, 20.0, 60.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (7, 8)], "src long, dst long")
    pixels = [(x, y, 60.0) for x in range(20, 45) for y in range(-3, 8)]
    sure = spark.createDataFrame(pixels, "x long, y long, v double")
    got = {r.node: r for r in paths.connect_up(nodes, edges, 40.0, sure).collect()}
    assert (got[2].src, got[2].dst, got[2].at_x, got[2].at_y) == (3, 4, 80.0, 6.0) and abs(got[2].far - math.dist((50, 0), (80, 6))) < 1e-9
    assert 2 not in {r.node for r in paths.connect_up(nodes, edges, 40.0, sure.withColumn("v", sure.v - 6)).collect()}
    assert 2 not in {r.node for r in paths.connect_up(nodes, edges, 40.0).collect()}
    assert 2 not in {r.node for r in paths.connect_up(nodes, edges, 30.0, sure).collect()}


def test_rays_among_many_edges(spark):
    """connect_up against all pairs: edges of all lengths, on a ray's line, through its start, and without length."""
    rng = random.Random(3)
    at = {k: (float(rng.randrange(300)), float(rng.randrange(300))) for k in range(240)}
    at |= {300: (10.0, 50.0), 301: (20.0, 50.0), 302: (60.0, 50.0), 303: (80.0, 50.0), 310: (100.0, 5.0), 311: (100.0, 5.0), 312: (90.0, 5.0), 313: (95.0, 5.0), 320: (0.0, 0.0), 321: (290.0, 290.0), 322: (7.0, 7.0), 323: (4.0, 4.0)}
    edges = [(2 * k, 2 * k + 1) for k in range(120)] + [(2 * k, 2 * k + 2) for k in range(0, 60, 3)] + [(300, 301), (302, 303), (310, 311), (312, 313), (320, 321), (322, 323)]
    degree = Counter(v for e in edges for v in e)
    cross = lambda a, b: a[0] * b[1] - a[1] * b[0]
    over = lambda a, b, c, d: min(a, b) <= max(c, d) and min(c, d) <= max(a, b)
    want = {}
    for u, v in [e for s, d in edges for e in ((s, d), (d, s)) if degree[e[0]] == 1]:
        p, f = at[u], at[v]
        n = math.sqrt((p[0] - f[0]) * (p[0] - f[0]) + (p[1] - f[1]) * (p[1] - f[1]))
        e = [p[i] + (p[i] - f[i]) * (60.0 / n if n else 0.0) for i in (0, 1)]
        r = [e[i] - p[i] for i in (0, 1)]
        for s, d in edges:
            a, b = at[s], at[d]
            if u in (s, d) or not all(over(p[i], e[i], a[i], b[i]) for i in (0, 1)):
                continue
            q, g = [b[i] - a[i] for i in (0, 1)], [a[i] - p[i] for i in (0, 1)]
            den = cross(r, q)
            if den == 0 and cross(g, r) == 0:
                hit = (0.0, s, d)
            elif den != 0 and 0 <= cross(g, q) / den <= 1 and 0 <= cross(g, r) / den <= 1:
                t = cross(g, q) / den
                hit = (math.sqrt((t * r[0]) ** 2 + (t * r[1]) ** 2), s, d)
            else:
                continue
            want[u] = min(want.get(u, hit), hit)
    nodes = spark.createDataFrame([(k, *xy) for k, xy in at.items()], "node_id long, x double, y double")
    got = {r.node: (r.far, r.src, r.dst) for r in paths.connect_up(nodes, spark.createDataFrame(edges, "src long, dst long"), 60.0).collect()}
    assert got.keys() == want.keys() and want[301][1:] == (302, 303) and 310 in want
    assert all(got[k][1:] == want[k][1:] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_a_line_is_in_the_cells_that_it_runs_through(spark):
    line = spark.createDataFrame([(0.5, 0.5, 999.5, 999.2)], "x double, y double, x1 double, y1 double")
    assert paths._walked(line, ["x", "y", "x1", "y1"], 1.0).count() < 3000
