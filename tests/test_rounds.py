"""Operators in rounds against plain Python on small inputs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tarmac.core import materialise, release
from tarmac.operators import matching, paths, regions
from tarmac.operators.components import components


def masks(seed=3, tiles=4, n=8):
    rng = random.Random(seed)
    return {t: {(x, y) for x in range(n) for y in range(n) if rng.random() < 0.55} for t in range(tiles)}


def frame(spark, m):
    return spark.createDataFrame([(t, x, y) for t, ps in m.items() for x, y in ps], "tile_id long, x int, y int")


def back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.tile_id, set()).add((r.x, r.y))
    return out


def python_thin(ps):
    ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    while True:
        before = len(ps)
        for first in (True, False):
            gone = set()
            for x, y in ps:
                p = [(x + a, y + b) in ps for a, b in ring]
                rises = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                n, e, s, w = p[0], p[2], p[4], p[6]
                ok = not (n and e and s) and not (e and s and w) if first else not (n and e and w) and not (n and s and w)
                if 2 <= sum(p) <= 6 and rises == 1 and ok:
                    gone.add((x, y))
            ps = ps - gone
        if len(ps) == before:
            return {q for q in ps if sum((q[0] + a, q[1] + b) in ps for a, b in ring) <= 6}


def test_thin(spark):
    m = masks()
    assert back(regions.thin(frame(spark, m))) == {t: python_thin(ps) for t, ps in m.items()}


def test_greedy_cover(spark):
    m, want = masks(5), {}
    for t, ps in m.items():
        live, kept = set(ps), set()
        for p in sorted(ps, key=lambda q: (q[1], q[0])):
            if p in live:
                kept.add(p)
                live -= {q for q in live if (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 <= 4}
        want[t] = kept
    assert back(regions.greedy_cover(frame(spark, m), 2.0, 8)) == want


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(301)}


def test_greedy_matching(spark):
    rng = random.Random(2)
    pairs = [(a, b, round(rng.random(), 2)) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.4]
    used, want = set(), set()
    for c, a, b in sorted((c, a, b) for a, b, c in pairs):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    got = paths.greedy_matching(spark.createDataFrame(pairs, "a int, b int, distance double")).collect()
    assert {(r.a, r.b) for r in got} == want


def test_set_overlap_merge(spark):
    rng = random.Random(7)
    members = [(g, rng.randrange(40)) for g in range(30) for _ in range(rng.randrange(1, 3))]
    sets = {g: {p for h, p in members if h == g} for g in range(30)}
    name = {g: g for g in sets}
    while True:
        new = {g: min(name[h] for h in sets if sets[g] & sets[h]) for g in sets}
        if new == name:
            break
        name = new
    got = paths.set_overlap_merge(spark.createDataFrame(members, "g long, p long"), "g", "p").collect()
    assert {r.g: r.merged for r in got} == name


def python_simplify(ps, eps):
    if len(ps) < 3:
        return set(p[0] for p in ps)
    (_, ax, ay), (_, bx, by) = ps[0], ps[-1]

    def far(p):
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if d == 0 else max(0, min(1, ((p[1] - ax) * (bx - ax) + (p[2] - ay) * (by - ay)) / d))
        return ((p[1] - ax - t * (bx - ax)) ** 2 + (p[2] - ay - t * (by - ay)) ** 2) ** 0.5

    k = max(range(1, len(ps) - 1), key=lambda i: (far(ps[i]), -i))
    if far(ps[k]) < eps:
        return {ps[0][0], ps[-1][0]}
    return python_simplify(ps[: k + 1], eps) | python_simplify(ps[k:], eps)


def test_simplify_lines(spark):
    rng = random.Random(4)
    lines = {k: [(i, rng.randrange(50), rng.randrange(50)) for i in range(rng.randrange(2, 15))] for k in range(12)}
    df = spark.createDataFrame([(k, *p) for k, ps in lines.items() for p in ps], "line long, pos int, x int, y int")
    got = {}
    for r in paths.simplify_lines(df, "line", 8.0).collect():
        got.setdefault(r.line, set()).add(r.pos)
    assert got == {k: python_simplify(ps, 8.0) for k, ps in lines.items()}


def test_contract_chains_with_branch_and_loop(spark):
    und = [(1, 2), (2, 3), (3, 4), (3, 5), (10, 11), (11, 12), (12, 10)]
    edges = spark.createDataFrame(und + [(b, a) for a, b in und], "src long, dst long")
    got = {}
    for r in paths.contract_chains(edges).collect():
        got.setdefault(r.road, []).append((r.seq, r.src, r.dst))
    chains = sorted([(s, d) for _, s, d in sorted(v)] for v in got.values())
    assert sum(map(len, chains)) == 14
    assert [(1, 2), (2, 3)] in chains and [(3, 2), (2, 1)] in chains and [(3, 4)] in chains
    assert [(10, 11), (11, 12), (12, 10)] in chains and [(10, 12), (12, 11), (11, 10)] in chains


def test_contract_chains_of_a_long_loop(spark):
    n = 10_000
    edges = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
    got = {(r.src, r.dst): r.seq for r in paths.contract_chains(edges).collect()}
    assert got == {(i, (i + 1) % n): i for i in range(n)}


def test_path_to_over_many_nodes(spark):
    n = 1000
    found = spark.createDataFrame([(0, i, float(i), i - 1 if i else None) for i in range(n)], "source long, node long, dist double, pred long")
    got = {r.step: r.node for r in paths.path_to(found, spark.createDataFrame([(0, n - 1), (0, 1), (0, 0)], "source long, target long")).where(f"target = {n - 1}").collect()}
    assert got == {k: n - 1 - k for k in range(n - 1)}


def test_greedy_cover_of_a_whole_tile(spark):
    size = 1300
    line = spark.createDataFrame([(1, i, 7) for i in range(size)] + [(1, 9, i) for i in range(size)], "tile_id long, x int, y int")
    live, want = {(i, 7) for i in range(size)} | {(9, i) for i in range(size)}, set()
    for p in sorted(live, key=lambda q: (q[1], q[0])):
        if p in live:
            want.add(p)
            live -= {(p[0] + a, p[1] + b) for a in range(-10, 11) for b in range(-10, 11) if a * a + b * b <= 100}
    assert back(regions.greedy_cover(line, 10.0, size)) == {1: want}


def test_trace_edges(spark):
    """A crossing with three arms, one of them back into a loop, and a ring without a crossing."""
    arms = [[(5, 5), (4, 5), (3, 5), (2, 5)], [(5, 5), (5, 4), (5, 3)], [(5, 5), (6, 5), (7, 5), (8, 5), (9, 5)]]
    ring = [(20, 20), (21, 20), (22, 21), (21, 22), (20, 22), (19, 21)]
    pairs = [(0, *a, *b) for line in [*arms, [*ring, ring[0]]] for a, b in zip(line, line[1:], strict=False)]
    ends = {(5, 5), (2, 5), (5, 3), (9, 5)}
    pixels = {p for line in [*arms, ring] for p in line}
    kinds = spark.createDataFrame([(0, *p, "node" if p in ends else "path") for p in pixels], "tile_id long, x int, y int, kind string")
    got = paths.trace_edges(spark.createDataFrame(pairs, "tile_id long, x int, y int, x1 int, y1 int"), kinds).collect()
    lines = [[(p.x, p.y) for p in r.points] for r in got]
    want = [min(a, a[::-1]) for a in arms]
    assert sorted(x for x in lines if x[0] != x[-1]) == sorted(want)
    (loop,) = [x for x in lines if x[0] == x[-1]]
    assert len(loop) == 7 and set(loop) == set(ring) and all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(loop, loop[1:], strict=False))
    assert sorted(r.n for r in got) == [2, 3, 4, 6] and all(abs(r.length - sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(x, x[1:], strict=False))) < 1e-9 for r, x in zip(got, lines, strict=True))


def test_contract_chains_of_long_lines(spark):
    """Lines of many lengths, numbered at random, so that least edges lie anywhere."""
    rng, und, at = random.Random(8), [], 0
    for n in (1, 2, 3, 7, 40):
        ids = rng.sample(range(at, at + 1000), n + 1)
        at += 1000
        und += list(zip(ids, ids[1:], strict=False))
    loop = rng.sample(range(90_000, 90_100), 23)
    und += list(zip(loop, [*loop[1:], loop[0]], strict=True))
    edges = spark.createDataFrame(und + [(b, a) for a, b in und], "src long, dst long")
    got = {}
    for r in paths.contract_chains(edges).collect():
        got.setdefault(r.road, []).append((r.seq, r.src, r.dst))
    assert sorted(map(len, got.values())) == sorted([1, 2, 3, 7, 40, 23] * 2)
    for v in got.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v))) and all(a[2] == b[1] for a, b in zip(v, v[1:], strict=False))


def test_shortest_paths_obey_the_triangle(spark):
    rng = random.Random(6)
    edges = [(a, b, float(rng.randrange(1, 9))) for a in range(15) for b in range(15) if a != b and rng.random() < 0.2]
    found = paths.shortest_paths(spark.createDataFrame(edges, "src long, dst long, size double"), spark.createDataFrame([(0,), (3,)], "source long"), 1e9)
    dist = {(r.source, r.node): r.dist for r in found.collect()}
    for s in (0, 3):
        assert dist[s, s] == 0
        assert all(dist.get((s, b), 1e18) <= dist[s, a] + w for a, b, w in edges if (s, a) in dist)


def test_seeded_growth_contact(spark):
    low = {0: {(x, 0) for x in range(7)}}
    high = {0: {(0, 0), (6, 0)}}
    got = {(r.x, r.y): r.label for r in regions.seeded_growth(frame(spark, low), frame(spark, high), 8).collect()}
    assert got[3, 0] == 0 and got[2, 0] == got[0, 0] and got[4, 0] == got[6, 0] and got[0, 0] != got[6, 0]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(spark, n):
    m = spark.createDataFrame([(0, 1, 1)][:n], "tile_id long, x int, y int")
    assert regions.pixel_components(m, 8).count() == n
    assert regions.thin(m).count() == n


def test_map_matching_over_gaps(spark):
    """A straight road beside another: fixes several edges apart are matched in order, however long the gap."""
    roads = spark.createDataFrame([(i, i + 1, 60.0 * i, 0.0, 60.0 * i + 60, 0.0) for i in range(30)] + [(100 + i, 101 + i, 60.0 * i, 90.0, 60.0 * i + 60, 90.0) for i in range(30)], "src long, dst long, x double, y double, x1 double, y1 double")
    at = [5.0, 30.0, 190.0, 250.0, 900.0, 1110.0]
    obs = spark.createDataFrame([(1, k, x, 4.0) for k, x in enumerate(at)] + [(2, k, 25.0 * k, 86.0) for k in range(5)] + [(3, 0, 1.0, 1.0)], "trace_id long, ts long, x double, y double")
    got = {}
    for r in matching.map_match_sparse(obs, roads).orderBy("trace_id", "step").collect():
        got.setdefault(r.trace_id, []).append(r.src)
    assert set(got) == {1, 2} and len(got[1]) == 6 and got[1] == sorted(got[1]) and all(abs(60 * s + 30 - x) <= 80 for s, x in list(zip(got[1], at, strict=True))[1:]) and 60 * got[1][0] <= at[0] + 100  # all edges within 100 are equal at the start
    assert len(got[2]) == 5 and all(s >= 100 for s in got[2])
    near = matching.map_match(obs.where("trace_id = 2"), roads).orderBy("step").collect()
    assert [r.step for r in near] == list(range(5)) and all(r.src >= 100 for r in near)


def test_a_released_partition_leaves_the_others(spark):
    kept = materialise(spark.range(90).withColumn("slice", (F.col("id") % 3).cast("int")), "slice")
    read = {}
    for s in range(4):  # no row lies in the last
        read[s] = sorted(r.id for r in kept.where(F.col("slice") == s).collect())
        release(kept, f"slice={s}")
    assert read == {0: list(range(0, 90, 3)), 1: list(range(1, 90, 3)), 2: list(range(2, 90, 3)), 3: []}
    release(kept)
    assert not os.path.exists(kept._scratch_path.removeprefix("file:"))
