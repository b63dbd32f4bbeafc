"""Rays that meet edges: cells are dealt out once, full ones in parts, and boxes are cut up without losing a pair."""

import random

import numpy as np
import pytest

from tarmac.operators import crossings, paths


def network(spark, n, wide, seed):
    rng = random.Random(seed)
    nodes = [(k, float(rng.randrange(wide)), float(rng.randrange(wide))) for k in range(2 * n)]
    edges = [(2 * k, 2 * k + 1) for k in range(n)]
    return spark.createDataFrame(nodes, "node_id long, x double, y double"), spark.createDataFrame(edges, "src long, dst long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_many_rays_do_not_make_cells_narrower(spark, monkeypatch):
    """Edges are in some cells as wide as rays are long, however many rays there are."""
    made, real = [], paths._walked
    monkeypatch.setattr(paths, "_walked", lambda df, line, size: (out := real(df, line, size), made.append(out.count()))[0])
    n = 600
    assert len(rows(paths.connect_up(*network(spark, n, 400, 5), 40.0))) > n
    assert len(made) == 2 and sum(made) < (2 + 7) * 2 * n


def test_full_cells_are_dealt_out_in_parts(spark, monkeypatch):
    nodes, edges = network(spark, 150, 300, 6)
    want, seen, real = rows(paths.connect_up(nodes, edges, 60.0)), [], paths.stored
    monkeypatch.setattr(paths, "CELL", 40)
    monkeypatch.setattr(paths, "stored", lambda df: (seen.append(df.columns), real(df))[1])
    assert rows(paths.connect_up(nodes, edges, 60.0)) == want and ["gx", "gy", "rays", "edges"] in seen


@pytest.mark.parametrize("pairs", [1 << 17, 64])
def test_nearest_edges_as_all_pairs(monkeypatch, pairs):
    """The nearest edge of each ray is among the pairs, also where boxes are cut up to the last and edges share ends or lines."""
    monkeypatch.setattr(crossings, "PAIRS", pairs)
    monkeypatch.setattr(crossings, "TRIED", 4)
    rng = np.random.default_rng(7)
    rays, edges = (rng.integers(0, 100, (n, 4)).astype(float) for n in (120, 300))
    edges[::7, :2] = edges[1::7, :2][: len(edges[::7])]  # common ends
    edges[5], rays[5], edges[9] = (10, 50, 30, 50), (40, 50, 5, 50), (60, 50, 70, 50)  # one line, the last beyond the ray's start
    r, e = rays[:, None, :], edges[None, :, :]
    d, q, g = r[..., 2:] - r[..., :2], e[..., 2:] - e[..., :2], e[..., :2] - r[..., :2]
    cross = lambda a, b: a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]
    with np.errstate(all="ignore"):
        den, un = cross(d, q), cross(g, d)
        t, u = cross(g, q) / den, un / den
    over = np.logical_and.reduce([(np.minimum(r[..., k], r[..., k + 2]) <= np.maximum(e[..., k], e[..., k + 2])) & (np.minimum(e[..., k], e[..., k + 2]) <= np.maximum(r[..., k], r[..., k + 2])) for k in (0, 1)])
    along = (den == 0) & (un == 0)
    t = np.where(over & (along | ((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))), np.where(along, 0.0, t), np.inf)
    far = t.min(axis=1)
    want = {(i, j) for i, j in zip(*np.nonzero((t == far[:, None]) & np.isfinite(t)))}
    got = set(zip(*(x.tolist() for x in crossings.nearest(rays, edges, lambda i, j: np.ones(len(i), bool), (0.0, 0.0, 100.0, 100.0), 30.0))))
    assert want <= got and all(t[i, j] <= far[i] + 1e-9 for i, j in got) and len(want) > 100 and (5, 5) in got and (5, 9) not in got


def test_edges_get_their_ends_once(spark, monkeypatch):
    """split_edges joins the nodes to the edges once, for those that are cut and for the others."""
    calls, real = [], paths.with_ends
    nodes, edges = network(spark, 60, 100, 8)
    cuts = paths.connect_up(nodes, edges, 40.0).select("node", "src", "dst", "at_x", "at_y")
    monkeypatch.setattr(paths, "with_ends", lambda *a: (calls.append(a), real(*a))[1])
    more, after = paths.split_edges(nodes, edges, cuts)
    assert len(calls) == 1 and after.count() > 60 and more.count() > 120
