"""The nearest crossings of the rays in one grid cell with its edges, as arrays; paths.connect_up deals out the cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs of a ray and an edge that are compared at once; edges tried first, to shorten the rays; parts of a box each way.
PAIRS, TRIED, PARTS = 1 << 17, 64, 4


def _touch(x, y, dx, dy, box):
    """Whether the segments from (x, y) on by (dx, dy) meet the box."""
    x0, y0, x1, y1 = box
    cx, cy, hx, hy = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2
    over = (np.maximum(x, x + dx) >= x0) & (np.minimum(x, x + dx) <= x1) & (np.maximum(y, y + dy) >= y0) & (np.minimum(y, y + dy) <= y1)
    return over & (np.abs(dx * (cy - y) - dy * (cx - x)) <= hx * np.abs(dy) + hy * np.abs(dx))


def _lines(x, y, dx, dy, reach: float, off: float):
    """The numbers of the lines through the segments, by direction and distance from the origin; `off` also takes numbers that near."""
    way, parts = np.arctan2(dy, dx), 1 << 24
    turn, aside = way / np.pi * parts, np.abs(x * np.sin(way) - y * np.cos(way)) / (reach * 1e-5)
    near = lambda v: [np.floor(v - off), np.floor(v + off)] if off else [np.floor(v)]
    return [(t.astype("int64") % parts << 38) + a.astype("int64") for t in near(turn) for a in near(aside)]


def nearest(rays: np.ndarray, edges: np.ndarray, apart, box: tuple[float, float, float, float], reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rays and of edges (rows of x, y, x1, y1) that meet no farther along the ray than the nearest edge does, up to rounding.

    The formula is that of geometry.segment_intersection, so the pairs hold each ray's nearest edges in the box. apart(i, j) tells which pairs count.
    A box with many rays and edges is cut into smaller ones, after some edges have shortened the rays. What lies on a ray's
    line may count as met at its start wherever it lies, and is looked up by the line.
    """
    (rx, ry, ex, ey), (sx, sy, tx, ty) = rays.T, edges.T
    dx, dy, qx, qy = ex - rx, ey - ry, tx - sx, ty - sy
    best, none = np.ones(len(rays)), np.zeros(0, "int64")
    slack = 1e-12 + 1e-14 * np.abs(rays).max(axis=1, initial=0.0) / np.maximum(np.hypot(dx, dy), 1e-300)
    found = [(none, none, np.zeros(0))]

    def take(i, j, t, fine):
        meet = lambda a, b, c, d: (np.minimum(a, b) <= np.maximum(c, d)) & (np.minimum(c, d) <= np.maximum(a, b))
        fine &= meet(rx[i], ex[i], sx[j], tx[j]) & meet(ry[i], ey[i], sy[j], ty[j]) & apart(i, j)
        i, j, t = i[fine], j[fine], t[fine]
        np.minimum.at(best, i, t)
        kept = t <= best[i] + slack[i]
        found.append((i[kept], j[kept], t[kept]))

    def compare(i, j):
        for part in np.array_split(i, len(i) * len(j) // PAIRS + 1):
            far = np.minimum(best[part] + slack[part], 1.0)[:, None]
            gx, gy = sx[j] - rx[part, None], sy[j] - ry[part, None]
            den = dx[part, None] * qy[j] - dy[part, None] * qx[j]
            t = (gx * qy[j] - gy * qx[j]) / den
            a, b = np.nonzero((t >= 0) & (t <= far))
            u = (gx[a, b] * dy[part[a]] - gy[a, b] * dx[part[a]]) / den[a, b]
            take(part[a], j[b], t[a, b], (u >= 0) & (u <= 1))

    def search(i, j, box, depth):
        if len(i) * len(j) <= PAIRS or len(i) <= PARTS * PARTS or len(j) <= 4 * TRIED or depth == 8:
            return compare(i, j)
        compare(i, j[:: max(1, len(j) // TRIED)])
        w, h = (box[2] - box[0]) / PARTS, (box[3] - box[1]) / PARTS
        for a in range(PARTS):
            for b in range(PARTS):
                part = (box[0] + a * w - edge, box[1] + b * h - edge, box[0] + (a + 1) * w + edge, box[1] + (b + 1) * h + edge)
                far = np.minimum(best[i] + slack[i], 1.0)
                here = i[_touch(rx[i], ry[i], dx[i] * far, dy[i] * far, part)]
                if len(here) and len(there := j[_touch(sx[j], sy[j], qx[j], qy[j], part)]):
                    search(here, there, part, depth + 1)

    edge = (box[2] - box[0]) * 1e-6
    mid = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    with np.errstate(all="ignore"):
        lines = _lines(sx - mid[0], sy - mid[1], qx, qy, reach, 0.0)[0]
        order = np.argsort(lines, kind="stable")
        lines = lines[order]
        for mine in _lines(rx - mid[0], ry - mid[1], dx, dy, reach, 0.01):
            low, high = (np.searchsorted(lines, mine, side) for side in ("left", "right"))
            ends = np.cumsum(high - low)
            for part in np.split(np.arange(len(mine)), np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)) if len(ends) else []):
                n = (high - low)[part]
                i = np.repeat(part, n)
                j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)]
                gx, gy, den = sx[j] - rx[i], sy[j] - ry[i], dx[i] * qy[j] - dy[i] * qx[j]
                un = gx * dy[i] - gy * dx[i]
                along, t, u = (den == 0) & (un == 0), (gx * qy[j] - gy * qx[j]) / den, un / den
                take(i, j, np.where(along, 0.0, t), along | ((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)))
        search(np.arange(len(rays)), np.arange(len(edges)), box, 0)
    i, j, t = (np.concatenate(c) for c in zip(*found, strict=True))
    fine = t <= best[i] + slack[i]
    i, j = i[fine], j[fine]
    first = np.unique(i * np.int64(max(len(edges), 1)) + j, return_index=True)[1]
    return i[first], j[first]


def meet_in_cell(rays: pa.Table, edges: pa.Table, size: float, reach: float) -> pa.Table:
    """(node, rx, ry, ex, ey, src, dst, sx, sy, tx, ty) of the pairs of `nearest` in one cell (gx, gy), or in a part of it."""
    if not rays.num_rows or not edges.num_rows:
        i = j = np.zeros(0, "int64")
    else:
        gx, gy = rays["gx"][0].as_py(), rays["gy"][0].as_py()
        node, src, dst = (t[c].to_numpy() for t, c in ((rays, "node"), (edges, "src"), (edges, "dst")))
        places = lambda t, cols: np.column_stack([t[c].to_numpy() for c in cols])
        box = (gx * size, gy * size, (gx + 1) * size, (gy + 1) * size)
        apart = lambda i, j: (node[i] != src[j]) & (node[i] != dst[j])
        i, j = nearest(places(rays, ("rx", "ry", "ex", "ey")), places(edges, ("sx", "sy", "tx", "ty")), apart, box, reach)
    left = rays.select(["node", "rx", "ry", "ex", "ey"]).take(pa.array(i))
    right = edges.select(["src", "dst", "sx", "sy", "tx", "ty"]).take(pa.array(j))
    return pa.table({c: t[c] for t in (left, right) for c in t.column_names})
